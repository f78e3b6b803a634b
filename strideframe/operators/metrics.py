"""Counts, weights, scores and the tables behind the evaluation figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, COMPONENTS, TIME, TRIAL, col, component_columns
from strideframe.operators.positions import running_sum
from strideframe.storage import lookup_join, materialise

#: Equal bins of the fine prediction histogram.
FINE_BINS = 120


def value_counts(df: DataFrame, column: str = ACTIVITY) -> DataFrame:
    """Rows and share of each value, NULL included, with a display label."""
    counts = df.groupBy(col(column)).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        col(column),
        "count",
        (F.col("count") / total).alias("proportion"),
        F.initcap(col(column).cast("string")).alias("display"),
    )


def label_order(df: DataFrame, column: str = ACTIVITY, ties: Sequence[str] = ()) -> DataFrame:
    """Distinct values by first appearance in (TRIAL, TIME, ties) order."""
    first = F.min(F.struct(F.col(TRIAL), F.col(TIME), *[col(t) for t in ties]))
    return df.groupBy(col(column)).agg(first.alias("first_seen")).orderBy("first_seen")


def label_list(df: DataFrame, column: str = ACTIVITY) -> list[str]:
    """The classes as a list; a classifier's classes, never the rows."""
    return [r[0] for r in label_order(df, column).collect() if r[0] is not None]


def class_weights(df: DataFrame, column: str = ACTIVITY) -> DataFrame:
    """Inverse share of each class: the weight of its rows in training."""
    counted = value_counts(df, column)
    return counted.select(col(column), (F.lit(1.0) / F.col("proportion")).alias("weight"))


def with_class_weights(df: DataFrame, column: str = ACTIVITY, spread_by: Sequence[str] = (TRIAL, TIME)) -> DataFrame:
    """Add ``weight`` to every row with a class."""
    weights = materialise(class_weights(df.filter(col(column).isNotNull()), column))
    return lookup_join(df, weights, [column], [col(c) for c in spread_by], "inner")


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (true, predicted) pair; every classification score comes from these."""
    return df.groupBy(
        col(label).cast("string").alias("label"), col(prediction).cast("string").alias("prediction")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Row-normalised matrix: one row and one column per label, a class without rows is all zero.

    As scikit-learn does, only the given labels take part in the row sums.
    """
    names = [str(name) for name in labels]
    counts = confusion_counts(df, label, prediction).filter(
        F.col("label").isin(names) & F.col("prediction").isin(names)
    )
    # One generated row per class keeps classes that have no rows in ``df``.
    classes = df.sparkSession.createDataFrame([(name,) for name in names], "labels string")
    wide = counts.groupBy(F.col("label").alias("labels")).pivot("prediction", names).agg(F.sum("n"))
    total = sum((F.coalesce(col(name), F.lit(0)) for name in names), F.lit(0))
    share = [
        F.coalesce(F.try_divide(F.coalesce(col(name), F.lit(0)), F.nullif(total, F.lit(0))), F.lit(0.0)).alias(name)
        for name in names
    ]
    return classes.join(wide, "labels", "left").select("labels", *share)


def classification_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``n``, accuracy and support-weighted F1 (0 for a class never right)."""
    counts = confusion_counts(df, label, prediction)
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(hit, F.col("n")).otherwise(0).alias("right"),
        ),
        F.struct(
            F.col("prediction").alias("cls"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("right"),
        ),
    )
    per_class = (
        counts.select(F.inline(sides))
        .groupBy("cls")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("right").alias("right"))
        .withColumn("f1", F.lit(2.0) * F.col("right") / (F.col("support") + F.col("predicted")))
    )
    return per_class.agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("right"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("weighted_f1"),
    )


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``n``, R², RMSE and MAE over the rows that have a true value."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    squares = F.sum(F.pow(y - p, F.lit(2.0)))
    spread = F.var_pop(y) * F.count("*")
    exact = F.when(squares == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.filter(col(label).isNotNull()).agg(
        F.count("*").alias("n"),
        F.when(spread == 0, exact).otherwise(F.lit(1.0) - F.try_divide(squares, F.nullif(spread, F.lit(0.0)))).alias("r2"),
        F.sqrt(F.avg(F.pow(y - p, F.lit(2.0)))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def importance_rollup(importances: DataFrame, name: str = "feature", score: str = "importance") -> DataFrame:
    """Total importance per statistic, measure, location and dimension, largest first.

    A foot sensor has no measure and no dimension, so it adds to the other two only.
    """
    parts = component_columns(col(name))
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), parts[c].alias("value")) for c in COMPONENTS])
    return (
        importances.select(col(score).alias("_score"), F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("component", "value")
        .agg(F.sum("_score").alias("importance"))
        .orderBy("component", F.desc("importance"), "value")
    )


def name_components(names: DataFrame, name: str = "feature") -> DataFrame:
    """Distinct (component, value) pairs named by a column of feature names."""
    parts = component_columns(col(name))
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), parts[c].alias("value")) for c in COMPONENTS])
    return names.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()


def regression_histogram(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The three series of the prediction histogram, as ``(series, low, high, count)`` rows.

    ``actual`` counts each true value (low = high = the value). ``binned`` counts predictions in
    bins whose mid-points are the true values; edges lie half-way between neighbours, the last bin
    is closed, predictions outside are left out. ``fine`` counts predictions in 120 equal bins over
    their own range, each as often as 120 holds the number of edges.

    Predictions are counted per distinct value first, so a value that a third of the rows share is
    one row; neighbours and bins are found with running sums, not with a window over all values.
    """
    rows = df.filter(col(label).isNotNull())
    truth = rows.groupBy(col(label).cast("double").alias("value")).agg(F.count("*").alias("n"))
    indexed = materialise(running_sum(truth, F.col("value"), "_i"))
    n_values = indexed.count()
    if n_values < 2:
        raise ValueError("the histogram needs at least two distinct true values")

    # Upper edge of value i: half-way to value i + 1; the outer edges mirror their neighbours.
    following = indexed.select((F.col("_i") - 1).alias("_i"), F.col("value").alias("_next"))
    preceding = indexed.select((F.col("_i") + 1).alias("_i"), F.col("value").alias("_previous"))
    value = F.col("value")
    bins = materialise(
        indexed.join(following, "_i", "left")
        .join(preceding, "_i", "left")
        .select(
            "_i",
            F.coalesce((F.col("_previous") + value) / 2, value - (F.col("_next") - value) / 2).alias("low"),
            F.coalesce((value + F.col("_next")) / 2, value + (value - F.col("_previous")) / 2).alias("high"),
            (F.col("_i") == n_values).alias("_last"),
        )
    )

    predicted = materialise(
        rows.filter(col(prediction).isNotNull())
        .groupBy(col(prediction).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    # Sweep over lower edges and predictions together: the number of edges so far is the bin. An
    # edge sorts before a prediction of the same value. The closed end of the last bin is an exact match.
    sweep = bins.select(F.col("low").alias("value"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("n"))
    sweep = sweep.unionByName(predicted.select("value", F.lit(1).alias("_kind"), "n"))
    located = running_sum(sweep, F.col("value"), "_i", F.when(F.col("_kind") == 0, 1).otherwise(0), ties=["_kind"])
    # Predictions below the first edge have bin 0; above the last edge they are dropped by the join.
    in_bin = (
        located.filter("_kind = 1")
        .join(bins, "_i")
        .filter((F.col("value") < F.col("high")) | (F.col("_last") & (F.col("value") == F.col("high"))))
        .groupBy("_i")
        .agg(F.sum("n").alias("n"))
    )

    span = predicted.agg(F.min("value").alias("least"), F.max("value").alias("most")).first()
    actual = indexed.select(
        F.lit("actual").alias("series"), value.alias("low"), value.alias("high"), F.col("n").alias("count")
    )
    binned = bins.join(in_bin, "_i", "left").select(
        F.lit("binned").alias("series"), "low", "high", F.coalesce("n", F.lit(0)).alias("count")
    )
    return actual.unionByName(binned).unionByName(_fine_histogram(predicted, span, FINE_BINS // (n_values + 1)))


def _fine_histogram(predicted: DataFrame, span: Row, repeats: int) -> DataFrame:
    least, most = span["least"], span["most"]
    if least is None:
        least, most = 0.0, 1.0
    elif least == most:
        least, most = least - 0.5, most + 0.5
    width = (most - least) / FINE_BINS
    value = F.col("value")

    def edge(i: Column) -> Column:
        return F.when(i == FINE_BINS, F.lit(most)).otherwise(F.lit(least) + i * F.lit(width))

    # The quotient may miss by one bin at an edge; the edges decide.
    guess = F.least(F.floor((value - F.lit(least)) / F.lit(width)), F.lit(FINE_BINS - 1).cast("long"))
    place = (
        F.when(value < edge(guess), guess - 1)
        .when((value >= edge(guess + 1)) & (guess < FINE_BINS - 1), guess + 1)
        .otherwise(guess)
    )
    counts = predicted.groupBy(place.alias("_b")).agg(F.sum("n").alias("n"))
    bins = predicted.sparkSession.range(FINE_BINS).select(F.col("id").alias("_b"))
    return bins.join(counts, "_b", "left").select(
        F.lit("fine").alias("series"),
        edge(F.col("_b")).alias("low"),
        edge(F.col("_b") + 1).alias("high"),
        (F.coalesce("n", F.lit(0)) * F.lit(repeats)).alias("count"),
    )
