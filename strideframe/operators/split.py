"""Sequential stratified train/test split, and the check that both parts look alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, TIME, TRIAL, col
from strideframe.functions.strata import stratum_key
from strideframe.storage import lookup_join, materialise, serialised_bytes

#: Rows around a boundary that are put in order; a wider stretch of TIME is narrowed down first.
ORDERED_ROWS = 1_000_000
#: Cells a stretch of TIME is cut into when it is narrowed down.
CELLS = 1_024
#: Trials whose counts are summed together.
TRIAL_SPAN = 1_024

TRAIN, TEST, GAP = "train", "test", "gap"


def sequential_split(
    df: DataFrame,
    train_size: float,
    gap: int = 0,
    strata: Sequence[str] = (ACTIVITY,),
    ties: Sequence[str] = (),
    out: str = "part",
) -> DataFrame:
    """Add ``out``: ``train``, ``test`` or ``gap`` for each row, in (TRIAL, TIME, ties) order.

    Within each stratum the first ``int(train_size * n)`` rows are for training; the cut then moves
    to the end of the trial it falls in, unless that is the stratum's last trial, which is shared.
    ``gap`` rows behind the cut go to neither part. Rows whose single stratum column is NULL are
    dropped; of several columns NULL counts as an empty text.

    No row is numbered to find its part. Rows are counted per (stratum, trial); the counts give the
    trials in which the boundaries fall. In those, counts per cell of TIME narrow a boundary down to
    a short stretch, and only its rows are put in order. Every row of the table then just compares
    its (TRIAL, TIME, ties, hash of the row) with its stratum's two boundary rows, so the wide table
    is neither shuffled nor sorted. Rows that ``ties`` leave equal are in the order of their hashes.
    Only where a boundary falls between equal rows, these are numbered.
    """
    if not 0 <= train_size <= 1:
        raise ValueError(f"train_size is a share of the rows, from 0 to 1; {train_size} is not")

    keyed = df.withColumn("_key", stratum_key(strata)).filter("_key is not null")
    keyed = keyed.withColumn("_hash", F.xxhash64(*[col(c) for c in df.columns]))
    order = [TRIAL, TIME, *ties, "_hash"]
    narrow = keyed.select("_key", *[col(c) for c in order])  # the hash is read for boundary rows only

    counts = materialise(
        narrow.groupBy("_key", TRIAL).agg(
            F.count("*").alias("_rows"), F.min(TIME).cast("long").alias("_low"), F.max(TIME).cast("long").alias("_high")
        )
    )
    trials = _trial_offsets(counts)
    cuts = materialise(_cuts(trials, train_size, gap))
    short = cuts.filter("_test_from > _total").orderBy("_key").take(3)
    if short:
        raise ValueError(f"gap of {gap} rows reaches beyond the end of {[r['_key'] for r in short]}")

    edges = materialise(_boundary_rows(narrow, trials, cuts, order))
    row = _row_key(order)
    placed = lookup_join(keyed, edges, ["_key"], [F.col(TRIAL), F.col(TIME)], "inner")
    columns = [col(c) for c in df.columns]
    if edges.filter("_cut_into > 0 or _test_into > 0").isEmpty():
        return placed.select(*columns, _part(row).alias(out))
    shared = ((F.col("_cut_into") > 0) & (row == F.col("_cut"))) | ((F.col("_test_into") > 0) & (row == F.col("_test")))
    shared = F.coalesce(shared, F.lit(False))
    equal = Window.partitionBy("_key", *[col(c) for c in order]).orderBy("_hash")
    numbered = placed.filter(shared).withColumn("_place", F.row_number().over(equal) - 1)
    rest = placed.filter(~shared).select(*columns, _part(row).alias(out))
    return rest.union(numbered.select(*columns, _part(row, F.col("_place")).alias(out)))


def _part(row: Column, place: Column | None = None) -> Column:
    """Part of a row, for one of several equal rows by its ``place`` among them."""
    before, behind = row < F.col("_cut"), row >= F.col("_test")
    if place is not None:
        before = before | ((row == F.col("_cut")) & (place < F.col("_cut_into")))
        behind = (row > F.col("_test")) | ((row == F.col("_test")) & (place >= F.col("_test_into")))
    return (
        F.when(F.col("_cut").isNull() | before, F.lit(TRAIN))
        .when(F.col("_test").isNotNull() & behind, F.lit(TEST))
        .otherwise(F.lit(GAP))
    )


def _row_key(order: Sequence[str]) -> Column:
    return F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order)])


def _trial_offsets(counts: DataFrame) -> DataFrame:
    """Rows of the stratum before each trial, summed in two levels so no window holds all trials."""
    trials = counts.withColumn("_bucket", F.floor(F.col(TRIAL) / F.lit(TRIAL_SPAN)).cast("long"))
    stratum = Window.partitionBy("_key")
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        trials.groupBy("_key", "_bucket")
        .agg(F.sum("_rows").alias("_bucket_rows"), F.max(TRIAL).alias("_bucket_last"))
        .select(
            "_key",
            "_bucket",
            F.coalesce(F.sum("_bucket_rows").over(before), F.lit(0)).alias("_bucket_from"),
            F.sum("_bucket_rows").over(stratum).alias("_total"),
            F.max("_bucket_last").over(stratum).alias("_last_trial"),
        )
    )
    inside = Window.partitionBy("_key", "_bucket").orderBy(TRIAL).rowsBetween(Window.unboundedPreceding, -1)
    return (
        trials.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(buckets, ["_key", "_bucket"])
        .withColumn("_from", F.col("_bucket_from") + F.col("_inside"))
        .select("_key", TRIAL, "_rows", "_low", "_high", "_from", "_total", "_last_trial")
    )


def _cuts(trials: DataFrame, train_size: float, gap: int) -> DataFrame:
    """Per stratum: row count, position of the first row behind training, of the first test row."""
    k = F.floor(F.lit(float(train_size)) * F.col("_total")).cast("long")
    end = F.col("_from") + F.col("_rows")
    holds = (F.col("_from") <= k) & (k < end)
    moved = F.max(F.when(holds & (F.col(TRIAL) != F.col("_last_trial")), end))
    return (
        trials.groupBy("_key", "_total")
        .agg(moved.alias("_moved"))
        .withColumn("_cut_at", F.coalesce("_moved", k))
        .select("_key", "_total", "_cut_at", (F.col("_cut_at") + gap).alias("_test_from"))
    )


def _boundary_rows(narrow: DataFrame, trials: DataFrame, cuts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Order key of the rows at the two boundary positions, NULL for a position behind the last row, and how many equal
    rows are before each of them."""
    wanted = F.array(
        F.struct(F.lit("_cut").alias("which"), F.col("_cut_at").alias("at")),
        F.struct(F.lit("_test").alias("which"), F.col("_test_from").alias("at")),
    )
    positions = cuts.select("_key", F.explode(wanted).alias("_p")).select("_key", "_p.which", "_p.at")
    # Every table of boundaries has at most two rows per stratum, some numbers wider than these.
    size = 4 * serialised_bytes(positions)
    inside = (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_from") + F.col("_rows"))
    stretches = materialise(
        lookup_join(trials, positions, ["_key"], [F.col(TRIAL)], "inner", size=size)
        .filter(inside)
        .select("_key", TRIAL, "which", (F.col("at") - F.col("_from")).alias("_place"), "_low", "_high", "_rows")
    )
    while not stretches.filter((F.col("_rows") > ORDERED_ROWS) & (F.col("_low") < F.col("_high"))).isEmpty():
        stretches = materialise(_narrowed(narrow, stretches, size))

    numbered = Window.partitionBy("_key", TRIAL, "which").orderBy(*[col(c) for c in order])
    hits = (
        _rows_in(narrow, stretches, size)
        .withColumn("_number", F.row_number().over(numbered))
        .withColumn("_into", F.col("_number") - F.rank().over(numbered))
        .filter(F.col("_number") == F.col("_place") + 1)
        .withColumn("_row", _row_key(order))
    )
    found = hits.groupBy("_key").agg(
        F.max(F.when(F.col("which") == "_cut", F.col("_row"))).alias("_cut"),
        F.max(F.when(F.col("which") == "_test", F.col("_row"))).alias("_test"),
        F.max(F.when(F.col("which") == "_cut", F.col("_into"))).alias("_cut_into"),
        F.max(F.when(F.col("which") == "_test", F.col("_into"))).alias("_test_into"),
    )
    return cuts.select("_key").join(found, "_key", "left")


def _rows_in(narrow: DataFrame, stretches: DataFrame, size: int) -> DataFrame:
    """Rows of the stretches, once per boundary."""
    near = lookup_join(narrow, stretches, ["_key", TRIAL], [F.col(TIME)], "inner", size=size)
    return near.filter(F.col(TIME).between(F.col("_low"), F.col("_high")))


def _narrowed(narrow: DataFrame, stretches: DataFrame, size: int) -> DataFrame:
    """Each stretch cut down to the cell of TIME its place falls into."""
    width = F.col("_high") - F.col("_low") + 1
    cell = F.floor((F.col(TIME) - F.col("_low")) * F.lit(CELLS) / width).cast("long")
    boundary = ["_key", TRIAL, "which", "_place"]
    cells = (
        _rows_in(narrow, stretches, size)
        .groupBy(*boundary, cell.alias("_cell"))
        .agg(
            F.count("*").alias("_rows"), F.min(TIME).cast("long").alias("_low"), F.max(TIME).cast("long").alias("_high")
        )
    )
    # At most CELLS rows per boundary.
    earlier = Window.partitionBy(*boundary).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    inside = (F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_rows"))
    return placed.filter(inside).select(
        "_key", TRIAL, "which", (F.col("_place") - F.col("_before")).alias("_place"), "_low", "_high", "_rows"
    )


def part_proportions(df: DataFrame, column: str, part: str = "part") -> DataFrame:
    """Share of each value of ``column`` in the train and in the test part, NULL included."""
    counts = df.filter(col(part).isin(TRAIN, TEST)).groupBy(col(part).alias("part"), col(column)).agg(
        F.count("*").alias("_n")
    )
    # Two rows, one per part.
    totals = counts.groupBy("part").agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(totals), "part").select(
        "part", col(column), (F.col("_n") / F.col("_all")).alias("proportion")
    )


def split_balance(df: DataFrame, column: str, part: str = "part", threshold: float = 0.05) -> DataFrame:
    """Values whose shares of the train and the test part differ by more than ``threshold``.

    Values found in one part only, and NULLs, are not compared.
    """
    shares = part_proportions(df, column, part)
    train = shares.filter(F.col("part") == TRAIN).select(col(column), "proportion")
    test = shares.filter(F.col("part") == TEST).select(col(column), F.col("proportion").alias("proportion_test"))
    return (
        train.join(test, column)
        .withColumn("diff", F.abs(F.col("proportion") - F.col("proportion_test")))
        .filter(F.col("diff") > threshold)
    )


def compare_balance(y_test: DataFrame, y_train: DataFrame, threshold: float = 0.05) -> DataFrame:
    """:func:`split_balance` of two single-column tables."""
    if [(f.name, f.dataType) for f in y_test.schema] != [(f.name, f.dataType) for f in y_train.schema]:
        raise ValueError(f"cannot compare {y_test.schema.simpleString()} with {y_train.schema.simpleString()}")
    column = y_test.columns[0]
    both = y_train.withColumn("part", F.lit(TRAIN)).unionByName(y_test.withColumn("part", F.lit(TEST)))
    return split_balance(both, column, "part", threshold)
