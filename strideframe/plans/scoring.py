"""Apply a saved model to unseen features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, INCLINE, KEYS, SPEED, col
from strideframe.operators.metrics import classification_scores, confusion_matrix, label_list, regression_scores
from strideframe.plans.training import PREDICTION, model_features, with_target
from strideframe.sources.tables import append_ledger, path_parent, path_stem, read_features


def ledger_row(scores: DataFrame, feature: str, model_path: str, features_path: str) -> DataFrame:
    """Ledger row of one scored set; the file and the run are named after their paths."""
    run = path_parent(F.lit(model_path))
    if feature == ACTIVITY:
        score, rmse, plot = F.col("accuracy"), F.lit(None).cast("double"), F.concat(run, F.lit("_cm"))
    else:
        score, rmse, plot = F.col("r2"), F.col("rmse"), F.lit(None).cast("string")
    return scores.select(
        path_stem(F.lit(features_path)).alias("val_data"),
        run.alias("run_id"),
        F.lit(feature).alias("feature"),
        score.alias("score"),
        plot.alias("plot_path"),
        rmse.alias("rmse"),
    )


def apply_model(
    features: DataFrame, feature: str, model_path: str, features_path: str, ledger_path: str | None = None
) -> dict[str, DataFrame]:
    """Score a saved model: ``result`` (a ledger row) and, for ACTIVITY, ``confusion``.

    The saved pipeline holds the scaler and the column order, so extra or re-ordered columns do no
    harm. Rows without a target are left out for SPEED and INCLINE.
    """
    if feature not in (ACTIVITY, SPEED, INCLINE):
        raise ValueError(f"unknown feature {feature!r}")
    model = PipelineModel.load(model_path)
    rows = features if feature == ACTIVITY else with_target(features, feature)
    known = [c for c in rows.columns if c in KEYS]
    predicted = model.transform(rows.select(*[col(c) for c in [*known, *model_features(model)]]))
    result: dict[str, DataFrame] = {}
    if feature == ACTIVITY:
        scores = classification_scores(predicted, feature, PREDICTION)
        result["confusion"] = confusion_matrix(predicted, label_list(features), feature, PREDICTION)
    else:
        scores = regression_scores(predicted, feature, PREDICTION)
    result["result"] = ledger_row(scores, feature, model_path, features_path)
    if ledger_path is not None:
        append_ledger(result["result"], ledger_path)
    return result


def apply_model_file(spark, features_path: str, feature: str, model_path: str, ledger_path: str | None = None):
    """:func:`apply_model` on a stored feature table."""
    return apply_model(read_features(spark, features_path), feature, model_path, features_path, ledger_path)
