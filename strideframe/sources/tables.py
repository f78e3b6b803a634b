"""Feature tables, importances, run records and the validation ledger on disk."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.storage import is_committed

LEDGER_SCHEMA = "val_data string, run_id string, feature string, score double, plot_path string, rmse double"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table; Spark reads only the columns a job uses."""
    return spark.read.parquet(path)


def write_features(features: DataFrame, path: str) -> DataFrame:
    """Write the feature table where its rows are, and read it back with its lineage cut."""
    features.write.mode("overwrite").parquet(path)
    return read_features(features.sparkSession, path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """``{feature: score}`` JSON objects to (feature, importance) rows; names may hold dots."""
    text = spark.read.text(path, wholetext=True)
    scores = F.from_json("value", "map<string,double>")
    return text.select(F.explode(scores).alias("feature", "importance"))


def write_importances(importances: DataFrame, path: str) -> None:
    """One JSON object per run: as many entries as the model has features, largest first."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "feature", "importance")))
    scores = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["feature"], e["importance"])))
    importances.agg(F.to_json(scores).alias("value")).write.mode("overwrite").text(path)


def write_run(run: DataFrame, path: str) -> None:
    run.coalesce(1).write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def run_record(spark: SparkSession, run_name: str, score: Mapping, params: Mapping) -> DataFrame:
    """One row: the scores and the parameters of a run."""
    hyperparams = {k: json.dumps(v) for k, v in params["hyperparams"].items()}
    row = (
        run_name,
        tuple(score.get(k) for k in SCORE_NAMES),
        (
            params["window"],
            params["split"],
            params["statistic"],
            params["measure"],
            params["location"],
            params["dimension"],
            hyperparams,
        ),
    )
    scores = ", ".join(f"{name}: double" for name in SCORE_NAMES)
    lists = ", ".join(f"{name}: array<string>" for name in ("statistic", "measure", "location", "dimension"))
    schema = (
        f"run string, score struct<{scores}>, "
        f"params struct<window: int, split: double, {lists}, hyperparams: map<string, string>>"
    )
    return spark.createDataFrame([row], schema)


# Names of the scores in a run record.
SCORE_NAMES = ("activity", "activity_weighted", "speed_r2", "speed_rmse", "incline_r2", "incline_rmse")


def read_hyperparameters(spark: SparkSession, path: str) -> dict[str, dict]:
    """``{family: {setting: value}}`` from one JSON object; settings Spark's learners lack do no harm."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def path_stem(path: Column) -> Column:
    """Last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def path_parent(path: Column) -> Column:
    """Name of the folder a path lies in."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def append_ledger(row: DataFrame, path: str) -> DataFrame:
    """Add a result row; earlier rows are not read or rewritten. Returns the whole ledger."""
    row.coalesce(1).write.mode("append").option("header", "true").csv(path)
    return read_ledger(row.sparkSession, path)


def record_once(row: DataFrame, path: str, key: Sequence[str] = ("run_id", "val_data", "feature")) -> DataFrame:
    """Add a result row under its key, once: a retried or repeated append changes nothing. Returns the whole ledger.

    Each key has a folder, named by its digest. An append that was cut off left no marker there (and nothing readers see)
    and is written again; one that ended left the marker and is not.
    """
    spark = row.sparkSession
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])), 256)
    (entry,) = [r[0] for r in row.select(digest).collect()]
    folder = f"{path.rstrip('/')}/entry={entry}"
    if not is_committed(spark, folder):
        row.coalesce(1).write.mode("overwrite").option("header", "true").csv(folder)
    return read_ledger(spark, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows, whether appended or recorded once."""
    rows = spark.read.schema(LEDGER_SCHEMA).option("header", "true").option("recursiveFileLookup", "true")
    return rows.csv(path)
