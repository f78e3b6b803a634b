"""Ingest in batches: new recordings get the next trial numbers, those of earlier batches keep theirs.

Below one path lie ``interim/batch=<n>`` (samples) and ``trials/batch=<n>`` (a row per trial: the ledger). The ledger's part is written
last, so its marker commits the batch: a batch that was cut off is written again, one that ended is not, and
readers see only batches that ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, INCLINE, SPEED, TIME, TRIAL, channel_columns, col
from strideframe.sources.recordings import FILE_KEY, ingest_parts, trial_files
from strideframe.storage import committed_below, is_committed, lookup_join, materialise

TRIALS_SCHEMA = (
    "participant string, filename string, participant_no long, TRIAL int, ACTIVITY string, INCLINE smallint, SPEED float"
)


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that ended, in order."""
    return sorted(int(f.rsplit("=", 1)[1]) for f in committed_below(spark, f"{path}/trials"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A row per trial of all batches, with ``batch``."""
    done = batches(spark, path)
    base = f"{path}/trials"
    if not done:
        return spark.createDataFrame([], f"{TRIALS_SCHEMA}, batch int")
    folders = [f"{base}/batch={n}" for n in done]
    return spark.read.schema(f"{TRIALS_SCHEMA}, batch int").option("basePath", base).parquet(*folders)


def read_interim(spark: SparkSession, path: str) -> DataFrame:
    """The interim table of all batches, with ``batch``: a batch is a partition, so a job can read new ones only."""
    folders = [f"{path}/interim/batch={n}" for n in batches(spark, path)]
    return spark.read.option("basePath", f"{path}/interim").parquet(*folders)


def ingest_increment(
    samples: DataFrame, path: str, batch: int, skip_participants: Sequence[int] = (), **options
) -> DataFrame:
    """Add the recordings of ``samples`` that no earlier batch holds; returns the ledger of all trials.

    ``samples`` may hold earlier recordings again: a file is known by participant and file name, and known files
    are left out before any sample is shuffled. New ones are numbered among themselves as an ingest does, from
    the first free number on. The first batch settles the channels; later ones are laid on its columns. A batch without
    new recordings adds none. Batches are given in order; the number of one that ended changes nothing.
    """
    spark = samples.sparkSession
    path = path.rstrip("/")
    if is_committed(spark, f"{path}/trials/batch={batch}"):
        return read_trials(spark, path)
    known = materialise(read_trials(spark, path))
    files = materialise(samples.select(*FILE_KEY).distinct())
    fresh = materialise(trial_files(files, skip_participants).join(known, FILE_KEY, "left_anti").select(*FILE_KEY))
    target = f"{path}/trials/batch={batch}"
    if fresh.isEmpty():
        spark.createDataFrame([], TRIALS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(target)
        return read_trials(spark, path)
    wanted = lookup_join(samples, fresh, FILE_KEY, [F.col("frame"), F.col("label")], "left_semi")
    first = known.agg(F.coalesce(F.max(TRIAL) + 1, F.lit(0))).first()[0]
    filled = [n for n in batches(spark, path) if is_committed(spark, f"{path}/interim/batch={n}")]
    if filled and "channels" not in options:
        options["channels"] = channel_columns(spark.read.parquet(f"{path}/interim/batch={filled[0]}").columns)
    made = ingest_parts(wanted, skip_participants, first_trial=first, **options)
    made.table.write.mode("overwrite").parquet(f"{path}/interim/batch={batch}")
    rows = made.trials.select(*FILE_KEY, col("participant_no").cast("long").alias("participant_no"), TRIAL, ACTIVITY, INCLINE, SPEED)
    rows.coalesce(1).write.mode("overwrite").parquet(target)
    return read_trials(spark, path)


def trial_extents(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with what each trial holds: frames and last TIME."""
    held = read_interim(spark, path).groupBy(TRIAL).agg(F.count("*").alias("frames"), F.max(TIME).alias("last_time"))
    return read_trials(spark, path).join(held, TRIAL)
