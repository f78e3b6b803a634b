"""Checks on trial tables: time resets, label look-up, schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions.names import LABELS, TIME, TRIAL, col
from strideframe.storage import lookup_join, materialise


def trial_facts(df: DataFrame, columns: Sequence[str] = LABELS, ties: Sequence[str] = ()) -> DataFrame:
    """One row per trial: its first TIME and the labels of its last sample.

    A partial aggregate over a few columns, so a hot trial is reduced before the shuffle.
    """
    last = F.max_by(F.struct(*[col(c) for c in columns]), F.struct(F.col(TIME), *[col(t) for t in ties]))
    facts = df.groupBy(TRIAL).agg(F.min(TIME).cast("long").alias("first_time"), last.alias("_labels"))
    return facts.select(TRIAL, "first_time", "_labels.*")


def time_reset_offenders(starts: DataFrame) -> DataFrame:
    """Trials that follow trial ``n - 1`` but do not start at TIME 0, with their first TIME.

    ``starts`` holds ``first_time`` per trial. The predecessor is found by an equi-join, so a long
    list of trials does not meet a single task.
    """
    followers = starts.select((F.col(TRIAL) + 1).cast(starts.schema[TRIAL].dataType).alias(TRIAL))
    late = starts.filter("first_time <> 0").select(TRIAL, "first_time")
    return late.join(followers, TRIAL, "left_semi")


def check_time_resets(starts: DataFrame) -> None:
    """Raise ``ValueError`` unless TIME restarts at 0 wherever TRIAL steps by one."""
    bad = time_reset_offenders(starts).orderBy(TRIAL).take(5)
    if bad:
        shown = ", ".join(f"trial {r[TRIAL]} starts at {r['first_time']}" for r in bad)
        raise ValueError(f"trials should start at TIME 0, but {shown}")


def reattach_labels(
    features: DataFrame, samples: DataFrame, columns: Sequence[str] = LABELS, ties: Sequence[str] = ()
) -> DataFrame:
    """Add each trial's labels, taken from its samples, to the feature rows."""
    return join_facts(features, materialise(trial_facts(samples, columns, ties)))


def join_facts(features: DataFrame, facts: DataFrame) -> DataFrame:
    """Look up the labels of each row's trial."""
    return lookup_join(features, facts.drop("first_time"), [TRIAL], [F.col(TIME)], "inner")


def schema_difference(df: DataFrame, expected: T.StructType) -> list[tuple[str, str]]:
    """(name, type) pairs found on one side only; column order and nullability do not count."""
    have = {(f.name, f.dataType.simpleString()) for f in df.schema}
    want = {(f.name, f.dataType.simpleString()) for f in expected}
    return sorted(have ^ want)


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Raise ``ValueError`` with the difference unless the schemas agree; no job is run."""
    difference = schema_difference(df, expected)
    if difference:
        raise ValueError(f"columns found or expected on one side only: {difference}")
    return df


def feature_schema(channels: Sequence[str], stats: Sequence[str]) -> T.StructType:
    """Schema of a feature table: keys, ``{stat}_{channel}`` doubles, labels."""
    fields = [T.StructField(TRIAL, T.IntegerType()), T.StructField(TIME, T.LongType())]
    fields += [T.StructField(f"{s}_{c}", T.DoubleType()) for c in channels for s in stats]
    fields += [
        T.StructField("ACTIVITY", T.StringType()),
        T.StructField("SPEED", T.DoubleType()),
        T.StructField("INCLINE", T.LongType()),
    ]
    return T.StructType(fields)


def full_channel_list() -> list[str]:
    """All channels of the sensor set: every measure at every body location in three dimensions,
    and one pressure channel per foot sensor."""
    # Body locations and foot pressure channels of the full sensor set.
    measures = ["global angle", "highg", "accel", "gyro", "mag"]
    places = ["pelvis", "foot_l", "foot_r", "shank_l", "shank_r", "thigh_l", "thigh_r"]
    feet = ["left foot sensor.lfs", "right foot sensor.rfs"]
    return feet + [f"{m}_{p}.{d}" for p in places for m in measures for d in ["x", "y", "z"]]
