"""Feature extraction: rolling statistics, checks and labels in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, INCLINE, SPEED, TIME, TRIAL, channel_columns, col
from strideframe.operators.checks import (
    assert_schema,
    check_time_resets,
    feature_schema,
    full_channel_list,
    join_facts,
    trial_facts,
)
from strideframe.operators.rolling import DEFAULT_STATS, rolling_stats
from strideframe.storage import materialise


def feature_extraction(
    df: DataFrame,
    period: int = 300,
    stats: Sequence[str] = DEFAULT_STATS,
    validate_schema: bool = True,
    ties: Sequence[str] = (),
    method: str = "arrow",
) -> DataFrame:
    """Feature table of an interim table: one row per sample from the first full window on.

    Raises ``ValueError`` where TIME does not restart with a trial, or, with ``validate_schema``,
    where the result is not the table of the full sensor set.

    The interim table is read twice: a few columns for the per-trial facts, then all channels for
    the windows, which shuffle once. Labels are looked up without another shuffle.
    """
    channels = [c for c in channel_columns(df.columns) if c not in ties]
    facts = materialise(trial_facts(df, ties=ties))
    check_time_resets(facts)
    rolled = rolling_stats(df, channels, period, stats, ties=ties, method=method)
    labelled = join_facts(rolled, facts)
    features = labelled.select(
        col(TRIAL).cast("int").alias(TRIAL),
        F.col(TIME).cast("long").alias(TIME),
        *[col(f"{s}_{c}") for c in channels for s in stats],
        col(ACTIVITY),
        col(SPEED).cast("double").alias(SPEED),
        col(INCLINE).cast("long").alias(INCLINE),
    )
    if validate_schema:
        assert_schema(features, feature_schema(full_channel_list(), DEFAULT_STATS))
    return features
