"""Intermediate tables as Parquet in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strideframe.storage import scratch_path


def stored(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, columns that are not asked for are not read,
    and a small table comes back in a few partitions, however many it was computed in. ``kept``: as in ``scratch_path``."""
    path = scratch_path(df.sparkSession, name, kept)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
