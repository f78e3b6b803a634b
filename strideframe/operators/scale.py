"""Standardisation fitted on the training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.names import col, q


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and scale per column from one pass over the training rows.

    The scale is the population deviation, 1 for a constant column. The driver receives two numbers
    per column, however many rows there are.
    """
    moments = [F.struct(F.avg(col(c)), F.stddev_pop(col(c))) for c in columns]
    row = train.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    scaler = {}
    for i, c in enumerate(columns):
        mean, deviation = row[i]
        if mean is None:
            raise ValueError(f"no training values in column {c!r}")
        scaler[c] = (float(mean), float(deviation) if deviation else 1.0)
    return scaler


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise the scaler's columns, leave the others."""
    return df.select(
        *[((col(c) - scaler[c][0]) / scaler[c][1]).alias(c) if c in scaler else col(c) for c in df.columns]
    )


def scaler_stage(scaler: dict[str, tuple[float, float]], prefix: str) -> SQLTransformer:
    """The scaler as a pipeline stage that is saved with its model; scaled columns get ``prefix``."""
    scaled = [f"(({q(c)} - {mean!r}D) / {scale!r}D) AS {q(prefix + c)}" for c, (mean, scale) in scaler.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")
