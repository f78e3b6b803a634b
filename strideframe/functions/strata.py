"""Stratum keys of the sequential split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions.names import col


def stratum_key(columns: Sequence[str]) -> Column:
    """One column is its own key, NULL included; several are joined as text with NULL as ``''``.

    ``concat_ws`` alone would skip a NULL and let (a, NULL, b) meet (a, b, NULL).
    """
    if len(columns) == 1:
        return col(columns[0])
    return F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])
