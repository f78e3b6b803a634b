"""Run a registered query and its SQL counterpart on the same tables and compare all values."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(r[i]).__name__, _plain(r[i])) for i in order) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and values agree, else a short description."""
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    have = [tuple(r) for r in spark_df.collect()]
    if sorted(spark_df.columns) != sorted(want_names):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_names)}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)}"
    a, b = _rows(spark_df.columns, have), _rows(want_names, want)
    if a != b:
        only_a, only_b = a - b, b - a
        return f"{sum(only_a.values())} rows differ, e.g.\n  {next(iter(only_a))}\n  {next(iter(only_b))}"
    return None
