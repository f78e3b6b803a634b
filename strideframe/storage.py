"""Where intermediate tables go, and when a table may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Serialised size up to which a lookup table is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Least and most copies of every lookup row when the table is too large to broadcast.
LOOKUP_SALTS = (16, 256)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, but only by a local session: on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strideframe-"))
        current = sc.getCheckpointDir()
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Paths given out inside the open ``passing_tables`` blocks, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("_passing", default=())


def scratch_path(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A fresh path below the shared folder for a table a job writes and reads back. With ``kept`` it outlives the
    innermost block of ``passing_tables``."""
    path = f"{shared_dir(spark).rstrip('/')}/strideframe/{name}-{uuid.uuid4().hex}"
    blocks = _passing.get()[:-1] if kept else _passing.get()
    if blocks:
        blocks[-1].append(path)
    return path


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables whose paths are given out inside go at the end, but for those that are ``kept``: what is used
    afterwards must read those alone."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table of this session's jobs."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to ``path`` came to its end: its last act is the marker ``_SUCCESS``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def committed_below(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path`` whose jobs came to their end, by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath().toString() for s in files.listStatus(folder) if s.isDirectory()]
    return sorted(f for f in found if is_committed(spark, f))


def serialised_bytes(df: DataFrame) -> int:
    """Measured size of a table: one aggregate over its rows."""
    row_size = F.octet_length(F.to_json(F.struct("*"))) + F.lit(16)
    return df.agg(F.coalesce(F.sum(row_size), F.lit(0))).first()[0]


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: list[Column],
    how: str = "left",
    max_bytes: int | None = None,
    size: int | None = None,
) -> DataFrame:
    """Join many ``rows`` with a ``table`` holding few rows per key.

    The table's size is measured (``table`` is then best materialised), or given where a bound is
    already known: below ``max_bytes`` it is broadcast and the rows stay where they are. Above, the
    table is copied ``LOOKUP_SALTS`` times, more with more shuffle partitions, and the rows of a key
    are spread over the copies by a hash of ``spread_by``, so that one hot key does not end up in one
    task; adaptive execution may split what is still skewed. Both ways give the same rows.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    if (serialised_bytes(table) if size is None else size) <= limit:
        return rows.join(F.broadcast(table), on, how)
    least, most = LOOKUP_SALTS
    salts = min(most, max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")
