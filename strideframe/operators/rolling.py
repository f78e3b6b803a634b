"""Rolling statistics per trial over the last ``period`` milliseconds of TIME."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions.names import TIME, TRIAL, col, feature_name
from strideframe.operators.frames import frame_bounds, frame_statistics

# The statistics a caller may ask for, and the default choice.
STATS = ("min", "max", "mean", "std", "first", "last")
DEFAULT_STATS = ("min", "max", "mean", "std")

#: Milliseconds of a trial one group of samples spans, and its least length in periods.
CHUNK_SPAN = 16_384
CHUNK_PERIODS = 16

#: Samples the Arrow method works on at a time; a chunk is never cut.
BATCH_ROWS = 32_768

_BLOCK, _CHUNK, _OWN = "_block", "_chunk", "_own"


def rolling_stats(
    df: DataFrame,
    channels: Sequence[str],
    period: int,
    stats: Sequence[str] = DEFAULT_STATS,
    ties: Sequence[str] = (),
    keep: Sequence[str] = (),
    full_windows: bool = True,
    method: str = "arrow",
    chunk_span: int | None = None,
) -> DataFrame:
    """``{stat}_{channel}`` over the frame ``(t - period, t]`` on integer TIME, per TRIAL.

    Rows of equal TIME are all inside each other's frame. NULL samples are skipped by min, max,
    mean and std (sample form) and kept by first and last, which need ``ties`` where TIME repeats.
    With ``full_windows`` rows before the first full window (TIME < period - 1) are dropped.

    All methods cut a trial into chunks of TIME and hand each chunk the last ``period - 1``
    milliseconds of the one before, so a long trial is spread over tasks and there is one shuffle.
    ``arrow`` lets Spark shuffle and sort the chunks and computes the frames on whole Arrow batches;
    ``plain`` uses Spark's moving frame, which reads a whole frame per row: right for short periods;
    ``blocked`` stays in the JVM and takes time linear in the rows whatever the period.
    ``chunk_span``, in units of TIME, is rounded up to whole periods; set it where samples are much
    denser or sparser than one per unit, as a chunk and the period before it meet in one task.
    """
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}, expected some of {list(STATS)}")
    if period < 1:
        raise ValueError(f"period must be at least 1, but got {period}")
    methods = {"arrow": _arrow, "plain": _plain, "blocked": _blocked}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}, expected one of {sorted(methods)}")

    needed = list(dict.fromkeys([TRIAL, TIME, *ties, *keep, *channels]))
    samples = df.select(*[_sample(c) if c in channels else col(c) for c in needed])
    chunked = _with_chunks(samples, period, chunk_span or max(CHUNK_SPAN, CHUNK_PERIODS * period))
    result = methods[method](chunked, list(channels), period, list(stats), list(ties), full_windows)
    out = [feature_name(stat, channel) for channel in channels for stat in stats]
    head = list(dict.fromkeys([TRIAL, TIME, *keep]))
    return result.select(*[col(c) for c in head], *[col(c) for c in out])


def _sample(channel: str) -> Column:
    """Samples are doubles; NaN is a missing sample."""
    return F.nanvl(col(channel).cast("double"), F.lit(None).cast("double")).alias(channel)


def _with_chunks(df: DataFrame, period: int, chunk_span: int) -> DataFrame:
    """Copy each chunk's last ``period - 1`` milliseconds into the next chunk, then shuffle once."""
    span = period * max(1, -(-chunk_span // period))
    chunk = F.floor(F.col(TIME) / F.lit(span)).cast("long")
    in_tail = F.pmod(F.col(TIME), F.lit(span)) > span - period
    places = F.when(in_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return (
        df.withColumn(_CHUNK, F.explode(places))
        .withColumn(_OWN, F.col(_CHUNK) == chunk)
        .repartition(F.col(TRIAL), F.col(_CHUNK))
    )


def _sample_key(ties: Sequence[str], channel: Column) -> Column:
    """Sample with its place in time: ordered by TIME, then the tie-break, then the value."""
    return F.struct(F.col(TIME).alias("t"), *[col(t).alias(f"k{i}") for i, t in enumerate(ties)], channel.alias("v"))


def _arrow(
    df: DataFrame, channels: list[str], period: int, stats: list[str], ties: list[str], full_windows: bool
) -> DataFrame:
    # mapInArrow resolves columns by bare name, so dotted names are numbered on the way through.
    names = [feature_name(stat, channel) for channel in channels for stat in stats]
    passed = [c for c in df.columns if c not in channels and c not in (_CHUNK, _OWN)]
    inside = {c: f"_p{i}" for i, c in enumerate(passed)} | {c: f"_c{i}" for i, c in enumerate(channels)}
    outside = {f"_p{i}": c for i, c in enumerate(passed)} | {f"_f{i}": name for i, name in enumerate(names)}
    numbered = df.select(*[col(c).alias(inside.get(c, c)) for c in df.columns])
    fields = [T.StructField(inside[c], df.schema[c].dataType) for c in passed]
    fields += [T.StructField(f"_f{i}", T.DoubleType()) for i in range(len(names))]
    trial_name, time_name = inside[TRIAL], inside[TIME]

    def roll(table: pa.Table) -> pa.Table:
        trial, chunk, time = (table[c].to_numpy() for c in (trial_name, _CHUNK, time_name))
        starts = np.concatenate([[False], (trial[1:] != trial[:-1]) | (chunk[1:] != chunk[:-1])])
        low, high = frame_bounds(np.cumsum(starts), time, period)
        wanted = table[_OWN].to_numpy(zero_copy_only=False)
        if full_windows:
            wanted = wanted & (time > period - 2)
        rows = np.flatnonzero(wanted)
        columns = [table[inside[c]].take(pa.array(rows)) for c in passed]
        for channel in channels:
            values = table[inside[channel]].to_numpy(zero_copy_only=False)
            columns += [pa.array(r[rows], from_pandas=True) for r in frame_statistics(values, low, high, stats)]
        return pa.table(columns, names=list(outside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches, trial_name, _CHUNK):
            yield from roll(table).to_batches()

    ordered = numbered.sortWithinPartitions(trial_name, _CHUNK, time_name, *[inside[t] for t in ties])
    rolled = ordered.mapInArrow(run, T.StructType(fields))
    return rolled.select(*[F.col(i).alias(name) for i, name in outside.items()])


def _whole_chunks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Regroup a sorted partition into tables of about ``BATCH_ROWS`` rows that end with a chunk."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held)
        values = [table[key].to_numpy() for key in keys]
        earlier = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
        cut = int(earlier[-1]) + 1 if len(earlier) else 0
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def _plain(
    df: DataFrame, channels: list[str], period: int, stats: list[str], ties: list[str], full_windows: bool
) -> DataFrame:
    frame = Window.partitionBy(TRIAL, _CHUNK).orderBy(TIME).rangeBetween(-(period - 1), 0)
    makers = {
        "min": lambda c: F.min(col(c)).over(frame),
        "max": lambda c: F.max(col(c)).over(frame),
        "mean": lambda c: F.avg(col(c)).over(frame),
        "std": lambda c: F.stddev_samp(col(c)).over(frame),
        "first": lambda c: F.min(_sample_key(ties, col(c))).over(frame)["v"],
        "last": lambda c: F.max(_sample_key(ties, col(c))).over(frame)["v"],
    }
    rolled = {feature_name(s, c): makers[s](c) for c in channels for s in stats}
    kept = F.col(_OWN) & (F.col(TIME) > period - 2) if full_windows else F.col(_OWN)
    return df.select("*", *[value.alias(name) for name, value in rolled.items()]).filter(kept)


def _blocked(
    df: DataFrame, channels: list[str], period: int, stats: list[str], ties: list[str], full_windows: bool
) -> DataFrame:
    """Two growing windows instead of one moving window.

    TIME is cut into blocks of ``period``; a frame touches its own block and the one before. The
    first window aggregates from the start of the block up to the row. Every row then also becomes
    a probe at the first millisecond of its frame, and the second window aggregates each block from
    its end back to the probe. The two parts of the frame do not overlap and are merged.
    """
    parts = _part_aggregates(stats, ties)
    block = F.floor(F.col(TIME) / F.lit(period)).cast("long")
    head = (
        Window.partitionBy(TRIAL, _CHUNK, _BLOCK).orderBy(TIME).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    prefixed = df.withColumn(_BLOCK, block).select(
        "*",
        *[
            make(col(c)).over(head).alias(f"_head{i}_{part}")
            for i, c in enumerate(channels)
            for part, make in parts.items()
        ],
    )

    wanted = F.col(_OWN) & (F.col(TIME) > period - 2) if full_windows else F.col(_OWN)
    kinds = F.when(wanted, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    records = prefixed.withColumn("_probe", F.explode(kinds)).withColumn(
        "_at", F.when(F.col("_probe"), F.col(TIME) - F.lit(period - 1)).otherwise(F.col(TIME))
    )
    records = records.withColumn("_at_block", F.floor(F.col("_at") / F.lit(period)).cast("long"))
    tail = (
        Window.partitionBy(TRIAL, _CHUNK, "_at_block")
        .orderBy(F.desc("_at"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sample = ~F.col("_probe")
    other_block = F.col("_at_block") < F.col(_BLOCK)
    suffixed = records.select(
        "*",
        *[
            make(F.when(sample, col(c)), sample).over(tail).alias(f"_tail{i}_{part}")
            for i, c in enumerate(channels)
            for part, make in parts.items()
        ],
    ).filter("_probe")

    merged = []
    for i, channel in enumerate(channels):
        heads = {part: F.col(f"_head{i}_{part}") for part in parts}
        tails = {part: F.when(other_block, F.col(f"_tail{i}_{part}")) for part in parts}
        merged += [_merge(stat, heads, tails).alias(feature_name(stat, channel)) for stat in stats]
    return suffixed.select("*", *merged)


def _part_aggregates(stats: list[str], ties: list[str]) -> dict:
    """Mergeable aggregates the statistics need; ``present`` hides the probe's own NULL sample."""

    def key(v: Column, present: Column | None) -> Column:
        keyed = _sample_key(ties, v)
        return keyed if present is None else F.when(present, keyed)

    every = {
        "min": ({"min"}, lambda v, p=None: F.min(v)),
        "max": ({"max"}, lambda v, p=None: F.max(v)),
        "n": ({"mean", "std"}, lambda v, p=None: F.count(v)),
        "mean": ({"mean", "std"}, lambda v, p=None: F.avg(v)),
        "var": ({"std"}, lambda v, p=None: F.var_pop(v)),
        "first": ({"first"}, lambda v, p=None: F.min(key(v, p))),
        "last": ({"last"}, lambda v, p=None: F.max(key(v, p))),
    }
    return {part: make for part, (users, make) in every.items() if users & set(stats)}


def _merge(stat: str, head: dict[str, Column], tail: dict[str, Column]) -> Column:
    """Combine the two parts of a frame; a part without samples is NULL and drops out."""
    if stat == "min":
        return F.least(head["min"], tail["min"])
    if stat == "max":
        return F.greatest(head["max"], tail["max"])
    if stat == "first":
        return F.least(head["first"], tail["first"])["v"]
    if stat == "last":
        return F.greatest(head["last"], tail["last"])["v"]

    n_head, n_tail = F.coalesce(head["n"], F.lit(0)), F.coalesce(tail["n"], F.lit(0))
    n = n_head + n_tail
    mean_head, mean_tail = F.coalesce(head["mean"], F.lit(0.0)), F.coalesce(tail["mean"], F.lit(0.0))
    if stat == "mean":
        return F.when(n > 0, (mean_head * n_head + mean_tail * n_tail) / n)
    # Pairwise merge of (n, mean, sum of squared deviations).
    shift = mean_tail - mean_head
    squares = (
        F.coalesce(head["var"] * n_head, F.lit(0.0))
        + F.coalesce(tail["var"] * n_tail, F.lit(0.0))
        + F.when(n > 0, shift * shift * n_head * n_tail / n).otherwise(0.0)
    )
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
