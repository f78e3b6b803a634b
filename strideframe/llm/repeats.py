"""Removal of repeated passages with suffix arrays over shards of the corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or
in the same one before. Texts are UTF-8 bytes; matches never cross documents and are judged on the input.

Sharding. Every window of ``LENGTH`` bytes has an anchor, the place of its smallest hash of ``GRAM`` bytes (the
leftmost of equals). Equal windows have equal anchors at equal places, so windows are dealt out by the anchor's hash, and
neighbouring windows with one anchor travel as one segment; every window is in exactly one. Anchors met once in
the corpus are left out before any text moves, and of whole copies only the first document takes part.
Equal segments are summed up before they move, so a passage shared by any number of documents arrives once. Each shard is a bounded text: its suffix array is
built by induced sorting, and the permuted common prefixes of ``LENGTH`` or more mark equal windows. An anchor with
more than ``MOST_SEGMENTS`` different segments does not fit such a shard: its windows are dealt out one by one,
by 128-bit hashes.

Null texts are empty; texts under ``LENGTH`` bytes lose nothing. Documents are cut into pieces of bounded length for anchors only; windows do
not stop at pieces. Rows without an id come before all others. Rows that repeat an id and a text are one document,
and get equal results. Different texts with one id, or without, are different documents: of those the smaller place is
the earlier one, of equal places the one in the text with the smaller digest. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stored import stored
from strideframe.llm.suffixes import permuted_prefixes, suffix_array
from strideframe.storage import materialise, passing_tables

LENGTH = 100
GRAM = 32

#: Bytes whose anchors are found together; a place must fit into 24 bits, and the arrays into a core's cache.
PIECE = 1 << 16

#: Bytes in a shard (about), and the different segments of an anchor that a shard takes.
SHARD_BYTES = 1 << 20
MOST_SEGMENTS = 20_000

#: Ids (8 bytes each) up to which a measured set of documents is broadcast.
BROADCAST_IDS = 2_000_000

NO_ID = -(2**63)


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each place on, the same wherever they stand: windows of twice the
    length are put together from their halves."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n, size = len(data), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            n -= size
            h = (h[:n] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[size : size + n] >> np.uint64(29)) + h[size : size + n]
            size *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each place on: running minima of blocks, forth and back."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forth = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of all runs of windows inside the texts starts..ends."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(np.uint64), none, none
    grams = _grams(data)
    place = np.uint64((1 << 24) - 1)
    marked = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(marked, LENGTH - GRAM + 1) & place).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[starts[long]] = True  # texts may touch: a window that starts a text starts a run
    first = np.flatnonzero(new)
    owner = np.searchsorted(starts, first, "right") - 1
    stop = np.minimum(np.r_[first[1:], len(anchor)], ends[owner] - LENGTH + 1)
    return grams[anchor[first]], first, stop - first


def _pieces(ids: list, texts: list[bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, data, starts, ends) of texts put together up to ``PIECE`` bytes; a longer text comes in
    pieces that share ``LENGTH`` - 1 bytes, so that every window is in one of them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple:
        lengths = np.array([len(p) for _, _, p in held], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        return [i for i, _, _ in held], np.array([o for _, o, _ in held], np.int64), data, ends - lengths, ends

    for i, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE + LENGTH:
                yield flush()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield flush()


def _binary(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.to_pylist()]


def anchors(rows: DataFrame) -> DataFrame:
    """(anchor, key, twin, at, run): all runs of (key, twin, data) rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for rows_, offsets, data, starts, ends in _pieces(list(range(part.num_rows)), _binary(part.column(2))):
                    anchor, first, run = anchored_runs(data, starts, ends)
                    owner = np.searchsorted(starts, first, "right") - 1
                    row = pa.array(np.array(rows_, np.int64)[owner])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor.view(np.int64)),
                            part.column(0).take(row),
                            part.column(1).take(row),
                            pa.array(first - starts[owner] + offsets[owner]),
                            pa.array(run.astype(np.int32)),
                        ],
                        ["anchor", "key", "twin", "at", "run"],
                    )

    return rows.mapInArrow(found, "anchor long, key long, twin string, at long, run int")


def segments(rows: DataFrame) -> DataFrame:
    """(anchor, d1, d2, segment, key, twin, at): segments cut from (key, twin, data, runs) rows, with their 128-bit digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts, runs = part.column(2).to_pylist(), part.column(3).flatten()
                row = np.repeat(np.arange(len(texts)), part.column(3).value_lengths().to_numpy())
                at = runs.field("at").to_numpy()
                ends = at + runs.field("run").to_numpy() + LENGTH - 1
                pieces = [texts[r][a:b] for r, a, b in zip(row.tolist(), at.tolist(), ends.tolist(), strict=True)]
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">u8").reshape(-1, 2).astype(np.uint64)
                halves = (digests ^ np.uint64(1 << 63)).view(np.int64)
                key, twin = part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [runs.field("anchor"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(pieces, pa.binary()), key, twin, pa.array(at)],
                    ["anchor", "d1", "d2", "segment", "key", "twin", "at"],
                )

    return rows.mapInArrow(cut, "anchor long, d1 long, d2 long, segment binary, key long, twin string, at long")


def later_windows(shard: pd.DataFrame) -> pd.DataFrame:
    """(key, twin, at, end): bytes of windows in a shard's segments that stand earlier in another segment."""
    pieces = shard["segment"].tolist()
    n = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(n + 1) - (n + 1)
    s = np.zeros(int((n + 1).sum()), np.int16)  # 0 separates
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    s[np.arange(len(joined)) + np.repeat(np.arange(len(n)), n)] = joined.astype(np.int16) + 1
    found = suffix_array(s, LENGTH)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    within = np.arange(len(s)) - starts[owner]
    window = n[owner] - within >= LENGTH
    common = permuted_prefixes(s, found, LENGTH, np.flatnonzero(window))
    ordered = found[window[found]]
    # windows equal to the one before; between them stand no other suffixes
    group = np.cumsum(common[ordered] < LENGTH)
    key, at = shard["key"].to_numpy()[owner[ordered]], shard["at"].to_numpy()[owner[ordered]] + within[ordered]
    twins = shard["twin"].to_numpy()
    twin = np.unique(twins.astype(str), return_inverse=True)[1][owner[ordered]]
    age = np.empty(len(ordered), np.int64)
    age[np.lexsort((twin, at, key))] = np.arange(len(ordered))
    if not len(ordered):
        return pd.DataFrame({"key": [], "twin": [], "at": [], "end": []}, dtype="int64").astype({"twin": str})
    _, cuts = np.unique(group, return_index=True)
    oldest = np.minimum.reduceat(age, cuts)
    later = age > np.repeat(oldest, np.diff(np.r_[cuts, len(ordered)]))
    marked = np.zeros(len(s) + 1, bool)
    marked[ordered[later]] = True
    edge = np.flatnonzero(np.diff(np.r_[False, marked]))
    first, last = edge[::2], edge[1::2]
    # runs of one segment: windows of two segments never touch, a segment's last bytes start none
    base = shard["at"].to_numpy()[owner[first]] - starts[owner[first]]
    key, twin = shard["key"].to_numpy()[owner[first]], twins[owner[first]]
    return pd.DataFrame({"key": key, "twin": twin, "at": base + first, "end": base + last - 1 + LENGTH})


def _window_rows(rows: DataFrame) -> DataFrame:
    """(w1, w2, key, twin, at): every window of the segments, by 128-bit hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                out = []
                for piece, key, twin, at in zip(*(c.to_pylist() for c in batch.slice(i, 2000).columns), strict=True):
                    for j in range(len(piece) - LENGTH + 1):
                        d = xxhash.xxh3_128_intdigest(piece[j : j + LENGTH])
                        out.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), key, twin, at + j))
                names = ["w1", "w2", "key", "twin", "at"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.select("segment", "key", "twin", "at").mapInArrow(cut, "w1 long, w2 long, key long, twin string, at long")


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "key", how)


def _keyed(docs: DataFrame, record_id: str, text: str, *more: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{record_id}`").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"),
        *more,
    )


def _told_apart(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` with ``twin``: the digest of texts without an id and of those that share the id with ``several`` texts,
    empty for all others, whose id says which text it is."""
    own = F.col("key") == NO_ID
    if not several.isEmpty():
        small = several.count() <= BROADCAST_IDS
        marks = several.withColumn("_several", F.lit(True))
        rows = rows.join(F.broadcast(marks) if small else marks, "key", "left")
        own = own | F.col("_several").isNotNull()
    return rows.select("key", F.when(own, F.md5("data")).otherwise(F.lit("")).alias("twin"), "data")


def repeated_spans(docs: DataFrame, record_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, spans): ``copies`` (key, digest) are documents that go as a whole, since their text stands earlier;
    ``spans`` (key, digest, spans) has the other documents' repeated stretches, in no order and overlapping."""
    with passing_tables(docs.sparkSession):
        return _repeated_spans(docs, record_id, text)


def _repeated_spans(docs: DataFrame, record_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = _keyed(docs, record_id, text)
    digest = F.md5("data")
    base = materialise(rows.select("key", digest.alias("digest"), (F.octet_length("data") >= LENGTH).alias("long")))
    # minima, not sets: a third of all rows may have no id
    several = base.where(F.col("key") != NO_ID).groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = materialise(several.where("low <> high").select("key"))
    counted = materialise(base.where("long").groupBy("key", "digest").agg(F.count("*").alias("k")))
    base = counted.select("key", "digest")
    oldest = base.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stored(base.join(oldest, "digest").where("key <> first").select("key", "digest"), "copies", kept=True)
    whole = rows.where(F.octet_length("data") >= LENGTH)
    if not copies.isEmpty():
        small = copies.count() <= BROADCAST_IDS
        gone = F.broadcast(copies) if small else copies
        whole = whole.withColumn("digest", digest).join(gone, ["key", "digest"], "left_anti").drop("digest")
    again = counted.where("k > 1").select("key", "digest")
    if not again.isEmpty():
        once = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
        whole = whole.withColumn("digest", digest)
        first = whole.join(once, ["key", "digest"], "left_semi").groupBy("key", "digest").agg(F.first("data").alias("data"))
        whole = whole.join(once, ["key", "digest"], "left_anti").select("key", "data").union(first.select("key", "data"))
    whole = _told_apart(whole, several)

    runs = anchors(whole)
    often = runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    with passing_tables(docs.sparkSession):
        met = stored(runs.join(often, "anchor"), "runs")
        per_document = met.groupBy("key", "twin").agg(F.collect_list(F.struct("anchor", "at", "run")).alias("runs"))
        ids = materialise(met.select("key").distinct())
        cut = _among(whole, ids, "left_semi").join(per_document, ["key", "twin"]).select("key", "twin", "data", "runs")
        occurrences = stored(segments(cut), "segments", kept=True)

    same = ["anchor", "d1", "d2"]
    oldest = occurrences.groupBy(*same).agg(F.min(F.struct("key", "at", "twin", "segment")).alias("o"))
    distinct = stored(oldest.select(*same, "o.*"), "distinct")
    first = distinct.select(*same, *[F.col(c).alias(f"first_{c}") for c in ("key", "twin", "at")])
    again = occurrences.withColumn("end", F.col("at") + F.octet_length("segment")).drop("segment").join(first, same)
    again = again.where("key <> first_key or at <> first_at or twin <> first_twin").select("key", "twin", "at", "end")

    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("segment")).alias("bytes"))
    per_anchor = materialise(per_anchor.where("n > 1"))
    bytes_ = per_anchor.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-bytes_ // SHARD_BYTES))
    shared = distinct.join(per_anchor.select("anchor", "n"), "anchor")
    in_shards = shared.where(F.col("n") <= MOST_SEGMENTS).withColumn("shard", F.pmod("anchor", F.lit(shards)))
    later = in_shards.select("shard", "segment", "key", "twin", "at").groupBy("shard")
    later = later.applyInPandas(later_windows, "key long, twin string, at long, end long")
    spans = again.union(later)
    if not per_anchor.where(F.col("n") > MOST_SEGMENTS).isEmpty():
        windows = stored(_window_rows(shared.where(F.col("n") > MOST_SEGMENTS)), "windows")
        eldest = windows.groupBy("w1", "w2").agg(F.min(F.struct("key", "at", "twin")).alias("o"))
        rest = windows.join(eldest, ["w1", "w2"]).where("key <> o.key or at <> o.at or twin <> o.twin")
        spans = spans.union(rest.select("key", "twin", "at", (F.col("at") + LENGTH).alias("end")))
    spans = stored(spans.groupBy("key", "twin").agg(F.collect_list(F.struct("at", "end")).alias("spans")), "spans")
    alone = spans.where("twin = ''").join(base, "key").select("key", "digest", "spans")
    return copies, stored(alone.union(spans.where("twin <> ''").select("key", "twin", "spans")), "spans", kept=True)


def without_spans(texts: list[bytes], spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(bytes that go, maximal runs of them, bytes that stay) of each text. Spans overlap and come in any order; a text
    without any may have null."""
    counts = np.array([n or 0 for n in spans.value_lengths().to_pylist()], np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths + 1) - (lengths + 1)  # all texts in one line, with a place between them
    flat = spans.flatten()
    at, end = flat.field("at").to_numpy() + base[row], flat.field("end").to_numpy() + base[row]
    order = np.argsort(at)
    at, reach, row = at[order], np.maximum.accumulate(end[order]), row[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > reach[:-1]
    first, row = at[new], row[new]
    last = reach[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] if len(at) else first
    gone = np.zeros(len(texts), np.int64)
    np.add.at(gone, row, last - first)
    parts: list[list[bytes]] = [[] for _ in texts]
    done = [0] * len(texts)
    for r, a, b in zip(row.tolist(), (first - base[row]).tolist(), (last - base[row]).tolist(), strict=True):
        parts[r].append(texts[r][done[r] : a])
        done[r] = b
    kept = [b"".join([*p, t[d:]]) for p, t, d in zip(parts, texts, done, strict=True)]
    return gone, np.bincount(row, minlength=len(texts)), kept


def with_kept_bytes(
    docs: DataFrame, record_id: str = "doc_id", text: str = "text", as_text: bool = False
) -> DataFrame:
    """``docs`` as a struct ``_row`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` or, with
    ``as_text``, ``kept`` (a character of which bytes went goes as a whole).

    Only texts that lose a part meet their spans in a shuffle; the others are passed on where they are.
    """
    copies, spans = repeated_spans(docs, record_id, text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if as_text else F.struct(F.col(f"`{record_id}`"))
    rows = _keyed(docs, record_id, text, row.alias("_row"))
    changed = materialise(spans.select("key").distinct())
    kind = "string" if as_text else "binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = _binary(part["data"])
                gone, runs, left = without_spans(texts, part["spans"])
                kept = [x.decode(errors="ignore") if as_text else hashlib.sha256(x).digest() for x in left]
                numbers = [pa.array([len(t) for t in texts], pa.int64()), pa.array(gone), pa.array(runs.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [part["_row"], *numbers, pa.array(kept, kind)], ["_row", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    size = F.octet_length("data").cast("long")
    schema = rows.select("_row").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    some = _among(rows, changed, "left_semi").withColumn("digest", F.md5("data"))
    others = _among(rows, changed, "left_anti").withColumn("digest", F.md5("data"))
    gone = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    marked = gone.withColumn("copy", F.lit(True)).distinct()
    flag = lambda df: df.join(marked, ["key", "digest"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    some, others = flag(some), flag(others)
    partly = some.where("not copy").join(spans, ["key", "digest"], "left").select("_row", "data", "spans").mapInArrow(cut, schema.add("kept", kind))
    rest = others.unionByName(some.where("copy"))
    left = F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("data"))
    rest = rest.select(
        "_row",
        size.alias("n_bytes"),
        F.when(F.col("copy"), size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.col("copy").cast("long").alias("n_spans"),
        (left.cast("string") if as_text else F.unhex(F.sha2(left, 256))).alias("kept"),
    )
    out = partly.unionByName(rest)
    return out if as_text else out.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")


def without_repeats(docs: DataFrame, record_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; a null text stays null, and no row goes."""
    out = with_kept_bytes(docs, record_id, text, as_text=True)
    given = F.col(f"_row.`{text}`")
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != text]
    kept = F.when(given.isNotNull(), F.col("kept")).alias(text)
    return out.select(*columns, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
