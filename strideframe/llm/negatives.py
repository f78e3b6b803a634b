"""Hard negatives: exact integer scores of anchors against all rows by Kronecker-packed products.

The components of several candidates are biased to be non-negative and laid into separate fields of one wide number;
one product per anchor component then advances the scores of all of them, and the fields are cut apart again. A
field is as wide as the largest possible score of the tile needs, so no carry crosses into the next. Where two or
more fields fit into 53 bits the wide numbers are doubles, whose products and sums of whole numbers are exact there; elsewhere
they are Python's integers.

Anchors are dealt into groups of bounded size and candidates into parts; a task reads a group's anchors and then streams the part's
candidates in tiles, keeping the best few per anchor. Scores beyond 64 bits are held at the limit.
Rows without an id, label or vector, and vectors with null or non-finite components, take no part. Vectors
are compared with those of their own length. Equal rows count once; rows that share an anchor's id are neither its positives
nor its negatives. Ties go to the smaller id. Empty tables, and anchors without positives or negatives, give no rows.
Columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.stored import stored
from strideframe.llm.topk import whole_components

#: Anchors of a group (at most, about), least candidates of a part, scores held at once.
GROUP_ANCHORS = 16_384
PART_ROWS = 8_192
TILE_SCORES = 4_000_000

#: Bits in which doubles are exact, largest score up to which 64-bit arithmetic is safe, fields of a wider number.
EXACT_BITS = 53
SAFE_BITS = 56
WIDE_FIELDS = 8

LEAST, MOST = -(2**63) + 1, 2**63 - 1
NONE = -(2**63)


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products (anchors x candidates) of whole numbers held as doubles, as 64-bit integers."""
    (m, width), n = anchors.shape, len(candidates)
    if not m or not n or not width:
        return np.zeros((m, n), np.int64)
    a_low, c_low = int(anchors.min()), int(candidates.min())
    a_span, c_span = int(anchors.max()) - a_low, int(candidates.max()) - c_low
    field = max(1, (width * a_span * c_span).bit_length())
    largest = width * max(abs(a_low), abs(a_low + a_span)) * max(abs(c_low), abs(c_low + c_span))
    narrow = field <= EXACT_BITS and largest < 2**SAFE_BITS
    if not narrow:
        anchors, candidates = _integers(anchors), _integers(candidates)
    fields = EXACT_BITS // field if narrow else WIDE_FIELDS
    biased = np.zeros((-(-n // fields) * fields, width), candidates.dtype)
    biased[:n] = candidates - c_low
    scale = [2 ** (field * k) for k in range(fields)]
    wide = sum(biased[k::fields] * s for k, s in enumerate(scale))
    products = (anchors - a_low) @ wide.T
    products = products.astype(np.int64) if narrow else products
    scores = np.empty((m, len(biased)), products.dtype)
    for k in range(fields):
        scores[:, k::fields] = (products >> (field * k)) & (2**field - 1)
    kind = np.int64 if narrow else object
    a_sum, c_sum = anchors.sum(1).astype(kind), candidates.sum(1).astype(kind)
    scores = scores[:, :n] + (c_low * a_sum)[:, None] + (a_low * c_sum)[None, :] - width * a_low * c_low
    return scores if narrow else np.clip(scores, LEAST, MOST).astype(np.int64)


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


class Best:
    """The first ``k`` (score descending, id ascending) of each slot, over all tiles."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.worst = np.full(slots, NONE)
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row per slot named, ``NONE`` where a candidate does not count."""
        kth = self.worst[slots]
        if scores.shape[1] > self.k:
            kth = np.maximum(kth, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((scores >= kth[:, None]) & (scores != NONE))
        if not len(row):
            return
        slot = np.concatenate([self.slot, slots[row]])
        score = np.concatenate([self.score, scores[row, column]])
        found = np.concatenate([self.id, ids[column]])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        begins = np.r_[True, slot[1:] != slot[:-1]]
        rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(begins, np.arange(len(slot)), 0))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], found[kept]
        full = rank == self.k - 1
        self.worst[slot[full]] = score[full]


class Positives:
    """The best rows of the anchors' own label."""

    schema = "anchor long, vec_id long, score long"

    def __init__(self, anchors: pa.RecordBatch, k: int):
        self.rows, self.ids, self.vectors = _column(anchors, "row"), _column(anchors, "vec_id"), _vectors(anchors)
        self.best = Best(len(self.rows), k)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = packed_scores(self.vectors, vectors)
        scores[self.ids[:, None] == ids[None, :]] = NONE
        self.best.add(np.arange(len(self.rows)), scores, ids)

    def found(self) -> dict[str, np.ndarray]:
        return {"anchor": self.rows[self.best.slot], "vec_id": self.best.id, "score": self.best.score}


class Negatives:
    """The best rows of other labels whose scores lie within the band that each positive allows."""

    schema = "anchor long, positive_id long, positive_score long, vec_id long, score long"

    def __init__(self, anchors: pa.RecordBatch, k: int, band: tuple[int, int]):
        """A row of ``anchors`` is an anchor with one of its positives."""
        self.rows, self.ids = _column(anchors, "row"), _column(anchors, "vec_id")
        self.labels = np.array(anchors.column("label").to_pylist(), object)
        self.positive_ids, self.positive_scores = _column(anchors, "positive_id"), _column(anchors, "positive_score")
        # scores are whole, so the band's ends may be rounded inwards
        self.low = _limits(-(-band[0] * int(s) // 100) for s in self.positive_scores)
        self.high = _limits(band[1] * int(s) // 100 for s in self.positive_scores)
        _, first, self.anchor = np.unique(self.rows, return_index=True, return_inverse=True)
        self.first, self.vectors = first, _vectors(anchors.take(pa.array(first)))
        self.best = Best(len(self.rows), k)
        self.ranks = [np.nonzero(_rank(self.anchor) == i)[0] for i in range(int(_rank(self.anchor).max(initial=-1)) + 1)]

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = packed_scores(self.vectors, vectors)
        scores[self.labels[self.first][:, None] == labels[None, :]] = NONE
        scores[self.ids[self.first][:, None] == ids[None, :]] = NONE
        for slots in self.ranks:  # the i-th positive of every anchor that has as many
            own = scores[self.anchor[slots]]
            outside = (own < self.low[slots][:, None]) | (own > self.high[slots][:, None])
            self.best.add(slots, np.where(outside, NONE, own), ids)

    def found(self) -> dict[str, np.ndarray]:
        slot = self.best.slot
        return {
            "anchor": self.rows[slot],
            "positive_id": self.positive_ids[slot],
            "positive_score": self.positive_scores[slot],
            "vec_id": self.best.id,
            "score": self.best.score,
        }


def _limits(values: Iterator[int]) -> np.ndarray:
    return np.array([max(LEAST, min(MOST, v)) for v in values], np.int64)


def _rank(groups: np.ndarray) -> np.ndarray:
    """Number of each element among those of its group, in the given order."""
    order = np.argsort(groups, kind="stable")
    begins = np.r_[True, groups[order][1:] != groups[order][:-1]][: len(groups)]
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.arange(len(groups)) - np.maximum.accumulate(np.where(begins, np.arange(len(groups)), 0))
    return rank


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def _searched(task: Callable[[pa.RecordBatch], Positives | Negatives], schema: pa.Schema) -> Callable:
    """A function over sorted batches: per key first the anchors, then the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, search = None, [], None
        for piece in _pieces(batches):
            name = piece.column("key")[0].as_py()
            if name != key:
                if search is not None:
                    yield pa.RecordBatch.from_pydict(search.found(), schema)
                key, anchors, search = name, [], None
            if piece.column("kind")[0].as_py() == 0:
                anchors.append(piece)
                continue
            if search is None and anchors:
                search, anchors = task(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]), []
            if search is not None:
                tile = max(64, TILE_SCORES // max(1, len(search.rows)))
                for begin in range(0, piece.num_rows, tile):
                    part = piece.slice(begin, tile)
                    labels = np.array(part.column("label").to_pylist(), object)
                    search.add(_column(part, "vec_id"), labels, _vectors(part))
        if search is not None:
            yield pa.RecordBatch.from_pydict(search.found(), schema)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where key or kind changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, kinds = batch.column("key").to_numpy(zero_copy_only=False), _column(batch, "kind")
        cuts = np.nonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]))[0] + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(part.split()[0], pa.int64()) for part in schema.split(", ")])


def _search(asked: DataFrame, rows: DataFrame, by: list[Column], groups: int, parts: int, kind: type, make: Callable) -> DataFrame:
    """Every group of ``asked`` against every part of ``rows`` with the same values of ``by``."""
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    key = F.concat_ws("|", "part", "group", *by).alias("key")
    extra = [c for c in asked.columns if c not in rows.columns]
    a = asked.withColumns({"group": F.pmod(F.xxhash64("row"), F.lit(groups)), "part": every(parts)})
    c = rows.withColumns({"part": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)), "group": every(groups)})
    columns = ["row", "vec_id", "label", "v"]
    both = a.select(key, F.lit(0).alias("kind"), *columns, *extra).unionByName(
        c.select(key, F.lit(1).alias("kind"), *columns, *[F.lit(None).cast("long").alias(e) for e in extra])
    )
    tasks = max(1, min(groups * parts * 4, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return both.repartition(tasks, "key").sortWithinPartitions("key", "kind").mapInArrow(_searched(make, _arrow(kind.schema)), kind.schema)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``is_anchor`` holds for and each of its ``positives`` best rows of the same label: the best
    ``negatives`` rows of other labels whose scores are ``band[0]`` to ``band[1]`` per cent of the positive's.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        whole_components(F.col(f"`{embedding}`")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("vec_id is not null and label is not null and v is not null")
    rows = rows.groupBy("vec_id", "label", "v").agg(F.max("asks").alias("asks"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives_rows")
    n, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    groups = max(1, -(-asking // GROUP_ANCHORS))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-n // PART_ROWS), -(-4 * width // groups)))
    columns = rows.select("row", "vec_id", "label", "v")
    anchors = rows.where("asks").select("row", "vec_id", "label", "v")
    near = _search(
        anchors, columns, [F.size("v"), F.col("label")], groups, parts, Positives, lambda a: Positives(a, positives)
    )
    # one row could come from two rows that share an id
    near = near.groupBy("anchor", "vec_id").agg(F.max("score").alias("score"))
    near = _first(near, ["anchor"], positives).select(
        F.col("anchor").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = stored(anchors.join(near, "row"), "negatives_pairs")
    far = _search(pairs, columns, [F.size("v")], groups, parts, Negatives, lambda a: Negatives(a, negatives, band))
    far = far.groupBy("anchor", "positive_id", "positive_score", "vec_id").agg(F.max("score").alias("score"))
    best = _first(far, ["anchor", "positive_id"], negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(ids, "anchor").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
