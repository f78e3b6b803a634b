"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are dealt into blocks by a keyed hash. A source's target is turned into an exact quota
of blocks: whole passes over the source, then a part of one more pass. The quotas are split recursively among
the output shards: a node halves its shards and draws how many blocks of each source go left from the
multivariate hypergeometric law, so that leaves have equal numbers of blocks and each source's quota is met
exactly. A keyed permutation of the blocks says which block is drawn when; draws are disjoint within a pass.
The block in which a source's target falls is cut at the document nearest to it. Documents are then shuffled within
their shard by another keyed hash.

What the driver holds is one number per source, shard and block position, not per document. A null source is a
source of its own, last in order. Null and empty texts have no words; they are dealt like others and add nothing.
Equal rows share their hash and are taken alike. An empty table gives an empty result. The
same rows, seed and parameters give the same mix. Columns of the input are left as they are; ``mixed`` returns them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.storage import materialise

#: ASCII white space separates words.
SPACES = "[\\x20\\x09-\\x0D]+"

#: Blocks per source. A block of a source with a third of 100 billion documents has 32 million of them, which are never
#: sorted together: only the one block a target falls into is cut, by ranges of its hash.
BLOCKS = 1024


#: Sources up to which the drawn blocks (a few bytes each, ``BLOCKS`` per source) are broadcast.
BROADCAST_SOURCES = 1000


def water_level(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to weights that sum to ``share`` of all sizes, none above ``most`` times its size;
    what a source cannot take is shared among the others by weight."""
    targets = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
            open_.remove(i)
    return targets


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): columns sum to the quotas, rows differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    random = np.random.default_rng(seed)

    def split(first: int, last: int, blocks: np.ndarray) -> None:
        if last - first == 1:
            out[first] = blocks
            return
        middle = (first + last) // 2
        total = int(blocks.sum())
        share = total * (middle - first) // (last - first)
        left = random.multivariate_hypergeometric(blocks, share, method="marginals") if total else blocks * 0
        split(first, middle, left)
        split(middle, last, blocks - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def permutation(block: Column, source: Column, turn: Column, seed: int) -> Column:
    """A keyed permutation of 0..BLOCKS-1 (a power of two): odd multiplier, offset."""
    key = F.xxhash64(source, turn, F.lit(seed))
    odd = key.bitwiseAND(F.lit(BLOCKS - 1)) * 2 + 1
    start = F.shiftright(key, 20).bitwiseAND(F.lit(BLOCKS - 1))
    return (block * odd + start).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def _rows(docs: DataFrame, record_id: str, source: str, text: str, seed: int, kept: list[str]) -> DataFrame:
    # the text tells rows without an id, or with one id, apart
    hashed = F.xxhash64(F.col(f"`{record_id}`"), F.col(f"`{text}`"), F.lit(seed))
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES), "")
    columns = [
        F.col(f"`{record_id}`").alias("_id"),
        F.col(f"`{source}`").alias("_source"),
        F.size(words).cast("long").alias("_size"),
        hashed.bitwiseAND(F.lit(BLOCKS - 1)).cast("int").alias("_block"),
        F.shiftrightunsigned(hashed, 10).alias("_fine"),
    ]
    if kept:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    return docs.select(*columns)


def _last_document(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(_source, _block, limit): documents of a cut block up to this hash come nearest to what is left.

    The block is narrowed to a thousandth by sums over ranges of the hash before documents are put in order.
    """
    coarse = F.shiftrightunsigned("_fine", 44)
    inside = rows.join(F.broadcast(cut), F.expr("_source <=> cut_source and _block = cut_block"))
    ranges = inside.groupBy("cut_source", "cut_block", "left", coarse.alias("part")).agg(F.sum("_size").alias("words"))
    before = Window.partitionBy("cut_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    found = materialise(
        ranges.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).select(
            "cut_source", "cut_block", "part", (F.col("left") - F.col("before")).alias("left")
        )
    )
    match = F.expr("_source <=> cut_source and _block = cut_block") & (coarse == F.col("part"))
    some = rows.join(F.broadcast(found), match).groupBy("cut_source", "cut_block", "part", "left", "_fine")
    run = Window.partitionBy("cut_source").orderBy("_fine")
    sums = some.agg(F.sum("_size").alias("words")).withColumn("taken", F.sum("words").over(run))
    none = found.select("cut_source", "cut_block", (F.shiftleft("part", 44) - 1).alias("limit"), "left", F.lit(0).alias("taken"))
    options = sums.select("cut_source", "cut_block", F.col("_fine").alias("limit"), "left", "taken").union(none)
    nearest = F.min(F.struct(F.abs(F.col("left") - F.col("taken")), "limit"))
    return options.groupBy("cut_source", "cut_block").agg(nearest["limit"].alias("limit"))


def planned_draws(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 24,
    seed: int = 29,
    record_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    kept: list[str] | None = None,
) -> DataFrame:
    """One row per document: ``_id``, ``_source``, ``_size`` (words), ``source_size``, ``target`` and ``draws``
    (a struct of shard and place per take); with ``kept``, also a struct ``_row`` of these columns.

    Sources in order of code points, null last, weigh ``weights`` in turn.
    """
    spark = docs.sparkSession
    rows = materialise(_rows(docs, record_id, source, text, seed, []))
    blocks = materialise(rows.groupBy("_source", "_block").agg(F.sum("_size").alias("words")))
    sources = blocks.groupBy("_source").agg(F.sum("words").alias("words")).collect()
    sources.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    names, sizes = [r["_source"] for r in sources], [r["words"] for r in sources]
    targets = water_level(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share, most)
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    few = F.broadcast if len(sources) <= BROADCAST_SOURCES else (lambda df: df)

    rest = spark.createDataFrame(
        [(n, p, t - p * s) for n, s, t, p in zip(names, sizes, targets, passes, strict=True)],
        "of string, passes int, rest double",
    )
    order = permutation(F.col("_block"), F.col("_source"), F.col("passes"), seed)
    run = Window.partitionBy("_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = blocks.join(few(rest), F.expr("_source <=> of")).withColumn("at", order)
    last = last.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    last = last.where((F.col("words") > 0) & (F.col("before") < F.col("rest")))
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy("_source").orderBy("at")) - 1)
    last = materialise(last.withColumn("whole", F.col("before") + F.col("words") <= F.col("rest")))
    cut = last.where("not whole").select(
        F.col("_source").alias("cut_source"), F.col("_block").alias("cut_block"), (F.col("rest") - F.col("before")).alias("left")
    )
    limits = _last_document(rows, cut)

    counts = {r["_source"]: r["n"] for r in last.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    quotas = np.array([p * BLOCKS + counts.get(n, 0) for n, p in zip(names, passes, strict=True)], np.int64)
    bounds = np.cumsum(splitting_tree(quotas, shards, seed), axis=0)
    info = spark.createDataFrame(
        [(n, s, t, p, bounds[:, i].tolist()) for i, (n, s, t, p) in enumerate(zip(names, sizes, targets, passes, strict=True))],
        "of string, source_size long, target double, passes int, bounds array<long>",
    )
    drawn = last.join(limits, F.expr("_source <=> cut_source and _block = cut_block"), "left").select(
        F.col("_source").alias("drawn_source"),
        F.col("_block").alias("drawn_block"),
        "rank",
        F.when(F.col("whole"), F.lit(2**62)).otherwise(F.col("limit")).alias("limit"),
    )
    drawn = materialise(drawn)
    if kept:
        rows = _rows(docs, record_id, source, text, seed, kept)
    rows = rows.join(few(info), F.expr("_source <=> of")).join(
        few(drawn), F.expr("_source <=> drawn_source and _block = drawn_block"), "left"
    )

    def draw(position: Column, turn: Column) -> Column:
        shard = F.size(F.filter("bounds", lambda b: b <= position)).alias("shard")
        return F.struct(shard, F.xxhash64(F.col("_id"), turn, F.lit(seed), F.lit("place")).alias("place"))

    none = F.array().cast("array<struct<shard:int,place:bigint>>")
    turns = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.transform(turns, lambda t: draw(t * BLOCKS + permutation(F.col("_block"), F.col("_source"), t, seed), t))
    part = F.when(
        F.col("_fine") <= F.col("limit"), F.array(draw(F.col("passes") * BLOCKS + F.col("rank"), F.col("passes")))
    ).otherwise(none)
    return rows.select(
        "_id", "_source", "_size", "source_size", "target", F.concat(whole, part).alias("draws"), *(["_row"] if kept else [])
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: a row of ``docs`` per take, in its shards' shuffled order. Takes the settings of
    ``planned_draws``. Texts move once, dealt out by ranges of (shard, place) so that no task holds a whole shard."""
    draws = planned_draws(docs, kept=docs.columns, **settings)
    out = draws.select("_row", F.explode("draws").alias("_draw"))
    return out.orderBy("_draw.shard", "_draw.place").select("_row.*")
