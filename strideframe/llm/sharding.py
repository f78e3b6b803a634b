"""Shards of nearly equal size: sampled splitters, range partitioning, subdivision of overfull ranges.

Records are ordered by a key (a digest of the text, then the id), so equal texts lie next to each other and a
group of copies of any number can still be cut. Key samples are drawn in proportion to size, their quantiles cut
the order into ranges, every range is measured exactly, and one that is overfull gets splitters from samples of
its own. Sums over ranges then give each record its exact offset in the whole order, so that shards are cut at
equal sizes to within one record, whatever the splitters were.

Null and empty texts are records of the smallest size and share a place in the order. Records with equal id and text
are told apart by nothing and may stand in any order among themselves. An empty table gives an empty result.
Columns of the input other than id and text are not looked at. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.storage import materialise

#: Ranges per shard at least, and records in a range at most (about); a range is one sort. A splitter takes 48
#: bytes, so 100 billion records have a table of splitters of about 5 MB.
RANGES_PER_SHARD = 8
RECORDS_PER_RANGE = 1_000_000

#: Samples per range, and the size, in mean ranges, from which a range is overfull.
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0


def keyed(docs: DataFrame, record_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key1, key2): one pass over the texts; later passes read this small table.
    Size is the UTF-8 length plus 8 bytes; the checksum of a null text is that of no bytes."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{record_id}`").alias("doc_id"),
        (F.octet_length(value) + 8).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("key1"),
        F.coalesce(F.col(f"`{record_id}`").cast("long"), F.lit(-(2**63))).alias("key2"),
    )


def _key() -> Column:
    return F.struct("key1", "key2")


def _sampled_splitters(rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Splitters (range, cuts) that cut each range of ``wanted`` (range, bytes, parts) into about ``parts``.

    A record enters the sample as often as its size exceeds a random point of a grid whose step is the range's
    bytes over the number of samples: in proportion to size, large records several times.
    """
    step = F.col("bytes") / (F.col("parts") * SAMPLES_PER_RANGE)
    chance = (F.xxhash64("key1", "key2", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    drawn = rows.join(F.broadcast(wanted), "range").withColumn("times", F.floor(F.col("size") / step + chance))
    samples = (
        drawn.where("times > 0")
        .groupBy("range", "parts")
        .agg(
            F.sort_array(F.collect_list(F.struct("key1", "key2", "times"))).alias("keys"),
            F.sum("times").alias("total"),
        )
    )
    # the sample at which the running number of draws passes each quantile
    weighted = F.aggregate(
        "keys",
        F.struct(
            F.lit(0).cast("long").alias("seen"),
            F.array().cast("array<struct<key1:bigint,key2:bigint>>").alias("cuts"),
        ),
        lambda acc, k: F.struct(
            (acc["seen"] + k["times"]).alias("seen"),
            F.when(
                F.floor((acc["seen"] + k["times"]) * F.col("parts") / F.col("total"))
                > F.floor(acc["seen"] * F.col("parts") / F.col("total")),
                F.concat(acc["cuts"], F.array(F.struct(k["key1"], k["key2"]))),
            )
            .otherwise(acc["cuts"])
            .alias("cuts"),
        ),
        lambda acc: acc["cuts"],
    )
    return samples.select("range", weighted.alias("cuts"))


def _in_range(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Number of splitters below a record's key, by halving."""
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    table = F.array(*[F.struct(F.lit(a).cast("long").alias("key1"), F.lit(b).cast("long").alias("key2")) for a, b in cuts])
    halves = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    low = F.aggregate(
        F.array(*map(F.lit, halves)),
        F.lit(0),
        lambda at, half: F.when(
            (at + half <= len(cuts)) & (F.get(table, F.least(at + half, F.lit(len(cuts))) - 1) < _key()), at + half
        ).otherwise(at),
    )
    return rows.withColumn("range", low)


def _measured(rows: DataFrame) -> DataFrame:
    return rows.groupBy("range").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("n"),
        (F.min(_key()) == F.max(_key())).alias("one_key"),
    )


def balanced_shards(
    docs: DataFrame, shards: int, record_id: str = "doc_id", text: str = "text", seed: int = 17
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every record in one of ``shards`` shards of nearly equal bytes.

    Slots number a shard's records from 0 in key order. The result does not depend on the samples drawn.
    """
    rows = materialise(keyed(docs, record_id, text))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    n, total_bytes = total["n"], total["bytes"] or 0
    parts = max(1, min(n, max(shards * RANGES_PER_SHARD, n // RECORDS_PER_RANGE)))
    wanted = docs.sparkSession.createDataFrame([(0, int(total_bytes), parts)], "range int, bytes long, parts int")
    cuts: list[tuple[int, int]] = []
    ranged = rows.withColumn("range", F.lit(0))
    overfull = OVERFULL * total_bytes / parts
    while n:
        new = _sampled_splitters(ranged, wanted, seed).select(F.explode("cuts").alias("c")).select("c.*").collect()
        merged = sorted({*cuts, *((r["key1"], r["key2"]) for r in new)})
        ranged = _in_range(rows, merged)
        sizes = materialise(_measured(ranged))
        full = sizes.where((F.col("bytes") > overfull) & ~F.col("one_key"))
        wanted = full.select("range", "bytes", F.ceil(2 * F.col("bytes") * parts / F.lit(max(1, total_bytes))).cast("int").alias("parts"))
        if len(merged) == len(cuts) or full.isEmpty():
            break
        cuts, seed = merged, seed + 1
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # one row per range: a number of rows bounded by the number of splitters
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )
    inside = Window.partitionBy("range").orderBy("key1", "key2").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns(
        {
            "in_bytes": F.coalesce(F.sum("size").over(inside), F.lit(0)),
            "in_n": F.coalesce(F.count("*").over(inside), F.lit(0)),
        }
    ).join(F.broadcast(offsets), "range")
    middle = F.col("bytes_before") + F.col("in_bytes") + F.col("size") / 2
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / F.lit(total_bytes)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("n_before") + F.col("in_n")).alias("place"),
    )
    placed = materialise(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )
