"""Document fingerprints: one-permutation MinHash of five-word shingles, as packed low-order bits.

A text is lower-cased (A-Z) and cut into words; every run of five words is hashed once. The top bits of a hash name
its bin, the rest is its value, and each of the ``BINS`` bins holds its least value. An empty bin takes the value
of another one by optimal densification: it tries bins in an order that depends on nothing but its own number,
so two texts that agree on which bins are filled borrow alike. Of each bin the low ``LOW_BITS`` bits are kept,
eight bins to a 64-bit number. The share of equal bins, less the share that is equal by chance, estimates
the Jaccard similarity of the sets of shingles.

Texts of under five words are one shingle. Null, empty and blank texts have no shingle and an empty fingerprint; two such
texts are alike (1), one such text is unlike any other (0). Texts are read whole. Equal texts, so also repeated
rows, have equal fingerprints. An empty table gives an empty result. Columns of the input other than the text are
passed on or not looked at, whatever their names. All steps are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.storage import materialise

#: Classes of ASCII white space and capitals.
SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHINGLE_WORDS = 5

#: Bins (2 to the power ``BIN_BITS``), bits kept of each, bins in a 64-bit number.
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
PER_NUMBER = 64 // LOW_BITS

#: Random bins an empty one tries before it ranks all filled ones.
TRIES = 6

#: Ranges of the document order per shuffle partition, and sampled keys per range.
RANGES_PER_PARTITION = 8
SAMPLES_PER_RANGE = 32

_VALUE = (1 << (64 - BIN_BITS)) - 1
_NO_ID = -(1 << 63)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def with_packed(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the packed fingerprint (array of 64-bit numbers) of the column ``text``, empty without words.

    The steps are columns of their own, each used twice or more by the next, so that none is computed again per element.
    """
    names = {x: f"_{out}_{x}" for x in ("hashes", "sorted", "firsts", "held", "there", "dense")}
    hashes, ordered, firsts, held, there, dense = (F.col(n) for n in names.values())
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), CAPITALS, SMALL)
    words = F.array_remove(F.split(lowered, SPACE), "")
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), F.greatest(n - SHINGLE_WORDS, F.lit(0)))
    shingles = F.when(
        n >= SHINGLE_WORDS,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE_WORDS)])),
    ).otherwise(F.array(F.xxhash64(hashes)))
    # a mark per bin, above all its values, keeps the places of empty bins
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: _left(b.cast("long"), 64 - BIN_BITS).bitwiseOR(_long(_VALUE)))

    def same_bin(a: Column, b: Column) -> Column:
        return F.shiftrightunsigned(a, 64 - BIN_BITS) == F.shiftrightunsigned(b, 64 - BIN_BITS)

    first = F.filter(ordered, lambda x, i: (i == 0) | ~F.coalesce(same_bin(x, F.get(ordered, i - 1)), F.lit(False)))
    low = F.transform(
        firsts,
        lambda x: F.when(x.bitwiseAND(_long(_VALUE)) != _VALUE, x.bitwiseAND(_long((1 << LOW_BITS) - 1))),
    )
    bins = F.sequence(F.lit(0), F.size(held) - 1)  # the second use of ``held``
    filled = F.filter(bins, lambda i: F.get(held, i).isNotNull())

    def densified(i: Column) -> Column:
        tried = [F.get(held, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(TRIES)]
        ranked = F.array_min(F.transform(there, lambda j: F.struct(F.xxhash64(i, j, F.lit(TRIES)).alias("h"), j.alias("j"))))
        return F.coalesce(F.get(held, i), *tried, F.get(held, ranked["j"]))

    number = [
        reduce(
            lambda acc, v: acc.bitwiseOR(v),
            [_left(F.get(dense, F.lit(w * PER_NUMBER + k)), LOW_BITS * (PER_NUMBER - 1 - k)) for k in range(PER_NUMBER)],
        )
        for w in range(BINS // PER_NUMBER)
    ]
    held_columns = {
        names["hashes"]: F.transform(words, lambda w: F.xxhash64(w)),
        names["sorted"]: F.sort_array(F.concat(shingles, marks)),
        names["firsts"]: first,
        names["held"]: low,
        names["there"]: filled,
        names["dense"]: F.when(
            F.size(there) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), densified)
        ),
        out: F.when((n > 0) & dense.isNotNull(), F.array(*number)).otherwise(F.array().cast("array<bigint>")),
    }
    for name, value in held_columns.items():
        df = df.withColumn(name, value)
    return df.drop(*names.values())


def _left(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits)


def _spread(bits: int) -> Callable[[Column], Column]:
    return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, bits))


def printed(packed: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits per number."""
    return F.concat_ws("", F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1, corrected for bits that agree by chance."""
    odd = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    for step in (1, 2, 4):  # the lowest bit of each field becomes 1 where any bit of the field differs
        odd = F.transform(odd, _spread(step))
    lowest = _long(sum(1 << (LOW_BITS * k) for k in range(PER_NUMBER)))
    differing = F.aggregate(odd, F.lit(0), lambda acc, x: acc + F.bit_count(x.bitwiseAND(lowest)))
    chance = 1 / (1 << LOW_BITS)
    estimate = (1 - differing / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; a column of that name is replaced. Rows stay where they are."""
    names = [c for c in docs.columns if c != "fingerprint"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return with_packed(held, "_text", "_packed").select("_row.*", printed(F.col("_packed")).alias("fingerprint"))


def _order_table(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row: the first key, and sampled keys that cut the order into ranges; with the number of ranges, which the
    session's shuffle partitions set. Every cut is the key of a row."""
    ranges = RANGES_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("key1", "key2", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))
    key = F.struct("key1", "key2")
    table = rows.select("key1", "key2").agg(
        F.min(key).alias("first"), F.array_sort(F.collect_set(F.when(chance, key))).alias("sample")
    )
    at = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)),
        lambda i: F.get(F.col("sample"), F.floor(i * F.size("sample") / F.lit(ranges)).cast("int")),
    )
    cuts = F.array_distinct(F.array_compact(at))
    return materialise(table.select("first", F.when(F.size("sample") > 0, cuts).otherwise(F.array().cast("array<struct<key1:bigint,key2:bigint>>")).alias("cuts"))), ranges


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text, packed, next_packed): every row with the next one in ascending order of the id,
    the first after the last. Nulls are empty texts.

    Null ids come first; rows of one id are in the order of a digest of their texts. The order is cut at sampled keys
    into ranges, a range is one sort, and the row that begins a range is also given to the range before it. So
    texts are shuffled once. Rows that repeat both id and text are neighbours, all in one range.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)).alias("key1"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key2"),
    )
    table, ranges = _order_table(rows)
    key, cuts = F.struct("key1", "key2"), F.col("cuts")
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    below = F.aggregate(
        halves,
        F.lit(0),
        lambda at, half: F.when((at + half <= F.size(cuts)) & (F.get(cuts, at + half - 1) <= key), at + half).otherwise(at),
    )
    placed = rows.crossJoin(F.broadcast(table)).withColumn("range", below)  # with one row
    # kind 0: the row itself; 1: it begins the next range; 2: it begins the order, and so follows its end
    spot = lambda where, kind: F.struct(where.alias("range"), F.lit(kind).alias("kind"))
    spots = F.array_compact(
        F.array(
            spot(F.col("range"), 0),
            F.when(F.get(cuts, F.col("range") - 1) == key, spot(F.col("range") - 1, 1)),
            F.when(F.col("first") == key, spot(F.size(cuts), 2)),
        )
    )
    dealt = placed.select("doc_id", "text", "key1", "key2", F.explode(spots).alias("spot")).select(
        "doc_id", "text", "key1", "key2", "spot.range", "spot.kind"
    )
    packed = with_packed(dealt.repartition("range"), "text", "packed")
    order = Window.partitionBy("range").orderBy("kind", "key1", "key2")
    found = packed.withColumns({"next_text": F.lead("text").over(order), "next_packed": F.lead("packed").over(order)})
    return found.where("kind = 0").select("doc_id", "text", "next_text", "packed", "next_packed")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and that of the next document.

    The edited text has the last half of its characters (rounded down) replaced by as many from the start of the next
    document, or all of it if that is shorter.
    """
    rows = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "packed", "next_packed")
    rows = with_packed(rows, "edited", "edited_packed")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("packed")).alias("fingerprint"),
        printed(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
