"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Shingles have one global order: those in few documents by their hash, then the most frequent ones by their hash. Two
sets with a Jaccard similarity of t share a shingle among their first n - ceil(t n) + 1 in that order, so only
these are dealt out by shingle to find candidates. The order is cut into fragments; a document's segment in
each is a row, candidates' overlaps are counted fragment by fragment, and the counts are summed per pair.

Texts with equal sets are one vertex. Large groups of near copies are not paired off with each other: first every
document is compared with a leader, the smallest id of the lists they share most of, what links joins a component, and
only pairs of different components that their common first shingles leave possible are then compared, all of them.
Every two linked texts end up in one component.

A pair is only looked at if the parities of both sets allow the similarity, a bound that leaves out no link.

Texts without words have an empty set and are linked with nothing; fewer than five words make one shingle of
the whole sequence. Null texts have no words. Texts are read whole. Rows without an id keep a null component. Rows that share
an id are one document: equal sets of an id count once, each of its different sets is compared by itself, and what any of
them is linked with is linked with the id, so all its rows have one component. An empty table gives an empty result. Sets
are compared by 64-bit hashes of shingles and 128-bit hashes of sets.

Documents that were compared with the same leader are not paired by their first shingles but by what tells them
from the leader. With L the leader's set, D what a document lacks of it and E what it has besides, the overlap of two
documents is |L| - |D| - |D'| + |D and D'| + |E and E'|. So each has a weight, and two are linked if the common
differences reach the sum of the weights: at a sum of zero or less always (then both are linked with the lightest
document, which stands for these links), else only if they share one of their first, rarest differences. How many
come first depends on the pair: the heavier the two, the more differences they must share and the fewer are first. So a
difference of a document has a reach, the largest weight of a partner for which it still is a first one, and two
documents meet at a difference only if both reach the other's weight. What reaches nobody in a list leaves it before
its documents are paired. Where lists still promise many more pairs than rows, each document is first
compared with the lightest one of each of its lists, and what links joins a component, as with the leaders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.components import components
from strideframe.llm.stored import stored
from strideframe.storage import passing_tables

WORDS = 5

#: Fragments of the global order.
FRAGMENTS = 8

#: A shingle in more first parts than this is frequent, if it is among the ``MOST_FREQUENT`` (8 bytes each) that
#: are broadcast. Others remain in the order by hash; the result is the same either way.
FREQUENT = 48
MOST_FREQUENT = 2_000_000

#: Ids (8 bytes each) up to which a measured set of documents is broadcast instead of shuffling texts.
BROADCAST_IDS = 2_000_000

#: Lists shared with a leader, in per cent of a document's shingles, from which the two are compared first.
STAR_PERCENT = 3

#: Documents with one leader from which they are compared by their differences; the result is the same either way.
FAMILY = 16

#: Pairs for each row of a family's lists from which documents are compared with the lightest of their lists first.
HUB_PAIRS = 8

#: Columns of 64 parities each: how often, even or odd, a set's hashes fall on each of 256 places. Sets differ in at
#: least as many shingles as places.
PARITIES = ["even1", "even2", "even3", "even4"]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes. Bytes split and lower-cased: ASCII only, as the definition has it."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i]
        return np.unique(_mixed(h))


def parities(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def first_part(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield part.column(0).to_pylist(), [shingles(t.as_py(), hashes) for t in part.column(1)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _signatures(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128-bit hashes of sets, in two halves."""
    found = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    high, low = [(s >> 64) - (1 << 63) for s in found], [(s & ((1 << 64) - 1)) - (1 << 63) for s in found]
    return pa.array(high, pa.int64()), pa.array(low, pa.int64())


def frequent_shingles(rows: DataFrame, percent: int) -> np.ndarray:
    """Shingles in more than ``FREQUENT`` first parts by hash alone, at most ``MOST_FREQUENT``, sorted."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches):
            flat = np.concatenate([s[: first_part(len(s), percent)] for s in sets] or [np.zeros(0, np.uint64)])
            found, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": found.view(np.int64), "n": n.astype(np.int64)})

    counts = rows.mapInArrow(firsts, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle")
    return np.sort(np.array([r[0] for r in top.toLocalIterator()], np.int64).view(np.uint64))


def signed_sets(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, sig1, sig2, firsts, parities): size, 128-bit signature, first part and ``PARITIES`` of each text's set."""
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, percent))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for ids, found in _texts(batches):
            flat = np.concatenate([*found, np.zeros(0, np.uint64)])
            sig1, sig2 = _signatures(found)
            at = np.searchsorted(common, flat)
            hot = np.zeros(len(flat), bool)
            inside = at < len(common)
            hot[inside] = common[at[inside]] == flat[inside]
            begin, firsts = 0, []
            for s in found:
                h, begin = hot[begin : begin + len(s)], begin + len(s)
                p = first_part(len(s), percent)
                cold = s[~h][:p]
                firsts.append(cold if len(cold) == p else np.concatenate([cold, s[h][: p - len(cold)]]))
            odd = np.array([parities(s) for s in found], np.int64).reshape(-1, len(PARITIES))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    sig1,
                    sig2,
                    _lists(firsts),
                    *[pa.array(odd[:, i]) for i in range(len(PARITIES))],
                ],
                ["doc_id", "n", "sig1", "sig2", "firsts", *PARITIES],
            )

    schema = "doc_id long, n long, sig1 long, sig2 long, firsts array<long>"
    return rows.mapInArrow(sets, ", ".join([schema, *[f"{name} long" for name in PARITIES]]))


def segments(rows: DataFrame) -> DataFrame:
    """(id, fragment, segment): the sets of (id, text) rows, cut at equal distances of the order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _texts(batches):
            owner, fragment, parts = [], [], []
            for i, s in zip(ids, found, strict=True):
                edges = np.searchsorted(s >> np.uint64(61), np.arange(FRAGMENTS + 1))
                for f in range(FRAGMENTS):
                    if edges[f] < edges[f + 1]:
                        owner.append(i)
                        fragment.append(f)
                        parts.append(s[edges[f] : edges[f + 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner, pa.int64()), pa.array(fragment, pa.int32()), _lists(parts)], ["id", "fragment", "segment"]
            )

    return rows.mapInArrow(cut, "id long, fragment int, segment array<long>")


def _alike_enough(percent: int) -> Column:
    """Parities that allow the similarity: no pair above it is left out."""
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _long_enough(percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n_a, n_b) whose overlaps, summed over the fragments, are large enough. Only the
    texts of ``rows`` that a pair names are cut into segments."""
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    cut = stored(segments(_among(rows, named, "left_semi")), "segments")
    left = cut.select(F.col("id").alias("a"), "fragment", F.col("segment").alias("of_a"))
    right = cut.select(F.col("id").alias("b"), "fragment", F.col("segment").alias("of_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = partial.withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return total.where(100 * F.col("common") >= percent * union).select("a", "b")


def _with_component(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each document with the leader (the smallest id of a list), other than itself, that it shares the most lists with."""
    leaders = lists.groupBy("shingle").agg(F.min(F.struct("id", "n")).alias("l"))
    near = lists.join(leaders, "shingle").where("id <> l.id")
    near = near.select(F.col("l.id").alias("a"), F.col("id").alias("b"), F.col("l.n").alias("n_a"), F.col("n").alias("n_b"))
    counted = near.where(_long_enough(percent)).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    best = F.max(F.struct("shared", "a", "n_a"))
    likely = 100 * F.col("shared") >= STAR_PERCENT * F.col("n_b")
    first = counted.where(likely).groupBy("b", "n_b").agg(best.alias("x"))
    return first.select(F.col("x.a").alias("a"), "b", F.col("x.n_a").alias("n_a"), "n_b")


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components and families that may be linked.

    In each list the component or the family with the most documents, whichever has more, is not paired with itself: one
    side of a pair is always from outside. A pair's number of common first shingles is known in full here
    (a list that holds both is never left out); what else they share lies behind the end of one of the first parts.
    """
    behind = F.greatest(*[F.ceil(F.lit(percent) * F.col(n) / 100) - 1 for n in ("n_a", "n_b")])
    needed = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    met = _met(lists, ["component", "family"], ["n"], PARITIES, _long_enough(percent) & _alike_enough(percent))
    return met.where(F.col("shared") + behind >= needed).drop("shared")


def _met(lists: DataFrame, apart: list[str], carried: list[str], tested: list[str], plausible: Column) -> DataFrame:
    """(a, b, carried columns of both, shared): documents that differ in all columns of ``apart`` and share lists in which
    they are ``plausible``, a test that may name ``tested`` columns, too."""
    bulks = []
    for name in apart:
        sizes = lists.groupBy("shingle", F.col(name).alias("value")).agg(F.count("*").alias("k"))
        bulks.append(sizes.withColumn("by", F.lit(name)))
    sizes = bulks[0] if len(bulks) == 1 else bulks[0].union(bulks[1])
    bulk = sizes.groupBy("shingle").agg(F.max(F.struct("k", "by", "value")).alias("m"), F.sum("k").alias("all"))
    bulk = bulk.where(F.col("all") > len(apart) * F.col("m.k")).select("shingle", "m.by", "m.value")
    of_bulk = F.lit(False)
    for name in apart:
        of_bulk = of_bulk | ((F.col("by") == name) & (F.col(name) == F.col("value")))
    columns = ["id", *apart, *carried, *tested]
    marked = lists.join(bulk, "shingle").select("shingle", *columns, of_bulk.alias("of_bulk"))
    marked = stored(marked, "marked")
    one = marked.where("not of_bulk").select("shingle", F.struct(*columns).alias("x"))
    other = marked.select("shingle", F.struct(*columns).alias("y"), "of_bulk")
    met = one.join(other, "shingle").where("of_bulk or x.id < y.id")
    for name in apart:
        met = met.where(F.col(f"x.{name}") != F.col(f"y.{name}"))
    first = F.col("x.id") < F.col("y.id")
    sides = [("a", F.when(first, F.col("x")).otherwise(F.col("y"))), ("b", F.when(first, F.col("y")).otherwise(F.col("x")))]
    met = met.select(*[c.alias(side) for side, c in sides])
    named = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in [*carried, *tested] for side in ("a", "b")]
    met = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *named).where(plausible)
    met = met.drop(*[f"{c}_{side}" for c in tested for side in ("a", "b")])
    return met.groupBy(*met.columns).agg(F.count("*").alias("shared"))


def families(pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): documents b that were compared with a leader a of at least ``FAMILY`` documents."""
    large = pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") >= FAMILY).select("a")
    return pairs.join(large, "a")


def family_links(family: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) known from the weights, and (a, id, n, w, behind, found): a document's differences from its leader
    ``a`` that others of the family share, the rarest first, all but ``behind`` of them being its first ones."""
    named = family.select(F.col("a").alias("doc_id")).union(family.select("b")).distinct()
    cut = stored(segments(_among(rows, named, "left_semi")), "segments")
    left = cut.select(F.col("id").alias("a"), "fragment", F.col("segment").alias("of_a"))
    right = cut.select(F.col("id").alias("b"), "fragment", F.col("segment").alias("of_b"))
    every = family.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    both = every.join(right, ["b", "fragment"], "left").join(left, ["a", "fragment"], "left")
    none = F.array().cast("array<long>")
    of_a, of_b = F.coalesce("of_a", none), F.coalesce("of_b", none)
    parts = both.select(
        "a", "b", "n_a", "n_b", F.array_except(of_a, of_b).alias("lacks"), F.array_except(of_b, of_a).alias("more")
    )
    parts = stored(parts, "differences")
    unit = 2 * (100 + percent)
    weight = 2 * percent * F.col("n_b") + unit * F.col("lacking") - (100 + percent) * F.col("n_a")
    weighed = parts.groupBy("a", "b", "n_a", "n_b").agg(
        F.sum(F.size("lacks")).alias("lacking"), F.sum(F.size("more")).alias("besides")
    )
    weighed = stored(weighed.withColumn("w", weight), "weights")
    lightest = weighed.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m"))
    weighed = weighed.join(lightest, "a")
    sure = weighed.where("b <> m.b and w + m.w <= 0").select(F.col("m.b").alias("a"), "b")
    # Behind the first part lie fewer differences than any link needs.
    behind = F.greatest(F.ceil((F.col("w") + F.col("m.w")) / unit) - 1, F.lit(0))
    open_ends = weighed.select(
        "a", "b", F.col("n_b").alias("n"), "w", behind.alias("behind"), (F.col("lacking") + F.col("besides")).alias("differences")
    ).where("differences > behind")
    apart = parts.select("a", "b", F.explode("lacks").alias("d"), F.lit(True).alias("lack")).union(
        parts.select("a", "b", F.explode("more"), F.lit(False))
    )
    common = apart.groupBy("a", "d", "lack").agg(F.count("*").alias("k")).where("k > 1")
    rare = apart.join(common, ["a", "d", "lack"]).groupBy("a", "b")
    rare = rare.agg(F.array_sort(F.collect_list(F.struct("k", "d", "lack"))).alias("found"))
    # Differences that no other document of the family has come first and are met by none.
    length = F.size("found") - F.col("behind")
    profiles = open_ends.join(rare, ["a", "b"]).where(length > 0)
    profiles = profiles.select("a", F.col("b").alias("id"), "n", "w", "behind", F.col("found.d").alias("found"))
    return sure, stored(profiles, "profiles", kept=True)


def family_lists(profiles: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, n, w, reach): the lists of first differences, without the rows that reach nobody or that nobody
    reaches. What one document lacks of the leader no other has besides it, so the hash alone tells differences apart."""
    size = F.size("found")
    first = F.slice("found", F.lit(1), (size - F.col("behind")).cast("int"))
    lists = profiles.select("a", "id", "n", "w", size.alias("size"), F.posexplode(first).alias("before", "d"))
    reach = 2 * (100 + percent) * (F.col("size") - F.col("before")) - F.col("w")
    lists = lists.select(F.struct("a", "d").alias("shingle"), "id", "n", "w", reach.alias("reach"))
    ends = lists.groupBy("shingle").agg(F.min("w").alias("least"), F.max("reach").alias("most"), F.count("*").alias("k"))
    lists = lists.join(ends.where("k > 1"), "shingle").where("w <= most and least <= reach")
    return stored(lists.select("shingle", "id", "n", "w", "reach"), "family-lists", kept=True)


def _reached() -> Column:
    """Documents of a family whose weights are both within the other's reach."""
    return (F.col("w_a") + F.col("w_b") > 0) & (F.col("w_a") <= F.col("reach_b")) & (F.col("w_b") <= F.col("reach_a"))


def _alike(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, w_a, w_b) within families that share differences enough."""
    left = profiles.select(F.col("id").alias("a"), F.col("found").alias("of_a"))
    right = profiles.select(F.col("id").alias("b"), F.col("found").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    enough = 2 * (100 + percent) * common >= F.col("w_a") + F.col("w_b")
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _pairs_to_come(lists: DataFrame) -> tuple[int, int]:
    """Rows of the lists with more than one component, and the pairs of rows of different components in them."""
    sizes = lists.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    each = sizes.groupBy("shingle").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    each = each.where(F.col("all") * F.col("all") > F.col("same"))
    total = each.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()
    return total[0] or 0, int(total[1] or 0)


def hub_links(lists: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Links of documents with the lightest one of a list, if it is in another component: no more pairs than rows."""
    hubs = lists.groupBy("shingle").agg(F.min(F.struct("w", "id", "component", "reach")).alias("h"))
    near = lists.join(hubs, "shingle").where("component <> h.component")
    near = near.select(
        F.col("h.id").alias("a"), F.col("id").alias("b"), F.col("h.w").alias("w_a"), F.col("w").alias("w_b"),
        F.col("h.reach").alias("reach_a"), F.col("reach").alias("reach_b"),
    )
    return _alike(near.where(_reached()).select("a", "b", "w_a", "w_b").distinct(), profiles, percent)


def joined_by_hubs(
    links: DataFrame, found: DataFrame, lists: DataFrame, profiles: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """``links`` and their components ``found`` after comparisons with the lightest of each list, as long as these at least
    halve the pairs to come and there are many."""
    rows, pairs = _pairs_to_come(_with_component(lists, found))
    before = 2 * pairs
    while pairs > HUB_PAIRS * rows and 2 * pairs <= before:
        new = stored(hub_links(_with_component(lists, found), profiles, percent), "hub-links")
        links = links.union(new)
        found = components(links)
        before = pairs
        rows, pairs = _pairs_to_come(_with_component(lists, found))
    return links, found


def family_pairs(lists: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of documents of different components within families, all that the components lack."""
    met = _met(lists, ["component"], ["n", "w"], [*PARITIES, "reach"], _reached() & _alike_enough(percent))
    return _alike(met.select("a", "b", "w_a", "w_b"), profiles, percent)


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by id: a small measured set of ids is broadcast, a large one shuffles the rows."""
    ids = stored(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def set_ids(known: DataFrame) -> DataFrame:
    """(doc_id, sig1, sig2, id): every different set of the documents ``known`` has a number of its own. An id's least set
    keeps the id, its others get hashes that are the id of no document."""
    each = known.select("doc_id", "sig1", "sig2").distinct()
    least = each.groupBy("doc_id").agg(F.min(F.struct("sig1", "sig2")).alias("least"))
    each = stored(each.join(least, "doc_id").withColumn("own", F.struct("sig1", "sig2") == F.col("least")).drop("least"), "each")
    salt = 0
    while True:
        number = F.when(F.col("own"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "sig1", "sig2", F.lit(salt)))
        out = each.select("doc_id", "sig1", "sig2", number.alias("id"))
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
        salt += 1


def _one_per_set(rows: DataFrame, ids: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, text): ``rows`` under the numbers of their sets, of rows with equal sets of a ``repeated`` id one."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                signed = _signatures([shingles(t.as_py(), hashes) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([*part.columns, *signed], ["doc_id", "text", "sig1", "sig2"])

    again = _among(rows, repeated, "left_semi").mapInArrow(sign, "doc_id long, text string, sig1 long, sig2 long")
    once = again.groupBy("doc_id", "sig1", "sig2").agg(F.first("text").alias("text"))
    once = stored(once.join(ids, ["doc_id", "sig1", "sig2"]).select(F.col("id").alias("doc_id"), "text"), "once")
    return _among(rows, repeated, "left_anti").unionByName(once)


def jaccard_classes(
    docs: DataFrame, percent: int = 80, record_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``: the set's size and the smallest id reachable by
    links of at least ``percent`` per cent."""
    rows = docs.select(F.col(f"`{record_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sets = stored(signed_sets(rows, percent), "sets")
    vertex = F.min(F.struct("doc_id", "n", "firsts", *PARITIES))
    known = sets.where("n > 0 and doc_id is not null")
    repeated = sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    once = repeated.isEmpty()
    if not once:
        ids = set_ids(known)
        rows = _one_per_set(rows, ids, repeated)
        known = known.join(ids, ["doc_id", "sig1", "sig2"]).drop("doc_id").withColumnRenamed("id", "doc_id")
    vertices = stored(known.groupBy("sig1", "sig2").agg(vertex.alias("v")), "vertices")
    dealt = vertices.select(F.col("v.doc_id").alias("id"), F.col("v.n").alias("n"), F.explode("v.firsts").alias("shingle"))
    shared = dealt.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    lists = stored(dealt.join(shared, "shingle"), "lists")
    first = stored(star_pairs(lists, percent), "stars")
    family = stored(families(first), "families")
    with passing_tables(docs.sparkSession):
        sure, profiles = family_links(family, rows, percent)
        differences = family_lists(profiles, percent)
        links = stored(linked(first, rows, percent).union(sure), "links", kept=True)
    links, found = joined_by_hubs(links, components(links), differences, profiles, percent)
    family = family.select(F.col("b").alias("id"), F.col("a").alias("family"))
    current = _with_component(lists, found).join(family, "id", "left")
    current = current.withColumn("family", F.coalesce("family", "id"))
    odd = vertices.select(F.col("v.doc_id").alias("id"), *[f"v.{name}" for name in PARITIES])
    pairs = cross_pairs(current.join(odd, "id"), percent).select("a", "b", "n_a", "n_b")
    links = links.union(linked(stored(pairs, "pairs"), rows, percent))
    links = links.union(stored(family_pairs(_with_component(differences, found).join(odd, "id"), profiles, percent), "alike"))
    member = vertices.select("sig1", "sig2", F.col("v.doc_id").alias("id"))
    if not once:
        of_id = ids.select("doc_id", "sig1", "sig2").join(member, ["sig1", "sig2"]).select("doc_id", F.col("id").alias("b"))
        of_id = stored(of_id, "of-id")
        one = of_id.groupBy("doc_id").agg(F.min("b").alias("a"))
        links = links.union(of_id.join(one, "doc_id").where("a <> b").select("a", "b"))
    found = components(links)
    member = member.join(found, "id", "left").select("sig1", "sig2", "id", F.coalesce("component", "id").alias("component"))
    if not once:
        return _by_id(sets, of_id.join(member.select(F.col("id").alias("b"), "component"), "b"))
    member = member.drop("id")
    out = sets.drop("firsts", *PARITIES).join(member, ["sig1", "sig2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _by_id(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The result where ids repeat: ``members`` (doc_id, component) has components under any number, one per id."""
    members = stored(members.select("doc_id", "component").distinct(), "members")
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = members.join(least, "component").select("doc_id", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"))
    named = out.where("doc_id is not null").join(least, "doc_id", "left")
    named = named.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return named.unionByName(out.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def one_per_component(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Of each component the document with its id, all columns as they were; rows without an id stay. Of rows that share
    the id the one with the longest text stays."""
    with passing_tables(docs.sparkSession):
        classes = stored(jaccard_classes(docs, percent), "classes", kept=True)
    out = _among(docs, classes.where("doc_id <> component_id").select("doc_id").distinct(), "left_anti")
    ids = classes.where("doc_id is not null and doc_id = component_id").select("doc_id")
    repeated = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    again = _among(out, repeated, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.octet_length("text"), F.col("text"))
    once = again.groupBy("doc_id").agg(F.max_by(row, order).alias("_kept")).select("_kept.*")
    return _among(out, repeated, "left_anti").unionByName(once)
