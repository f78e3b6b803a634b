"""Exact top-k by inner product with a dual-tree search over cover trees.

The top level of the tree of data is laid over all rows: its centres are a farthest-first choice from a bounded sample,
every row goes to the nearest one, and each leaf's covering radius is measured over all its rows. Queries are searched
in two rounds. The first takes each query to the leaf whose centre suits it best, which gives a k-th score to beat; the
second takes it to those leaves only whose bound (no product exceeds that with the centre plus what the radius allows)
reaches that score. A task gets one block of a leaf and one group of its queries, builds a cover tree over each, and
walks pairs of nodes, dropping a pair whose bound is below the worst k-th score of the node's queries. Leaves of any
size are cut into blocks, and their queries into groups, by hashes of the ids.

Scores are exact: products of whole numbers, in doubles where they fit and in Python's integers elsewhere (a score
beyond 64 bits is held at the limit). Vectors that are null, or hold null or non-finite components, and rows without an id take no part.
Vectors are compared with those of their own length; lengths that the sample lacks share a leaf that is always searched.
Equal rows count once. Ties go to the smaller id. With fewer candidates than k all are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.storage import materialise

#: Rows per block, queries per group, points per leaf of a block's tree, children per node.
BLOCK_ROWS = 16384
GROUP_ROWS = 4096
LEAF = 1024
CHILDREN = 12

#: Bounds of the top level: leaves, sampled rows, and their bytes.
MOST_LEAVES = 1024
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 32 * 2**20

#: Leaf of vectors whose length the sample lacks.
ODD = -1

NO_ID = np.iinfo(np.int64).max


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, centre: int) -> Node:
    """Children's centres are points, the parent's first; each next one is the farthest from those before, until
    all points lie within half the parent's radius or there are ``CHILDREN`` of them."""
    far = np.sqrt(((points[rows] - points[centre]) ** 2).sum(1))
    node = Node(rows, points[centre], float(np.linalg.norm(points[centre])), float(far.max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    owner, centres = np.zeros(len(rows), int), [centre]
    while far.max() > node.radius / 2 and len(centres) < CHILDREN:
        centres.append(int(rows[far.argmax()]))
        new = np.sqrt(((points[rows] - points[centres[-1]]) ** 2).sum(1))
        owner[new < far] = len(centres) - 1
        far = np.minimum(far, new)
    node.children = [cover_tree(points, rows[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]
    return node


class Search:
    """The best k of one block for one group of queries."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int):
        self.query_ids, self.ids, self.k = query_ids, ids, k
        largest = max(1.0, float(np.abs(queries).max(initial=0)), float(np.abs(points).max(initial=0)))
        exact = largest**2 * max(1, points.shape[1]) < 2**52
        self.queries, self.points = (queries, points) if exact else (_whole(queries), _whole(points))
        self.best = np.full((len(query_ids), k), -np.inf) if exact else np.full((len(query_ids), k), -(10**400), object)
        self.best_ids = np.full((len(query_ids), k), NO_ID)
        self.worst = worst.copy()
        with np.errstate(over="ignore", invalid="ignore"):
            q = cover_tree(queries, np.arange(len(queries)), 0)
            d = cover_tree(points, np.arange(len(points)), 0)
            self.walk(q, d, self.bound(q, d))

    @staticmethod
    def bound(q: Node, d: Node) -> float:
        """Rounding of the radii is covered by a small allowance."""
        top = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        return top + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius)

    def walk(self, q: Node, d: Node, bound: float) -> None:
        if bound < self.worst[q.rows].min():  # a bound that is no number prunes nothing
            return
        if not q.children and not d.children:
            self.leaf(q.rows, d.rows)
        elif q.children and (not d.children or q.radius > d.radius):
            for c in q.children:
                self.walk(c, d, self.bound(c, d))
        else:
            pairs = sorted(((self.bound(q, c), i) for i, c in enumerate(d.children)), key=lambda x: -x[0])
            for b, i in pairs:
                self.walk(q, d.children[i], b)

    def leaf(self, q: np.ndarray, d: np.ndarray) -> None:
        """Only products that reach the k-th ones met so far are ordered."""
        scores = self.queries[q] @ self.points[d].T
        own = self.ids[d] == self.query_ids[q][:, None]
        if scores.dtype == object:
            return self.slow_leaf(q, d, np.where(own, -(10**400), scores), own)
        scores[own] = -np.inf
        floor = self.worst[q]
        if len(d) > self.k:
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        row, place = np.nonzero((scores >= floor[:, None]) & ~own)
        rows = np.concatenate([row, np.repeat(np.arange(len(q)), self.k)])
        found = np.concatenate([scores[row, place], self.best[q].ravel()])
        ids = np.concatenate([self.ids[d][place], self.best_ids[q].ravel()])
        order = np.lexsort((ids, -found, rows))
        starts = np.searchsorted(rows[order], np.arange(len(q)))
        first = order[starts[:, None] + np.arange(self.k)]
        self.best[q], self.best_ids[q] = found[first], ids[first]
        self.worst[q] = np.maximum(self.worst[q], self.best[q][:, -1])

    def slow_leaf(self, q: np.ndarray, d: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        ids = np.where(own, NO_ID, np.broadcast_to(self.ids[d], scores.shape))
        scores, ids = np.concatenate([self.best[q], scores], 1), np.concatenate([self.best_ids[q], ids], 1)
        order = _order(scores, ids, self.k)
        self.best[q], self.best_ids[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        reached = [max(-1.7e308, min(1.7e308, x)) if i != NO_ID else -np.inf for x, i in zip(self.best[q][:, -1], self.best_ids[q][:, -1], strict=True)]
        self.worst[q] = np.maximum(self.worst[q], np.array(reached, float))


def _whole(a: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


def _order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)])


def whole_components(embedding: Column) -> Column:
    """floor(256 * x) of each component, as doubles; null for vectors that take no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # a double's floor would be cut at 64 bits; beyond 2^53 every double is whole
    scaled = F.transform(embedding, lambda x: x.cast("double") * 256)
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return F.when(embedding.isNotNull() & ~bad, floors)


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points (fewer, if fewer are different): each next one is the farthest from those before."""
    chosen, far = [0], np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
    return points[chosen]


class TopLevel:
    """Centres of the leaves by vector length; leaves are numbered through."""

    def __init__(self, sample: list[list[float]], leaves: int):
        self.centres: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for size in sorted({len(v) for v in sample} - {0}):
            points = np.array([v for v in sample if len(v) == size], float)
            with np.errstate(over="ignore", invalid="ignore"):
                centres = farthest_first(points, max(1, leaves * len(points) // len(sample)))
            self.centres[size] = first, centres
            first += len(centres)

    def by_length(self, vectors: pd.Series):
        """(places, vectors, number of the first leaf, centres) of the lengths met; lengths without leaves are left out."""
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            if size in self.centres:
                at = np.flatnonzero(sizes == size)
                yield at, np.stack(vectors.iloc[at].to_list()).astype(float), *self.centres[size]

    def nearest(self, vectors: pd.Series) -> pd.DataFrame:
        """Leaf and distance from its centre. Distances that overflow are no numbers, which prune nothing."""
        leaf, far = np.full(len(vectors), ODD), np.full(len(vectors), np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            for at, v, first, centres in self.by_length(vectors):
                near = ((centres**2).sum(1) - 2 * (v @ centres.T)).argmin(1)
                leaf[at], far[at] = first + near, np.sqrt(((v - centres[near]) ** 2).sum(1))
        return pd.DataFrame({"leaf": leaf.astype("int32"), "far": far})

    def best(self, vectors: pd.Series) -> pd.Series:
        leaf = np.full(len(vectors), ODD, "int32")
        with np.errstate(over="ignore", invalid="ignore"):
            for at, v, first, centres in self.by_length(vectors):
                leaf[at] = first + (v @ centres.T).argmax(1)
        return pd.Series(leaf)

    def reaching(self, vectors: pd.Series, worst: pd.Series, radii: dict[int, float]) -> pd.Series:
        """The leaves where a product may reach ``worst``; leaves without rows have no radius."""
        out = [[ODD] if ODD in radii else [] for _ in vectors]
        worst = worst.to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            for at, v, first, centres in self.by_length(vectors):
                there = np.array([i for i in range(len(centres)) if first + i in radii], int)
                radius = np.array([radii[first + i] for i in there], float)
                norm, size = np.sqrt((v**2).sum(1))[:, None], np.sqrt((centres[there] ** 2).sum(1))
                bound = v @ centres[there].T + norm * radius + 1e-9 * norm * (size + radius)
                for i, low in zip(at, bound < worst[at][:, None], strict=True):
                    out[i] = (first + there[~low]).tolist()
        return pd.Series(out)


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the k best other rows."""
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        whole_components(F.col(f"`{embedding}`")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    rows = materialise(rows.withColumn("dim", F.size("v")))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, longest))))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id", "v").select("v").limit(bound).collect()]
    top = rows.sparkSession.sparkContext.broadcast(TopLevel(sample, max(1, min(MOST_LEAVES, -(-n // BLOCK_ROWS)))))

    nearest = F.pandas_udf(lambda v: top.value.nearest(v), "leaf int, far double")
    best_leaf = F.pandas_udf(lambda v: top.value.best(v), "int")
    placed = materialise(rows.withColumn("at", nearest("v")).select("dim", "vec_id", "v", "asks", "at.leaf", "at.far"))
    # one row per leaf of the top level
    leaves = placed.groupBy("leaf").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
    radii = {r["leaf"]: r["radius"] for r in leaves}
    cut = {r["leaf"]: -(-r["n"] // BLOCK_ROWS) for r in leaves}
    sizes = rows.sparkSession.createDataFrame(list(cut.items()), "leaf int, parts int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    points = placed.join(F.broadcast(sizes), "leaf").withColumn("part", part).select("dim", "leaf", "part", "vec_id", "v")

    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(queries) or not len(points):
            return out
        found = Search(
            queries["vec_id"].to_numpy(), np.stack(queries["v"]), queries["worst"].to_numpy(),
            points["vec_id"].to_numpy(), np.stack(points["v"]), k,
        )
        there = found.best_ids != NO_ID
        scores = [max(-(2**63), min(2**63 - 1, int(x))) for x in found.best[there]]
        ids = np.broadcast_to(found.query_ids[:, None], there.shape)[there]
        return pd.DataFrame({"query_id": ids, "vec_id": found.best_ids[there], "score": np.array(scores, np.int64)})

    def meet(asked: DataFrame, points: DataFrame, parts: Column) -> DataFrame:
        """The best k per query (dim, vec_id, v, worst, leaf) and block of its leaf."""
        groups = asked.groupBy("leaf").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"))
        groups = F.broadcast(materialise(groups))  # a row per leaf
        dealt = asked.join(groups, "leaf").join(F.broadcast(sizes), "leaf").select(
            "dim", "leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("groups")).cast("int").alias("group"), "vec_id", "v", "worst",
        )
        copied = points.join(groups, "leaf").select(
            "dim", "leaf", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "v"
        )
        copied = copied.select(*[F.col(c).alias(c) for c in copied.columns])  # columns of its own beside the queries'
        keys = ["dim", "leaf", "part", "group"]
        near = dealt.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    asked = placed.where("asks").select("dim", "vec_id", "v", best_leaf("v").alias("leaf"))
    asked = materialise(asked.withColumn("worst", F.lit(float("-inf"))))
    first = materialise(meet(asked, points.where("part = 0"), F.lit(1)))
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a little below the k-th score; scores held at the lower limit say nothing
    kth = F.when(F.col("score") > -(2**63) + 1, F.col("score") - F.abs("score") * F.lit(1e-9))
    worst = first.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") == k)
    worst = worst.select(F.col("query_id").alias("vec_id"), kth.alias("kth"))

    reaching = F.pandas_udf(lambda v, w: top.value.reaching(v, w, radii), "array<int>")
    again = asked.drop("worst").join(worst, "vec_id", "left").withColumn("worst", F.coalesce("kth", F.lit(float("-inf"))))
    again = again.withColumn("next", F.explode(reaching("v", "worst"))).join(F.broadcast(sizes), "leaf", "left")
    # a leaf of one block was searched in the first round
    again = again.where((F.col("next") != F.col("leaf")) | (F.col("parts") > 1))
    again = materialise(again.select("dim", "vec_id", "v", F.col("next").alias("leaf"), "worst"))
    near = first.union(meet(again, points, F.col("parts")))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
