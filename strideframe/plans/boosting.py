"""Boosted trees of all classes at once, from histograms of binned rows.

One-vs-rest over ``GBTClassifier`` reads the rows once for every level of every tree of every class. Here they are binned once,
kept in blocks, and one pass gives the histograms of a level for the trees of all classes; a split is chosen where the histograms
of its node come together. Thresholds, bags, features of a node, gains and leaves are those of ``GBTClassifier``, so the trees are
the same but for the last bits of sums, and the model is its one-vs-rest model. The order of the nodes, which their features hang
on, is the one ``GBTClassifier`` has where the histograms of a level fit its ``maxMemoryInMB``.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterable, Iterator, Mapping
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import OneVsRest, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.storage import delete_path, passing_tables, scratch_path

#: Most rows of a block; a task holds one block at a time.
BLOCK_ROWS = 1 << 16

BLOCK = "rows int, bins binary, label binary, weight binary, bags binary"
TREE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)

# Places of a histogram's sums: weight, weight * target, weight * target^2, rows.
WEIGHT, SUM, SQUARES, ROWS = range(4)


def features_per_node(strategy: str, n_features: int) -> int:
    """Features a node may split by: ``all``, a number of features, or a share of them."""
    if strategy == "all":
        return n_features
    if strategy.isdigit() and int(strategy) > 0:
        return min(int(strategy), n_features)
    if 0 < float(strategy) <= 1:
        return ceil(float(strategy) * n_features)
    raise ValueError(f"unknown share of features {strategy!r}")


def split_points(values: np.ndarray, weights: np.ndarray, n_rows: int, expected: float, most: int) -> np.ndarray:
    """Thresholds of a feature from its values other than zero (ascending, with the weights of ``n_rows`` rows); what lacks to
    the ``expected`` weight are zeros. Midpoints of all neighbours, or of those nearest to ``most`` equal shares."""
    zeros = expected - weights.sum()
    if zeros > np.finfo(float).eps * n_rows * 100:
        at = np.searchsorted(values, 0.0)
        values, weights = np.insert(values, at, 0.0), np.insert(weights, at, zeros)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    reached = np.cumsum(weights).tolist()
    chosen, stride = [], expected / (most + 1)
    target = stride
    for i, middle in enumerate(middles.tolist()):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            chosen.append(middle)
            target += stride
    return np.array(chosen)


def thresholds(prepared: DataFrame, n_features: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds per feature, from a sample of some ``max_bins`` squared rows (10,000 at least), drawn as Spark's trees draw it."""
    spark = prepared.sparkSession
    n_rows, weight = prepared.agg(F.count("*"), F.sum("weight")).first()
    bins = min(max_bins, n_rows)
    share = min(1.0, max(bins * bins, 10_000) / n_rows)
    if share < 1:
        drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = prepared._jdf.javaRDD().sample(False, share, drawn)
        sampled = DataFrame(spark._jsparkSession.createDataFrame(rows, prepared._jdf.schema()), spark)
    else:
        sampled = prepared
    values = (
        sampled.select(F.posexplode(vector_to_array("_features")).alias("feature", "value"), "weight")
        .where("value != 0")
        .groupBy("feature", "value")
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    )

    def cut(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("value")
        found = split_points(df["value"].to_numpy(), df["weight"].to_numpy(), df["n"].sum(), share * weight, bins - 1)
        return pd.DataFrame({"feature": df["feature"].iloc[:1], "points": [found.tolist()]})

    cuts = dict(map(tuple, values.groupBy("feature").applyInPandas(cut, "feature int, points array<double>").collect()))
    return [np.array(cuts.get(f, []), dtype=float) for f in range(n_features)]


def binned_blocks(prepared: DataFrame, points: list[np.ndarray], n_classes: int, n_trees: int, bagging: float, seed: int) -> DataFrame:
    """Rows in blocks: the bin of every feature, class, weight, and one bit per tree whether the row is in its bag."""
    in_bag = [F.rand(seed + tree + 1) < bagging if bagging < 1 else F.lit(True) for tree in range(n_trees)]
    rows = prepared.select(vector_to_array("_features").alias("x"), "_label", "weight", F.array(*in_bag).alias("bags"))
    bin_type = np.min_scalar_type(max(map(len, points)))
    class_type = np.min_scalar_type(n_classes)

    def binned(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(points))
        bins = np.stack([np.searchsorted(p, x[:, f]).astype(bin_type) for f, p in enumerate(points)])
        bags = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_trees)
        return bins, batch.column(1).to_numpy().astype(class_type), batch.column(2).to_numpy(), bags.T

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bins, label, weight, bags = (np.concatenate(column, axis=-1) for column in zip(*parts, strict=True))
        columns = (bins, label, weight, np.packbits(bags, axis=1))
        arrays = [pa.array([len(label)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, ["rows", "bins", "label", "weight", "bags"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if held and held + part.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, held = [], 0
                parts.append(binned(part))
                held += part.num_rows
        if held:
            yield block(parts)

    return rows.mapInArrow(blocks, BLOCK)


def first_state(n_features: int, n_classes: int, n_trees: int, bin_type: np.dtype) -> Callable:
    """A stored block as (bins, class, weight, bags, margins of all classes)."""
    class_type = np.min_scalar_type(n_classes)

    def state(row):
        bins = np.frombuffer(row.bins, bin_type).reshape(n_features, row.rows)
        bags = np.frombuffer(row.bags, np.uint8).reshape(n_trees, -1)
        margins = np.zeros((n_classes, row.rows))
        return bins, np.frombuffer(row.label, class_type), np.frombuffer(row.weight), bags, margins

    return state


def reached_nodes(bins: np.ndarray, splits: Mapping[int, tuple[int, int]]) -> np.ndarray:
    """Node of every row: 1 is the root, 2n and 2n + 1 follow n. ``splits`` gives feature and last bin to the left."""
    node = np.ones(bins.shape[1], np.min_scalar_type(2 * max(splits, default=1) + 1))
    for parent in sorted(splits):
        feature, last = splits[parent]
        children = 2 * parent + (bins[feature] > last).astype(node.dtype)
        node = children.astype(node.dtype) if parent == 1 else np.where(node == parent, children, node)
    return node


def moved(trees: list[dict], rate: float) -> Callable:
    """Margins after one more tree per class."""

    def step(state):
        bins, label, weight, bags, margins = state
        margins = margins.copy()
        for c, tree in enumerate(trees):
            said = np.zeros(max(tree) + 1)
            said[list(tree)] = [n["prediction"] for n in tree.values()]
            margins[c] += said[reached_nodes(bins, splits_of(tree))] * rate
        return bins, label, weight, bags, margins

    return step


def splits_of(tree: Mapping[int, dict]) -> dict[int, tuple[int, int]]:
    return {i: n["split"] for i, n in tree.items() if n["split"] is not None}


def level_histograms(number: int, open_nodes: list[dict[int, list[int]]], splits: list[dict], n_bins: int) -> Callable:
    """Sums per (class, node): an array (feature, sum, bin) over the partition's rows that are in the bag of tree ``number``."""

    def run(states: Iterable) -> Iterator:
        found = {(c, i): np.zeros((len(f), 4, n_bins)) for c, nodes in enumerate(open_nodes) for i, f in nodes.items()}
        seen = False
        for bins, label, weight, bags, margins in states:
            seen = True
            bag = np.flatnonzero(np.unpackbits(bags[number], count=len(label)))
            bins, label, weight = bins[:, bag], label[bag], weight[bag]
            for c, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                target = np.where(label == c, 1.0, -1.0)
                if number:
                    with np.errstate(over="ignore"):
                        target = 4.0 * target / (1.0 + np.exp(2.0 * target * margins[c][bag]))
                weighted = weight * target
                sums = [weight, weighted, weighted * target, None]
                node = reached_nodes(bins, splits[c])
                slots = np.full(max(int(node.max(initial=1)), *nodes) + 1, -1, np.intp)
                slots[list(nodes)] = np.arange(len(nodes))
                slot, cells = slots[node], bins
                if (slot < 0).any():
                    inside = np.flatnonzero(slot >= 0)
                    slot, cells = slot[inside], bins[:, inside]
                    sums = [s if s is None else s[inside] for s in sums]
                slot *= n_bins
                for feature in sorted(set().union(*nodes.values())):
                    cell = slot + cells[feature]
                    counted = [np.bincount(cell, s, len(nodes) * n_bins).reshape(len(nodes), n_bins) for s in sums]
                    for k, (i, subset) in enumerate(nodes.items()):
                        if feature in subset:
                            found[c, i][subset.index(feature)] += [s[k] for s in counted]
        if seen:
            yield from found.items()

    return run


def impurity(sums: np.ndarray) -> np.ndarray:
    """Variance of the targets."""
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = (sums[SQUARES] - sums[SUM] * sums[SUM] / sums[WEIGHT]) / sums[WEIGHT]
    return np.where(sums[WEIGHT] == 0, 0.0, variance)


def best_split(histogram: np.ndarray, subset: list[int], n_points: list[int], least: int, given: list[float] | None) -> dict:
    """A node and its best split (none, if no split gains): the first of equal gains, in the order of ``subset``."""
    cumulated = np.cumsum(histogram, axis=2)
    totals = cumulated[0, :, -1] if given is None else np.array(given)
    node = {"sums": totals.tolist(), "impurity": float(impurity(totals)), "split": None, "gain": -1.0}
    node["prediction"] = 0.0 if totals[WEIGHT] == 0 else float(totals[SUM] / totals[WEIGHT])
    for k, feature in enumerate(subset):
        n = n_points[feature]
        if n == 0:
            continue
        left = cumulated[k, :, :n]
        right = cumulated[k, :, n : n + 1] - left
        whole = left[WEIGHT] + right[WEIGHT]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node["impurity"] - left[WEIGHT] / whole * impurity(left) - right[WEIGHT] / whole * impurity(right)
        gain[(left[ROWS] < least) | (right[ROWS] < least) | (whole == 0)] = -1.0
        at = int(np.argmax(gain))
        if gain[at] > 0 and gain[at] > node["gain"]:
            node |= {"split": (feature, at), "gain": float(gain[at]), "left": left[:, at].tolist(), "right": right[:, at].tolist()}
    return node


def leaf(sums: list[float]) -> dict:
    said = 0.0 if sums[WEIGHT] == 0 else sums[SUM] / sums[WEIGHT]
    return {"sums": sums, "impurity": float(impurity(np.array(sums))), "split": None, "gain": -1.0, "prediction": said}


class Subsets:
    """Features of the nodes of tree ``number``, in the order the nodes are opened; the same for all classes."""

    def __init__(self, spark: SparkSession, n_features: int, size: int, seed: int):
        self.random = spark._jvm.org.apache.spark.util.random.XORShiftRandom
        self.seeds = spark._jvm.java.util.Random(seed)
        self.n_features, self.size = n_features, size
        self.drawn: list[list[int]] = []

    def __getitem__(self, place: int) -> list[int]:
        while len(self.drawn) <= place:
            subset = list(range(self.size))
            if self.size < self.n_features:
                random = self.random(self.seeds.nextLong())
                for item in range(self.size, self.n_features):
                    at = int(random.nextDouble() * (item + 1))
                    if at < self.size:
                        subset[at] = item
            self.drawn.append(subset)
        return self.drawn[place]


def grow(state: RDD, number: int, n_classes: int, n_points: list[int], subsets: Subsets, depth: int, least: int) -> list[dict]:
    """One tree per class: {node: its sums, prediction and split}. A level of all trees takes one pass over the rows."""
    trees: list[dict[int, dict]] = [{} for _ in range(n_classes)]
    queues, opened = [[1]] * n_classes, [0] * n_classes
    given: dict[tuple[int, int], list[float]] = {}
    n_bins = max(n_points) + 1
    for level in range(max(depth, 1)):
        open_nodes = [{i: subsets[opened[c] + k] for k, i in enumerate(queues[c])} for c in range(n_classes)]
        keys = sum(map(len, open_nodes))
        if not keys:
            break
        run = level_histograms(number, open_nodes, [splits_of(t) for t in trees], n_bins)
        sums = state.mapPartitions(run).reduceByKey(operator.add, min(keys, state.context.defaultParallelism))
        start = dict(given)

        def chosen(item, open_nodes=open_nodes, start=start):
            (c, i), histogram = item
            return c, i, best_split(histogram, open_nodes[c][i], n_points, least if depth else 2**62, start.get((c, i)))

        for c, i, node in sums.map(chosen).collect():
            trees[c][i] = node
        for c, tree in enumerate(trees):
            opened[c] += len(queues[c])
            following = []
            for i in queues[c]:
                if tree[i]["split"] is None:
                    continue
                for child, side in ((2 * i, "left"), (2 * i + 1, "right")):
                    tree[child] = leaf(tree[i][side])
                    if level + 1 < depth and abs(tree[child]["impurity"]) >= np.finfo(float).eps:
                        given[c, child] = tree[child]["sums"]
                        following.append(child)
            queues[c] = following[::-1]
    return [pruned(t) for t in trees]


def pruned(tree: dict[int, dict]) -> dict[int, dict]:
    """Without the splits whose sides are leaves that say the same."""
    for i in sorted(tree, reverse=True):
        if tree[i]["split"] is not None:
            sides = [tree[2 * i], tree[2 * i + 1]]
            if all(s["split"] is None for s in sides) and sides[0]["prediction"] == sides[1]["prediction"]:
                del tree[2 * i], tree[2 * i + 1]
                tree[i] |= {"split": None, "gain": -1.0, "prediction": sides[0]["prediction"]}
    return tree


def stored_nodes(number: int, tree: Mapping[int, dict], points: list[np.ndarray]) -> list[tuple]:
    """Nodes as Spark stores them: numbered in preorder."""
    order: list[int] = []
    stack = [1]
    while stack:
        i = stack.pop()
        order.append(i)
        if tree[i]["split"] is not None:
            stack += [2 * i + 1, 2 * i]
    place = {i: k for k, i in enumerate(order)}
    rows = []
    for i in order:
        n = tree[i]
        if n["split"] is None:
            children, split = (-1, -1), (-1, [], -1)
        else:
            feature, at = n["split"]
            children, split = (place[2 * i], place[2 * i + 1]), (feature, [float(points[feature][at])], -1)
        data = (place[i], n["prediction"], n["impurity"], n["sums"][:ROWS], int(n["sums"][ROWS]), n["gain"], *children, split)
        rows.append((number, data))
    return rows


def as_model(spark: SparkSession, estimator: OneVsRest, grown: list[list[dict]], points: list[np.ndarray]) -> OneVsRestModel:
    """The trees as the estimator's own model: a model of one row per class and one tree is stored, given the trees and loaded."""
    base = estimator.getClassifier()
    n_classes = len(grown[0])
    rows = [(Vectors.dense([float(c)] * len(points)), float(c), 1.0) for c in range(n_classes)]
    tiny = spark.createDataFrame(rows, [estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()])
    blank = estimator.copy().setClassifier(base.copy({base.maxIter: 1})).fit(tiny.coalesce(1))
    with passing_tables(spark):
        path = scratch_path(spark, "boosted")
        blank.write().save(path)

        def rewrite(at: str, **changes) -> None:
            found = json.loads(spark.read.text(at).first()[0])
            found["paramMap"]["maxIter"] = len(grown)
            text = json.dumps(found | changes)
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(at)

        rewrite(f"{path}/classifier/metadata")
        for c in range(n_classes):
            at = f"{path}/model_{c}"
            rewrite(f"{at}/metadata", numTrees=len(grown))
            nodes = [row for number, trees in enumerate(grown) for row in stored_nodes(number, trees[c], points)]
            spark.createDataFrame(nodes, TREE).coalesce(1).write.mode("overwrite").parquet(f"{at}/data")
            trees = spark.read.parquet(f"{at}/treesMetadata")
            about = json.loads(trees.first()[1])
            rate = base.getStepSize()
            rows = [
                (number, json.dumps(about | {"uid": f"{about['uid']}_{number}"}), rate if number else 1.0)
                for number in range(len(grown))
            ]
            spark.createDataFrame(rows, trees.schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/treesMetadata")
        return OneVsRestModel.load(path)


def fit_boosted(prepared: DataFrame, estimator: OneVsRest, n_classes: int) -> OneVsRestModel:
    """What ``estimator``, one-vs-rest over ``GBTClassifier``, fits to stored rows (``_features``, ``_label``, ``weight``)."""
    spark, base = prepared.sparkSession, estimator.getClassifier()
    first = prepared.first()
    if first is None:
        raise ValueError("no rows to fit boosted trees to")
    n_features, n_trees, seed = len(first["_features"]), base.getMaxIter(), base.getSeed()
    points = thresholds(prepared, n_features, base.getMaxBins(), seed)
    n_points = [len(p) for p in points]
    size = features_per_node(base.getFeatureSubsetStrategy(), n_features)
    blocks = binned_blocks(prepared, points, n_classes, n_trees, base.getSubsamplingRate(), seed)
    state = blocks.rdd.map(first_state(n_features, n_classes, n_trees, np.min_scalar_type(max(n_points))))
    state = state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    grown: list[list[dict]] = []
    written = None
    try:
        for number in range(n_trees):
            before = None
            if number:
                before, state = state, state.map(moved(grown[-1], 1.0 if number == 1 else base.getStepSize()))
                state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
            interval = base.getCheckpointInterval()
            due = interval > 0 and number > 0 and number % interval == 0
            if due:
                state.checkpoint()
            subsets = Subsets(spark, n_features, size, seed + number)
            grown.append(grow(state, number, n_classes, n_points, subsets, base.getMaxDepth(), base.getMinInstancesPerNode()))
            if before is not None:
                before.unpersist()
            if due:
                if written is not None:
                    delete_path(spark, written)
                written = state.getCheckpointFile()
    finally:
        state.unpersist()
        if written is not None:
            delete_path(spark, written)
    return as_model(spark, estimator, grown, points)
