"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings of four and five letters, each present or not.
The machine adds a weight per term and, for every pair of terms, the inner product of their two factors, so that
a pair can count more or less than its parts. It is fitted in one task on a bounded, balanced sample of labelled
documents, is a few MB large, and is sent to every task; scoring shuffles nothing.

The sample: of each label at most ``SAMPLE_PER_LABEL`` documents, those with the smallest hash of their id. Used
are terms in at least ``LEAST_DOCUMENTS`` sampled documents whose shares in the two labels differ by ``LEAST_Z``
standard errors; of thousands of terms in a long text, the others would only add noise.

Null and empty texts have no terms and get the score of none; without any labelled documents every score is
0.5. Texts are read whole. Repeated rows get equal scores. Labels that are null are no labels; where a document
has several, the largest counts. Only the text enters a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.storage import materialise

BITS = 18
FACTORS = 4
SAMPLE_PER_LABEL = 5000
LEAST_DOCUMENTS = 4
LEAST_Z = 3.5
EPOCHS = 12
BATCH = 64
RATE = 0.1
PENALTY = 1e-4

#: Words whose terms a worker holds.
CACHE_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[int]:
    """Hashed terms of a lower-cased word."""
    mask = (1 << BITS) - 1
    parts = ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return [zlib.crc32(p.encode()) & mask for p in parts]


class Terms(dict):
    """Word -> those of its terms that are used, kept for the words met."""

    def __init__(self, used: np.ndarray | None = None):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(t for t in terms(word) if self.used is None or self.used[t])
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        words = set(WORD.findall(text.lower())) if text else set()
        return sorted(set().union(*[self[w] for w in words]))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Logistic loss, adaptive gradient steps over small batches."""
    size = 1 << BITS
    random = np.random.default_rng(seed)
    seen = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k] or [np.zeros(0, np.int64)]), minlength=size) for k in (0, 1)]
    n0, n1 = max(1, (labels == 0).sum()), max(1, (labels == 1).sum())
    mean = (seen[0] + seen[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n0 + 1 / n1))
    used = (seen[0] + seen[1] >= LEAST_DOCUMENTS) & (np.abs(seen[1] / n1 - seen[0] / n0) >= LEAST_Z * error)
    rows = [r[used[r]] for r in rows]
    weight, factors = np.zeros(size), random.normal(0, 0.01, (size, FACTORS))
    bias, g_bias, g_weight, g_factors = 0.0, 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS if len(rows) else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([rows[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            v = factors[index]
            sums = np.stack([np.bincount(owner, v[:, f], len(some)) for f in range(FACTORS)], 1)
            squares = np.stack([np.bincount(owner, v[:, f] ** 2, len(some)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(owner, weight[index], len(some)) + 0.5 * (sums**2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            step = error.sum()
            g_bias += step**2
            bias -= RATE * step / np.sqrt(g_bias)
            places, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, error[owner]) + PENALTY * weight[places]
            g_weight[places] += dw**2
            weight[places] -= RATE * dw / np.sqrt(g_weight[places])
            slope = error[owner, None] * (sums[owner] - v)
            df = np.stack([np.bincount(where, slope[:, f]) for f in range(FACTORS)], 1) + PENALTY * factors[places]
            g_factors[places] += df**2
            factors[places] -= 0.1 * RATE * df / np.sqrt(g_factors[places])
    return {
        "used": used,
        "bias": np.array([bias]),
        "weight": weight.astype(np.float32),
        "factors": factors.astype(np.float32),
    }


def score(model: dict[str, np.ndarray], index: list[int]) -> float:
    z = float(model["bias"][0])
    if index:
        v = model["factors"][index].astype(float)
        z += float(model["weight"][index].sum(dtype=float)) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def train(docs: DataFrame, labels: DataFrame, record_id: str = "doc_id", text: str = "text", label: str = "label") -> dict[str, np.ndarray]:
    """The model fitted on the sample of ``labels`` (id, 0/1); rows of ``labels`` are all that may be learnt from."""
    known = labels.select(F.col(f"`{record_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
    known = known.where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    by_hash = known.withColumn("_order", F.xxhash64("_id", F.lit(3)))
    sample = materialise(
        by_hash.where("_label = 0").orderBy("_order", "_id").limit(SAMPLE_PER_LABEL)
        .union(by_hash.where("_label = 1").orderBy("_order", "_id").limit(SAMPLE_PER_LABEL))
    )
    rows = docs.select(F.col(f"`{record_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = rows.join(F.broadcast(sample), "_id")  # at most twice the sample's bound

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = Terms()
            yield pd.DataFrame(
                {"_order": batch["_order"], "_label": batch["_label"], "_terms": [table.of(t) for t in batch["_text"]]}
            )

    def learn(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_order", kind="stable")
        fitted = fit([np.array(t, np.int64) for t in batch["_terms"]], batch["_label"].to_numpy())
        return pd.DataFrame({"name": list(fitted), "value": [x.tobytes() for x in fitted.values()]})

    found = rows.mapInPandas(extract, "_order long, _label int, _terms array<int>").dropDuplicates(["_order"])
    parts = {r["name"]: r["value"] for r in found.groupBy(F.lit("all").alias("part")).applyInPandas(learn, "name string, value binary").collect()}
    if not parts:
        return fit([], np.zeros(0))
    kinds = {"used": bool, "bias": float, "weight": np.float32, "factors": np.float32}
    model = {k: np.frombuffer(parts[k], kind) for k, kind in kinds.items()}
    return model | {"factors": model["factors"].reshape(-1, FACTORS)}


def scorer(docs: DataFrame, model: dict[str, np.ndarray]) -> Callable[[Column], Column]:
    """A column function: probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        table = Terms(fitted["used"])
        for texts in batches:
            yield pd.Series([score(fitted, table.of(t)) for t in texts], dtype=float)

    return scored
