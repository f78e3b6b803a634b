"""Counts, weights, scores, histogram, importances."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import metrics
from strideframe.sources import tables
from strideframe.sources.tables import append_ledger, path_parent, path_stem, read_importances, write_importances


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y string, p string")


def test_confusion_matrix_keeps_empty_classes(spark):
    df = pairs(spark, [("walk", "walk"), ("walk", "run"), ("walk", "run"), ("run", "run"), ("run", "climb")])
    rows = {r["labels"]: r for r in metrics.confusion_matrix(df, ["run", "walk", "jump"], "y", "p").collect()}
    assert [rows["walk"][c] for c in ("run", "walk", "jump")] == pytest.approx([2 / 3, 1 / 3, 0])
    # ``climb`` is not among the labels, so its row leaves the row sum.
    assert [rows["run"][c] for c in ("run", "walk", "jump")] == [1, 0, 0]
    assert [rows["jump"][c] for c in ("run", "walk", "jump")] == [0, 0, 0]


def test_classification_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abbbc"), rng.choice("abbd")) for _ in range(300)]
    classes = {x for r in rows for x in r}
    f1 = 0.0
    for c in classes:
        right = sum(y == p == c for y, p in rows)
        support, predicted = sum(y == c for y, _ in rows), sum(p == c for _, p in rows)
        f1 += support * (2 * right / (support + predicted))
    got = metrics.classification_scores(pairs(spark, rows), "y", "p").first()
    assert got["n"] == 300
    assert got["accuracy"] == pytest.approx(sum(y == p for y, p in rows) / 300)
    assert got["weighted_f1"] == pytest.approx(f1 / 300)


def test_scores_of_nothing(spark):
    assert tuple(metrics.classification_scores(pairs(spark, []), "y", "p").first()) == (None, None, None)
    empty = spark.createDataFrame([], "y double, p double")
    assert metrics.regression_scores(empty, "y", "p").first()["rmse"] is None


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (None, 9.0)], "y double, p double")
    got = metrics.regression_scores(df, "y", "p").first()
    spread = (1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2
    assert (got["n"], got["rmse"], got["mae"]) == (3, pytest.approx((2 / 3) ** 0.5), pytest.approx(2 / 3))
    assert got["r2"] == pytest.approx(1 - 2 / spread)
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, p double")
    assert metrics.regression_scores(constant, "y", "p").first()["r2"] == 0


def histogram(rows):
    """The three series by comparing every prediction with every edge."""
    values = sorted({y for y, _ in rows})
    edges = [values[0] - (values[1] - values[0]) / 2]
    edges += [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    edges.append(values[-1] + (values[-1] - values[-2]) / 2)
    out = {("actual", v, v): sum(y == v for y, _ in rows) for v in values}

    def count(low, high, last):
        return sum(low <= p < high or (last and p == high) for _, p in rows)

    for i in range(len(values)):
        out["binned", edges[i], edges[i + 1]] = count(edges[i], edges[i + 1], i == len(values) - 1)
    least, most = min(p for _, p in rows), max(p for _, p in rows)
    width = (most - least) / 120
    fine = [least + i * width for i in range(120)] + [most]
    for i in range(120):
        out["fine", fine[i], fine[i + 1]] = count(fine[i], fine[i + 1], i == 119) * (120 // len(edges))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_regression_histogram(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1.0, 1.0, 1.5, 4.0, 5.0]), rng.choice([2.75, round(rng.uniform(0, 6), 2)])) for _ in range(400)]
    rows += [(1.0, 0.75), (1.0, 5.5), (1.0, -3.0), (1.0, 9.0)]
    df = spark.createDataFrame([*rows, (None, 2.0)], "y double, p double")
    got = {(r["series"], r["low"], r["high"]): r["count"] for r in metrics.regression_histogram(df, "y", "p").collect()}
    want = histogram(rows)
    assert {(s, round(a, 9), round(b, 9)): n for (s, a, b), n in got.items()} == {
        (s, round(a, 9), round(b, 9)): n for (s, a, b), n in want.items()
    }


def test_histogram_needs_two_true_values(spark):
    with pytest.raises(ValueError, match="two distinct"):
        metrics.regression_histogram(spark.createDataFrame([(1.0, 1.0)], "y double, p double"), "y", "p")


def test_weights_are_inverse_shares(spark):
    df = spark.createDataFrame([(0, t, a) for t, a in enumerate("aaab")], "TRIAL int, TIME int, ACTIVITY string")
    weights = {r["ACTIVITY"]: r["weight"] for r in metrics.with_class_weights(df).collect()}
    assert weights == {"a": pytest.approx(4 / 3), "b": 4.0}
    assert metrics.label_list(df.withColumn("TIME", -F.col("TIME"))) == ["b", "a"]


def test_importances_round_trip_and_rollup(spark, tmp_path):
    scores = {
        "min_gyro_shank_r.z": 0.5, "max_gyro_thigh_l.z": 0.25, "min_accel_shank_r.x": 0.125, "max_left foot sensor.lfs": 0.0625,
    }
    path = str(tmp_path / "importances")
    df = spark.createDataFrame(list(reversed(scores.items())), "feature string, importance double")
    write_importances(df, path)
    text = next((tmp_path / "importances").glob("part-*")).read_text()
    assert list(json.loads(text).items()) == list(scores.items())
    rolled = metrics.importance_rollup(read_importances(spark, path)).collect()
    got = {}
    for r in rolled:
        got.setdefault(r["component"], []).append((r["value"], r["importance"]))
    assert got == {
        "statistic": [("min", 0.625), ("max", 0.3125)],
        "measure": [("gyro", 0.75), ("accel", 0.125)],
        "location": [("shank_r", 0.625), ("thigh_l", 0.25), ("left foot sensor", 0.0625)],
        "dimension": [("z", 0.75), ("x", 0.125)],
    }


def test_paths(spark):
    row = spark.range(1).select(
        path_stem(F.lit("a/b.c/d.e.parquet")), path_stem(F.lit("plain")), path_parent(F.lit("m/run_1/speed")), path_parent(F.lit("x"))
    )
    assert tuple(row.first()) == ("d.e", "plain", "run_1", "")


def test_ledger_grows(spark, tmp_path):
    row = spark.createDataFrame([("d", "r", "SPEED", 0.5, None, 1.25)], tables.LEDGER_SCHEMA)
    path = str(tmp_path / "ledger")
    assert append_ledger(row, path).count() == 1
    assert [tuple(r) for r in append_ledger(row, path).collect()] == [("d", "r", "SPEED", 0.5, None, 1.25)] * 2
