"""Rolling statistics: goldens, and all methods against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strideframe.operators.checks import (
    assert_schema,
    check_time_resets,
    feature_schema,
    full_channel_list,
    reattach_labels,
    schema_difference,
    trial_facts,
)
from strideframe.operators.extraction import feature_extraction
from strideframe.operators.rolling import CHUNK_SPAN, rolling_stats

METHODS = ["arrow", "plain", "blocked"]
VALUES = [10, 20, 30, 40, 50, 60, 70, 100, 90, 80]
SCHEMA = "TRIAL int, TIME long, ACTIVITY string, SPEED double, INCLINE long, Value double"


def trials(spark):
    rows = [(0, t, "A", 2.3, -1, v) for t, v in enumerate([10.0, 20.0, 30.0, 40.0])]
    rows += [(1, t, "B", None, 0, v) for t, v in enumerate([50.0, 60.0, 70.0])]
    rows += [(2, t, "A", 3.4, 1, v) for t, v in enumerate([80.0, 90.0, 100.0])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method", METHODS)
def test_single_trial(spark, method):
    df = spark.createDataFrame([(0, t, "A", None, None, float(v)) for t, v in enumerate(VALUES)], SCHEMA)
    rows = rolling_stats(df, ["Value"], 3, method=method).orderBy("TIME").collect()
    assert [r["TIME"] for r in rows] == list(range(2, 10))
    assert [r["max_Value"] for r in rows] == [30, 40, 50, 60, 70, 100, 100, 100]
    assert [r["min_Value"] for r in rows] == [10, 20, 30, 40, 50, 60, 70, 80]
    assert [r["mean_Value"] for r in rows] == pytest.approx([20, 30, 40, 50, 60, 76.66667, 86.66667, 90], rel=1e-5)
    assert [r["std_Value"] for r in rows] == pytest.approx([10, 10, 10, 10, 10, 20.81666, 15.27525, 10], rel=1e-5)


@pytest.mark.parametrize("method", METHODS)
def test_extraction_of_three_trials(spark, method):
    features = feature_extraction(trials(spark), 3, validate_schema=False, method=method)
    rows = features.orderBy("TRIAL", "TIME").collect()
    assert [tuple(r[c] for c in ("TRIAL", "TIME", "max_Value", "min_Value", "mean_Value", "std_Value")) for r in rows] == [
        (0, 2, 30, 10, 20, 10),
        (0, 3, 40, 20, 30, 10),
        (1, 2, 70, 50, 60, 10),
        (2, 2, 100, 80, 90, 10),
    ]
    assert [(r["ACTIVITY"], r["SPEED"], r["INCLINE"]) for r in rows] == [
        ("A", 2.3, -1), ("A", 2.3, -1), ("B", None, 0), ("A", 3.4, 1),
    ]


def test_time_must_reset(spark):
    df = trials(spark).withColumn("TIME", F.when(F.col("TRIAL") == 2, F.col("TIME") + 3).otherwise(F.col("TIME")))
    with pytest.raises(ValueError, match="trial 2 starts at 3"):
        check_time_resets(trial_facts(df))
    with pytest.raises(ValueError):
        feature_extraction(df, 3, validate_schema=False)
    # Without trial 1 before it, trial 2 is not checked.
    check_time_resets(trial_facts(df.filter("TRIAL <> 1")))


def brute(rows, period, stat):
    out = {}
    for trial, time, seq, _ in rows:
        frame = sorted(r[1:] for r in rows if r[0] == trial and time - period < r[1] <= time)
        known = [v for _, _, v in frame if v is not None]
        out[seq] = {
            "min": min(known, default=None),
            "max": max(known, default=None),
            "mean": statistics.fmean(known) if known else None,
            "std": statistics.stdev(known) if len(known) > 1 else None,
            "first": frame[0][2],
            "last": frame[-1][2],
        }[stat]
    return out


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("period", [1, 7, 300])
def test_irregular_time_with_ties_gaps_and_nulls(spark, method, period):
    rng = random.Random(period)
    rows = []
    for seq in range(600):
        time = rng.randint(0, 250) + rng.choice([0, CHUNK_SPAN - 100, 3 * CHUNK_SPAN])
        rows.append((rng.randint(0, 2), time, seq, None if rng.random() < 0.2 else rng.gauss(1e6, 1)))
    df = spark.createDataFrame(rows, "TRIAL int, TIME long, seq long, `a b.x` double")
    stats = ["min", "max", "mean", "std", "first", "last"]
    rolled = rolling_stats(df, ["a b.x"], period, stats, ["seq"], ["seq"], full_windows=False, method=method)
    got = {r["seq"]: r for r in rolled.collect()}
    assert len(got) == len(rows)
    for stat in stats:
        for seq, want in brute(rows, period, stat).items():
            value = got[seq][f"{stat}_a b.x"]
            assert value == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-6))


def test_nan_is_a_missing_sample(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (0, 2, 3.0)], "TRIAL int, TIME long, v double")
    for method in METHODS:
        row = rolling_stats(df, ["v"], 3, ["max", "mean", "last"], method=method).first()
        assert (row["max_v"], row["mean_v"], row["last_v"]) == (3.0, 2.0, 3.0)


def test_bad_arguments(spark):
    df = trials(spark)
    with pytest.raises(ValueError, match="median"):
        rolling_stats(df, ["Value"], 3, ["median"])
    with pytest.raises(ValueError, match="period"):
        rolling_stats(df, ["Value"], 0)
    with pytest.raises(ValueError, match="method"):
        rolling_stats(df, ["Value"], 3, method="other")


def test_long_trial_is_spread_with_one_shuffle(spark):
    """One trial, many chunks: no window or task is keyed by the trial alone."""
    df = spark.range(5 * CHUNK_SPAN).select(
        F.floor(F.col("id") / 1e9).alias("TRIAL"), F.col("id").alias("TIME"), (F.col("id") % 97).cast("double").alias("v")
    )
    for method in METHODS:
        rolled = rolling_stats(df, ["v"], 5, ["max"], method=method)
        plan = rolled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
        assert "_chunk" in next(line for line in plan.splitlines() if "Exchange" in line)
        assert rolled.filter(F.col("max_v") != F.when(F.col("TIME") % 97 < 4, 96).otherwise(F.col("TIME") % 97)).count() == 0
        assert rolled.count() == 5 * CHUNK_SPAN - 4


def test_full_schema():
    channels = full_channel_list()
    assert len(channels) == 107
    schema = feature_schema(channels, ["max", "min", "mean", "std"])
    assert len(schema) == 433
    assert "std_right foot sensor.rfs" in schema.names


def test_schema_check(spark):
    stats = ["max", "min", "mean", "std"]
    features = feature_extraction(trials(spark), 3, stats, validate_schema=False)
    expected = feature_schema(["Value"], stats)
    assert schema_difference(assert_schema(features, expected), expected) == []
    with pytest.raises(ValueError, match="max_Value"):
        assert_schema(features, feature_schema(["Other"], stats))
    with pytest.raises(ValueError, match="on one side only"):
        feature_extraction(trials(spark), 3)


def test_last_label_of_a_trial_wins(spark):
    df = trials(spark).withColumn("ACTIVITY", F.concat("ACTIVITY", F.col("TIME").cast("string")))
    rows = reattach_labels(df.select("TRIAL", "TIME"), df).select("TRIAL", "ACTIVITY").distinct().collect()
    assert {tuple(r) for r in rows} == {(0, "A3"), (1, "B2"), (2, "A2")}
