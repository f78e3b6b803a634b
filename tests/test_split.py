"""Sequential split, balance, positions and look-ups."""

import random

import pytest
from pyspark.sql import functions as F

from strideframe import storage
from strideframe.operators import split as split_module
from strideframe.operators.positions import row_position, running_sum, sorted_index
from strideframe.operators.scale import apply_scaler, fit_scaler
from strideframe.operators.split import compare_balance, sequential_split
from strideframe.storage import lookup_join, materialise


@pytest.fixture
def sample(spark):
    rows = list(
        zip(
            [0, 0, 0, 0, 1, 1, 1, 2, 2, 2],
            [0, 1, 2, 3, 0, 1, 2, 3, 4, 5],
            "AAAABBBAAA",
            [10, 20, 30, 40, 50, 60, 70, 80, 90, 100],
            strict=True,
        )
    )
    return spark.createDataFrame(rows, "TRIAL int, TIME int, ACTIVITY string, Value int")


def parts(df):
    found = {"train": [], "test": [], "gap": []}
    for r in df.orderBy("TRIAL", "TIME").collect():
        found[r["part"]].append(r["Value"])
    return found


def test_golden_split(sample):
    assert parts(sequential_split(sample, 0.8)) == {"train": [10, 20, 30, 40, 50, 60, 80], "test": [70, 90, 100], "gap": []}


def test_gap_beyond_the_stratum(sample):
    with pytest.raises(ValueError, match="gap of 4 rows"):
        sequential_split(sample, 0.8, gap=4)


@pytest.mark.parametrize("size", [-0.8, 1.8])
def test_train_size_out_of_range(sample, size):
    with pytest.raises(ValueError, match="share of the rows"):
        sequential_split(sample, size)


def test_all_or_nothing_for_training(sample):
    assert parts(sequential_split(sample, 1.0))["test"] == []
    # The first trial of a stratum moves into training, unless it is the only one.
    assert parts(sequential_split(sample, 0.0))["train"] == [10, 20, 30, 40]


def test_null_strata(spark, sample):
    holes = sample.withColumn("SPEED", F.when(F.col("TRIAL") != 1, F.lit(1.5)))
    assert sequential_split(holes, 0.5, strata=["SPEED"]).count() == 7
    assert sequential_split(holes, 0.5, strata=["ACTIVITY", "SPEED"]).count() == 10


def transcribed(rows, train_size, gap):
    """The rule row by row: cut at k, moved to the next row of another trial if there is one."""
    out = {}
    for key in {r[2] for r in rows}:
        stratum = sorted(r for r in rows if r[2] == key)
        k = int(train_size * len(stratum))
        cut = next((i for i in range(k, len(stratum)) if stratum[i][0] != stratum[k][0]), k)
        if cut + gap > len(stratum):
            return None
        for i, r in enumerate(stratum):
            out[r] = "train" if i < cut else "test" if i >= cut + gap else "gap"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_split_equals_the_rule(spark, monkeypatch, seed):
    """Random strata, one of them and one trial holding most rows, with boundaries narrowed down in small steps."""
    monkeypatch.setattr(split_module, "ORDERED_ROWS", 5)
    monkeypatch.setattr(split_module, "CELLS", 4)
    monkeypatch.setattr(split_module, "TRIAL_SPAN", 3)
    rng = random.Random(seed)
    rows = []
    for trial in range(12):
        for time in range(200 if trial == 5 else rng.randint(20, 40)):
            for tie in range(rng.choice([1, 1, 2])):
                rows.append((trial, time, rng.choice("AAAAAB"), tie))
    df = spark.createDataFrame(rows, "TRIAL int, TIME long, ACTIVITY string, seq int")
    for size, gap in [(0.29, 3), (0.8, 0), (0.55, 17), (0.0, 1), (0.8, 500)]:
        want = transcribed(rows, size, gap)
        if want is None:
            with pytest.raises(ValueError):
                sequential_split(df, size, gap, ties=["seq"])
            continue
        got = {tuple(r)[:4]: r["part"] for r in sequential_split(df, size, gap, ties=["seq"]).collect()}
        assert got == want


def test_split_does_not_shuffle_the_table(spark, sample):
    plan = sequential_split(sample, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "Window" not in plan


def test_balance(spark):
    d1, d2, d3 = (
        spark.createDataFrame([(a,) for a in text.split()], "ACTIVITY string")
        for text in ("walk walk run run", "walk walk walk run run run", "walk walk walk run")
    )
    assert compare_balance(d1, d2).collect() == []
    rows = compare_balance(d1, d3).orderBy("ACTIVITY").collect()
    assert [tuple(r) for r in rows] == [("run", 0.25, 0.5, 0.25), ("walk", 0.75, 0.5, 0.25)]
    with pytest.raises(ValueError, match="cannot compare"):
        compare_balance(d1, d2.withColumnRenamed("ACTIVITY", "other"))


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_sum_with_a_hot_group_and_a_hot_value(spark, ranges):
    rng = random.Random(ranges)
    rows = [
        (rng.choice("aaaab"), float(rng.choice([5, 5, 5, rng.randint(0, 500)])), i, rng.randint(0, 9)) for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "g string, o double, i int, w int")
    got = running_sum(df, F.col("o"), "s", F.col("w"), ["g"], ["i"], ranges).collect()
    totals, want = {}, {}
    for g, o, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        totals[g] = totals.get(g, 0) + w
        want[i] = totals[g]
    assert {r["i"]: r["s"] for r in got} == want
    places = row_position(df, F.col("o"), "p", ties=["i"], ranges=ranges).orderBy("p").collect()
    assert [r["i"] for r in places] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert [r["p"] for r in places] == list(range(2000))


def test_running_sum_of_nothing(spark):
    empty = spark.createDataFrame([], "o double, i int")
    assert row_position(empty, F.col("o"), "p").collect() == []


def test_sorted_index_by_strings(spark):
    words = [f"w{(i * 7919) % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(16)
    rows = sorted_index(df, [F.desc("w")], "i").collect()
    assert {r["w"]: r["i"] for r in rows} == {w: i for i, w in enumerate(sorted(words, reverse=True))}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_gives_the_same_rows_either_way(spark, how):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = materialise(spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string"))
    small = lookup_join(rows, table, ["k"], [F.col("id")], how)
    large = lookup_join(rows, table, ["k"], [F.col("id")], how, max_bytes=0)
    assert sorted(map(tuple, small.select("k", "id", "v").collect()), key=str) == sorted(
        map(tuple, large.select("k", "id", "v").collect()), key=str
    )
    assert "salt" in large._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_folder_is_the_one_the_session_names(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == storage.CHECKPOINT_CONF else default

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    assert storage.shared_dir(Session()) == str(tmp_path)


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "`a.x` double, b double")
    scaler = fit_scaler(train, ["a.x", "b"])
    assert scaler["a.x"] == (2.0, pytest.approx((2 / 3) ** 0.5))
    assert scaler["b"] == (5.0, 1.0)
    row = apply_scaler(spark.createDataFrame([(4.0, 6.0)], "`a.x` double, b double"), scaler).first()
    assert tuple(row) == (pytest.approx(2 / (2 / 3) ** 0.5), 1.0)


@pytest.mark.parametrize("same", [True, False])
def test_rows_of_equal_time_are_shared(spark, same):
    """Without ties: ten rows of one TIME, equal or not, and a stratum whose boundaries both fall into equal rows."""
    rows = [(0, 5, "A", 0 if same else i) for i in range(10)]
    rows += [(1, t, "B", 0 if same else i) for i, t in enumerate([1, 2, *[3] * 20, 4])]
    df = spark.createDataFrame(rows, "TRIAL int, TIME int, ACTIVITY string, Value int")
    for size, gap, want in [
        (0.5, 0, {"A": (5, 0, 5), "B": (11, 0, 12)}),
        (0.5, 3, {"A": (5, 3, 2), "B": (11, 3, 9)}),
        (0.1, 4, {"A": (1, 4, 5), "B": (2, 4, 17)}),
    ]:
        out = sequential_split(df, size, gap).cache()
        assert out.columns == [*df.columns, "part"]
        assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(rows)
        n = {(r["ACTIVITY"], r["part"]): r["count"] for r in out.groupBy("ACTIVITY", "part").count().collect()}
        assert {a: tuple(n.get((a, p), 0) for p in ("train", "gap", "test")) for a in "AB"} == want
        parts_of = lambda: sorted(map(tuple, sequential_split(df.repartition(3), size, gap).collect()))
        assert sorted(map(tuple, out.collect())) == parts_of()
