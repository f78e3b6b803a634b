"""Models by contract: what comes out, that they learn, that they survive saving."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, SPEED
from strideframe.operators.checks import full_channel_list
from strideframe.operators.metrics import classification_scores, regression_scores
from strideframe.operators.scale import fit_scaler
from strideframe.operators.split import sequential_split
from strideframe.plans import neural, scoring, training
from strideframe.plans.hyperparameters import boosting_params
from strideframe.plans.workflow import extract_features, run_workflow
from strideframe.sources.tables import read_hyperparameters, read_ledger, read_run

SMALL = {
    "LR": {},
    "RF": {"max_depth": 5, "max_features": "sqrt", "min_samples_leaf": 2, "n_estimators": 5, "bootstrap": True},
    "LGBM": {
        "bagging_fraction": 0.6, "feature_fraction": 0.6, "max_bin": 255, "max_depth": 3,
        "min_data_in_leaf": 5, "n_estimators": 5,
    },
}


@pytest.fixture(scope="module")
def features(spark):
    """Three activities whose channels tell them apart; jumps have no speed."""
    t = F.col("TIME")
    trial = F.col("TRIAL")
    activity = F.element_at(F.array(F.lit("walk"), F.lit("run"), F.lit("jump")), (trial % 3 + 1).cast("int"))
    speed = F.when(trial % 3 == 2, None).otherwise(F.lit(1.5) + trial % 3)
    df = spark.range(600).select((F.col("id") / 60).cast("int").alias("TRIAL"), (F.col("id") % 60).alias("TIME"))
    df = df.select(
        "TRIAL",
        "TIME",
        (trial % 3 * 10 + F.sin(t)).alias("max_accel_shank_l.x"),
        F.cos(t * trial).alias("min_gyro_pelvis.z"),
        activity.alias("ACTIVITY"),
        speed.cast("double").alias("SPEED"),
        F.when(trial % 3 != 2, trial % 2 * 5).cast("long").alias("INCLINE"),
    )
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()


@pytest.fixture(scope="module")
def parted(features):
    return sequential_split(features, 0.8, 3, [ACTIVITY]).cache()


def halves(parted):
    return parted.filter("part = 'train'"), parted.filter("part = 'test'")


@pytest.mark.parametrize("family", ["LR", "RF", "LGBM"])
def test_classifier(parted, tmp_path, family):
    train, test = halves(parted)
    scaler = fit_scaler(train, training.feature_columns(train)) if family == "LR" else None
    model = training.fit_classifier(train, family, SMALL[family], scaler)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert training.model_features(loaded) == ["max_accel_shank_l.x", "min_gyro_pelvis.z"]
    scores = classification_scores(loaded.transform(test), ACTIVITY, training.PREDICTION).first()
    assert scores["n"] == test.count()
    assert scores["accuracy"] > 0.9


@pytest.mark.parametrize("family", ["LR", "RF", "LGBM"])
def test_regressor_skips_rows_without_target(parted, family):
    train, test = halves(parted)
    model = training.fit_regressor(train, family, SPEED, SMALL[family])
    scores = regression_scores(model.transform(training.with_target(test, SPEED)), SPEED, training.PREDICTION).first()
    assert scores["n"] == test.filter("SPEED is not null").count()
    assert scores["r2"] > 0.9
    if family != "LR":
        rows = training.feature_importances(train, model).collect()
        assert [r["feature"] for r in rows][0] == "max_accel_shank_l.x"
        assert sum(r["importance"] for r in rows) == pytest.approx(1)


def test_unknown_family(parted):
    train, _ = halves(parted)
    with pytest.raises(ValueError, match="SVM"):
        training.fit_regressor(train, "SVM", SPEED, {})


def test_labels_are_encoded_in_alphabetical_order(parted):
    indexer = training.encode_labels(parted)
    assert indexer.labels == ["jump", "run", "walk"]


def test_run_and_application(spark, features, tmp_path):
    out = str(tmp_path / "models")
    result = training.multipredictor(features, "LR_t", "LR", 5, 0.7, output_dir=out, save=True)
    run = result["run"].first()
    assert run["score"]["activity"] > 0.95
    assert run["params"]["statistic"] == ["max", "min"]
    assert read_run(spark, f"{out}/LR_t/output").first()["score"]["activity"] == run["score"]["activity"]
    assert {r["labels"] for r in result["confusion"].collect()} == {"walk", "run", "jump"}

    # Unseen data may hold its columns in another order, and more of them.
    shuffled = features.select(*[f"`{c}`" for c in reversed(features.columns)]).withColumn("std_more.x", F.lit(1.0))
    ledger = str(tmp_path / "ledger")
    shuffled.write.parquet(str(tmp_path / "unseen.parquet"))
    for feature, name in ((ACTIVITY, "activity"), (SPEED, "speed")):
        scored = scoring.apply_model_file(spark, str(tmp_path / "unseen.parquet"), feature, f"{out}/LR_t/{name}", ledger)
        assert ("confusion" in scored) == (feature == ACTIVITY)
    rows = {r["feature"]: r for r in read_ledger(spark, ledger).collect()}
    assert (rows[ACTIVITY]["val_data"], rows[ACTIVITY]["run_id"], rows[ACTIVITY]["plot_path"]) == ("unseen", "LR_t", "LR_t_cm")
    assert rows[ACTIVITY]["score"] > 0.95
    assert rows[ACTIVITY]["rmse"] is None
    assert rows[SPEED]["rmse"] < 0.5
    with pytest.raises(ValueError, match="HEIGHT"):
        scoring.apply_model(features, "HEIGHT", out, "x")


def test_tree_run_writes_importances(features, tmp_path):
    result = training.multipredictor(
        features, "RF_t", "RF", 5, 0.7, SMALL["RF"], output_dir=str(tmp_path), histograms=True
    )
    speeds = result["histogram_speed"].filter("series = 'actual'").orderBy("low").collect()
    assert [r["low"] for r in speeds] == [1.5, 2.5]
    binned = result["histogram_speed"].filter("series = 'binned'").agg(F.sum("count")).first()[0]
    assert binned == sum(r["count"] for r in speeds)
    assert set(result["balance_activity"].columns) == {"ACTIVITY", "proportion", "proportion_test", "diff"}
    assert result["balance_speed"].count() >= 0
    assert result["importances_speed"].count() == result["importances_incline"].count() == 2
    assert (tmp_path / "RF_t" / "feature_importances_speed").is_dir()
    assert not (tmp_path / "RF_t" / "activity").exists()


def test_network_and_its_search(parted):
    train, test = halves(parted)
    model, losses = neural.mlp_grid_search(train, test, (8,), (4, 8), epochs=30)
    rows = losses.collect()
    assert [r["val_loss"] for r in rows] == sorted(r["val_loss"] for r in rows)
    scores = classification_scores(model.transform(test), ACTIVITY, training.PREDICTION).first()
    assert scores["accuracy"] > 0.9


def test_network_job(spark, features, tmp_path):
    _, run = neural.train_network(features, str(tmp_path), 5, 0.7, (8,), (8,), epochs=30)
    row = run.first()
    assert row["score"]["activity"] > 0.9
    assert row["score"]["speed_r2"] is None
    assert row["params"]["hyperparams"] == {"units1": "8", "units2": "8"}
    saved = PipelineModel.load(f"{tmp_path}/neural_net/activity")
    assert training.model_features(saved) == ["max_accel_shank_l.x", "min_gyro_pelvis.z"]


def test_hyperparameters_from_json(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps({"LGBM": {"max_depth": 3, "extra_trees": True, "min_data_in_leaf": 50}}))
    params = read_hyperparameters(spark, str(path))["LGBM"]
    assert boosting_params(params)["maxIter"] == 100
    assert boosting_params(params)["minInstancesPerNode"] == 50


def test_features_of_the_full_sensor_set(spark, tmp_path):
    channels = full_channel_list()
    rows = spark.range(12).select(
        (F.col("id") % 2).cast("int").alias("TRIAL"),
        F.floor(F.col("id") / 2).alias("TIME"),
        *[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(channels)],
        F.lit("walk").alias("ACTIVITY"),
        F.lit(1.5).cast("float").alias("SPEED"),
        F.lit(2).cast("smallint").alias("INCLINE"),
    )
    rows.write.parquet(str(tmp_path / "interim"))
    features = extract_features(spark, str(tmp_path / "interim"), str(tmp_path / "features"), 4)
    assert len(features.columns) == 433
    row = features.filter("TRIAL = 1 AND TIME = 5").first()
    # Values 5, 7, 9, 11 times the channel's place.
    last = channels[-1]
    assert (row[f"min_{last}"], row[f"max_{last}"], row[f"mean_{last}"]) == (5 * 107, 11 * 107, 8 * 107)
    assert row[f"std_{last}"] == pytest.approx(107 * (20 / 3) ** 0.5)


def test_workflow_from_recordings(spark, tmp_path):
    """Two trials, five channels, as in an end-to-end run of the whole job."""
    labels = ["accel_shank_l.x", "accel_shank_l.y", "mag_foot_r.x", "mag_foot_r.y", "gyro_pelvis.z"]
    files = [("P1", "P1_Walk_1_7ms_10Incline.c3d"), ("P2", "P2_Run_3_0ms_5Decline.c3d")]
    frames = spark.range(1500).select(
        F.col("id").alias("frame"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), F.lit(1000.0).alias("rate")
    )
    samples = None
    for i, (participant, filename) in enumerate(files):
        part = frames.select(
            F.lit(participant).alias("participant"), F.lit(filename).alias("filename"), "frame", "label",
            (F.pmod(F.xxhash64("frame", "label", F.lit(i)), F.lit(1000)) / 1000 + i).alias("value"), "rate",
        )
        samples = part if samples is None else samples.union(part)
    runs = run_workflow(
        samples, str(tmp_path), ["LR", "RF"], "t", None, (), 100, 0.7, dimensions=["x", "y", "z"],
        measures=["accel", "mag", "gyro"], stats=["min", "max", "mean", "std"], params=SMALL,
    )
    rows = {r["run"]: r for r in runs.collect()}
    assert set(rows) == {"LR_t", "RF_t"}
    features = spark.read.parquet(f"{tmp_path}/features")
    assert len(features.columns) == 5 * 4 + 5
    assert features.agg(F.min("TIME"), F.max("TIME"), F.count("*")).first()[:] == (99, 1499, 2 * 1401)
    assert {tuple(r) for r in features.select("ACTIVITY", F.round("SPEED", 3), "INCLINE").distinct().collect()} == {
        ("walk", 1.7, 10), ("run", 3.0, -5),
    }
    assert all(r["score"]["activity"] > 0.9 for r in rows.values())
    assert (tmp_path / "models" / "RF_t" / "speed").is_dir()
