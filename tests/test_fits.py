"""Fits that scale: forests go on from the nodes their rows reached, a search prepares its rows once, boosted trees of all classes
grow together."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, SPEED
from strideframe.operators.metrics import with_class_weights
from strideframe.plans import boosting, neural, training

FOREST = {"n_estimators": 3, "max_depth": 6, "max_features": "sqrt", "min_samples_leaf": 2}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i % 7, i, float(i * 37 % 101), float(i * 53 % 97), "walk" if i * 37 % 101 > 40 else "run", float(i % 5)) for i in range(400)]
    return spark.createDataFrame(data, "TRIAL int, TIME long, a double, b double, ACTIVITY string, SPEED double").repartition(2).cache()


def test_forests_keep_their_rows_nodes_and_give_the_same_model(rows):
    estimator = training.regressor_estimator("RF", FOREST, SPEED)
    assert estimator.getCacheNodeIds()
    assert training.classifier_estimator("RF", FOREST, 2, 400).getCacheNodeIds()
    stages = training.input_stages(["a", "b"], None)
    prepared = training.prepare(rows, stages, [SPEED]).persist()
    kept = estimator.fit(prepared)
    walked = estimator.copy({estimator.cacheNodeIds: False}).fit(prepared)
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_a_search_scales_once_and_finds_what_single_fits_find(rows, monkeypatch):
    calls = []
    given = neural.fit_scaler
    monkeypatch.setattr(neural, "fit_scaler", lambda *a: calls.append(a) or given(*a))
    train, held_out = rows.where("TIME < 300"), rows.where("TIME >= 300")
    model, losses = neural.mlp_grid_search(train, held_out, (4, 8), (4,), 5)
    assert len(calls) == 1
    found = {r.units1: r.val_loss for r in losses.collect()}
    assert set(found) == {4, 8}
    best = min(found, key=found.get)
    single = neural.fit_mlp(train, best, 4, 5)
    said, alone = ([r[0] for r in m.transform(held_out).orderBy("TIME").select(training.PREDICTION).collect()] for m in (model, single))
    assert said == alone and set(said) <= {r[0] for r in rows.select(ACTIVITY).collect()}


BOOSTED = {"bagging_fraction": 0.6, "feature_fraction": 0.6, "max_bin": 20, "max_depth": 3, "min_data_in_leaf": 20, "n_estimators": 5}


def structure(tree):
    """Splits of a tree as text, and its numbers."""
    words = tree.toDebugString.replace("(", " ").replace(")", " ").split()[5:]
    numbers = [w for w in words if "." in w]
    return [w for w in words if "." not in w], [float(w) for w in numbers]


# 12,000 rows are more than the thresholds of 20 bins are drawn from.
@pytest.mark.parametrize("n_rows", [300, 12_000])
def test_boosted_trees_of_all_classes_grow_together_and_are_sparks(spark, tmp_path, monkeypatch, n_rows):
    h = F.xxhash64("id")
    values = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(4000 // 3**k)) / 7 - 20).alias(f"v{k}.x") for k in range(4)]
    activity = F.element_at(F.array(*map(F.lit, ("walk", "run", "jump"))), (F.pmod(h, F.lit(5)) / 2 + 1).cast("int"))
    data = spark.range(0, n_rows, 1, 3).select(F.lit(0).alias("TRIAL"), F.col("id").alias("TIME"), *values, F.lit(0.0).alias("flat"), activity.alias(ACTIVITY))
    data = data.withColumn("v1.x", F.when(F.col(ACTIVITY) == "run", F.abs("`v1.x`")).otherwise(F.col("`v1.x`"))).persist()
    passes = []
    given = boosting.level_histograms
    monkeypatch.setattr(boosting, "level_histograms", lambda *a: passes.append(a[0]) or given(*a))
    fitted = training.fit_classifier(data, "LGBM", BOOSTED)
    assert len(passes) == 3 * 5  # one pass for a level of the trees of all three classes

    indexed = training.encode_labels(data).transform(with_class_weights(data, ACTIVITY))
    prepared = training.prepare(indexed, training.input_stages(training.feature_columns(data), None), ["_label", "weight"]).persist()
    estimator = training.classifier_estimator("LGBM", BOOSTED, 3, n_rows)
    single = estimator.fit(prepared)
    together = fitted.stages[-2]
    assert len(together.models) == len(single.models) == 3
    for ours, sparks in zip(together.models, single.models, strict=True):
        assert ours.treeWeights == sparks.treeWeights
        assert ours.getMaxIter() == sparks.getMaxIter() == 5
        assert ours.featureImportances.toArray() == pytest.approx(sparks.featureImportances.toArray())
        for a, b in zip(ours.trees, sparks.trees, strict=True):
            assert structure(a)[0] == structure(b)[0]
            assert structure(a)[1] == pytest.approx(structure(b)[1])
    path = str(tmp_path / "boosted")
    fitted.write().save(path)
    said = [r[0] for r in PipelineModel.load(path).transform(data).orderBy("TIME").select("_prediction").collect()]
    assert said == [r[0] for r in single.transform(prepared.select("_features")).select("_prediction").collect()]
    data.unpersist(), prepared.unpersist()


def test_checkpoints_of_boosted_trees_go(spark, rows, monkeypatch):
    gone = []
    given = boosting.delete_path
    monkeypatch.setattr(boosting, "delete_path", lambda spark, path: gone.append(path) or given(spark, path))
    training.fit_classifier(rows, "LGBM", BOOSTED | {"n_estimators": 22})
    assert len(gone) == len(set(gone)) == 2  # trees 10 and 20
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
