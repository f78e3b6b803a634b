"""Feed-forward activity classifier with two hidden layers, and its search over layer sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, col, schema_components
from strideframe.operators.metrics import classification_scores
from strideframe.operators.scale import fit_scaler
from strideframe.operators.split import TEST, TRAIN, sequential_split
from strideframe.plans.hyperparameters import SEED
from strideframe.plans.training import PREDICTION, encode_labels, feature_columns, input_stages, prepare
from strideframe.sources.tables import run_record, write_run


def mlp_inputs(train: DataFrame, features: Sequence[str], label: str) -> tuple[list[Transformer], StringIndexerModel, DataFrame]:
    """(stages, classes, rows): scaling and assembly, and the standardised rows that any network of these features reads."""
    stages = input_stages(features, fit_scaler(train, features))
    indexer = encode_labels(train, label)
    return stages, indexer, prepare(indexer.transform(train), stages, ["_label"])


def fit_network(prepared: DataFrame, layers: Sequence[int], epochs: int) -> MultilayerPerceptronClassificationModel:
    network = MultilayerPerceptronClassifier(
        layers=list(layers),
        maxIter=epochs,
        seed=SEED,
        featuresCol="_features",
        labelCol="_label",
        predictionCol="_prediction",
    )
    return network.fit(prepared)


def fit_mlp(
    train: DataFrame,
    neurons1: int,
    neurons2: int,
    epochs: int = 10,
    features: Sequence[str] | None = None,
    label: str = ACTIVITY,
) -> PipelineModel:
    """Standardised features through two hidden layers to one output per class."""
    features = list(features) if features is not None else feature_columns(train)
    stages, indexer, prepared = mlp_inputs(train, features, label)
    prepared = prepared.persist()
    try:
        fitted = fit_network(prepared, [len(features), neurons1, neurons2, len(indexer.labels)], epochs)
    finally:
        prepared.unpersist()
    names = IndexToString(inputCol="_prediction", outputCol=PREDICTION, labels=indexer.labels)
    return PipelineModel([*stages, fitted, names])


def mlp_grid_search(
    train: DataFrame,
    held_out: DataFrame,
    units1: Sequence[int] = (32, 128, 512),
    units2: Sequence[int] = (32, 128, 512),
    epochs: int = 10,
    label: str = ACTIVITY,
) -> tuple[PipelineModel, DataFrame]:
    """Best model by log loss on the held-out part, and the loss of every setting.

    The held-out part is given, because the sequential split must not be replaced by a random one. Both parts are scaled
    and assembled once for all settings.
    """
    network = MultilayerPerceptronClassifier
    grid = ParamGridBuilder().addGrid(network.layers, [[a, b] for a in units1 for b in units2]).build()
    features = feature_columns(train)
    stages, indexer, prepared = mlp_inputs(train, features, label)
    evaluator = MulticlassClassificationEvaluator(
        labelCol="_label", predictionCol="_prediction", probabilityCol="probability", metricName="logLoss"
    )
    prepared = prepared.persist()
    held_out = prepare(indexer.transform(held_out), stages, ["_label"]).persist()
    best, rows = None, []
    try:
        for setting in grid:
            neurons1, neurons2 = setting[network.layers]
            fitted = fit_network(prepared, [len(features), neurons1, neurons2, len(indexer.labels)], epochs)
            loss = evaluator.evaluate(fitted.transform(held_out))
            if best is None or loss < best[0]:
                best = (loss, fitted)
            rows.append((neurons1, neurons2, float(loss)))
    finally:
        prepared.unpersist()
        held_out.unpersist()
    names = IndexToString(inputCol="_prediction", outputCol=PREDICTION, labels=indexer.labels)
    best_model = PipelineModel([*stages, best[1], names])
    losses = train.sparkSession.createDataFrame(rows, "units1 int, units2 int, val_loss double")
    return best_model, losses.orderBy("val_loss", "units1", "units2")


def train_network(
    features: DataFrame,
    output_dir: str | None = None,
    window: int = 800,
    split: float = 0.8,
    units1: Sequence[int] = (32, 128, 512),
    units2: Sequence[int] = (32, 128, 512),
    epochs: int = 10,
    ties: Sequence[str] = (),
) -> tuple[PipelineModel, DataFrame]:
    """Split by activity, search the layer sizes, score the best network: (model, run record).

    With ``output_dir`` the model and the record are written below ``output_dir/neural_net``.
    """
    columns = [c for c in features.columns if c not in ties]
    parted = sequential_split(features, split, window, [ACTIVITY], ties)
    parted = parted.select(*[col(c) for c in columns], "part").persist()
    try:
        train, held_out = (parted.filter(F.col("part") == part) for part in (TRAIN, TEST))
        model, losses = mlp_grid_search(train, held_out, units1, units2, epochs)
        best = losses.first()
        scores = classification_scores(model.transform(held_out), ACTIVITY, PREDICTION).first()
    finally:
        parted.unpersist()
    hyperparams = {"units1": best["units1"], "units2": best["units2"]}
    params = {"window": window, "split": split, **schema_components(columns), "hyperparams": hyperparams}
    run = run_record(features.sparkSession, "neural_net", {"activity": scores["accuracy"]}, params)
    if output_dir is not None:
        base = f"{output_dir.rstrip('/')}/neural_net"
        model.write().overwrite().save(f"{base}/activity")
        write_run(run, f"{base}/output")
    return model, run
