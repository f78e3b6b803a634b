"""Training runs on Spark ML: one activity classifier and two regressors per model family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.names import (
    ACTIVITY,
    INCLINE,
    KEYS,
    SPEED,
    TIME,
    TRIAL,
    channel_columns,
    col,
    q,
    schema_components,
)
from strideframe.operators.metrics import (
    classification_scores,
    confusion_matrix,
    label_list,
    regression_histogram,
    regression_scores,
    with_class_weights,
)
from strideframe.operators.scale import fit_scaler, scaler_stage
from strideframe.operators.split import TEST, TRAIN, sequential_split, split_balance
from strideframe.plans.boosting import fit_boosted
from strideframe.plans.hyperparameters import FAMILIES, HYPERPARAMETERS, boosting_params, forest_params
from strideframe.sources.tables import run_record, write_importances, write_run
from strideframe.storage import shared_dir

SCALED = "_scaled "
PREDICTION = "prediction"

#: Classes of a one-vs-rest model trained at the same time.
MAX_PARALLEL_FITS = 8


def feature_columns(df: DataFrame) -> list[str]:
    """Columns of the design matrix: everything but keys, targets and the part."""
    return channel_columns(df.columns, (*KEYS, "part"))


def input_stages(features: Sequence[str], scaler: Mapping | None) -> list[Transformer]:
    """Scaling (where a scaler is given), assembly in training column order, and dropping the inputs.

    The inputs go because one-vs-rest models cannot carry columns whose names hold dots.
    """
    prefix = SCALED if scaler else ""
    inputs = [q(prefix + c) for c in features]
    used = [q(c) for c in features] + (inputs if scaler else [])
    assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(used)}) FROM __THIS__")
    return ([scaler_stage(scaler, SCALED)] if scaler else []) + [assembler, drop]


def prepare(df: DataFrame, stages: Sequence[Transformer], keep: Sequence[str]) -> DataFrame:
    """Assembled features and the kept columns: all a learner reads."""
    for stage in stages:
        df = stage.transform(df)
    return df.select("_features", *keep)


def encode_labels(df: DataFrame, column: str = ACTIVITY) -> StringIndexerModel:
    """Classes in alphabetical order to 0..k-1; an unknown class is an error."""
    indexer = StringIndexer(
        inputCol=column, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error"
    )
    return indexer.fit(df.select(col(column)))


def classifier_estimator(family: str, params: Mapping, n_classes: int, n_rows: int):
    columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction", "weightCol": "weight"}
    if family == "RF":
        return RandomForestClassifier(**forest_params(dict(params)), **columns)
    if family == "LR":
        # The penalty weighs 1 against the summed losses; Spark averages them over the weights,
        # which add up to (classes x rows).
        base = LogisticRegression(standardization=False, elasticNetParam=0.0, regParam=1.0 / (n_classes * n_rows))
    elif family == "LGBM":
        base = GBTClassifier(**boosting_params(dict(params)))
    else:
        raise ValueError(f"unknown model family {family!r}, expected one of {list(FAMILIES)}")
    return OneVsRest(classifier=base, parallelism=min(n_classes, MAX_PARALLEL_FITS), **columns)


def fit_classifier(
    train: DataFrame,
    family: str,
    params: Mapping | None = None,
    scaler: Mapping | None = None,
    features: Sequence[str] | None = None,
    label: str = ACTIVITY,
) -> PipelineModel:
    """Classifier weighted by inverse class share; the model adds ``prediction`` as a class name."""
    params = HYPERPARAMETERS[family] if params is None else params
    features = list(features) if features is not None else feature_columns(train)
    indexer = encode_labels(train, label)
    stages = input_stages(features, scaler)
    indexed = indexer.transform(with_class_weights(train, label))
    prepared = prepare(indexed, stages, ["_label", "weight"]).persist()
    shared_dir(train.sparkSession)  # forests checkpoint the rows' nodes there
    try:
        estimator = classifier_estimator(family, params, len(indexer.labels), prepared.count())
        boosted = family == "LGBM"
        fitted = fit_boosted(prepared, estimator, len(indexer.labels)) if boosted else estimator.fit(prepared)
    finally:
        prepared.unpersist()
    names = IndexToString(inputCol="_prediction", outputCol=PREDICTION, labels=indexer.labels)
    return PipelineModel([*stages, fitted, names])


def regressor_estimator(family: str, params: Mapping, target: str):
    columns = {"featuresCol": "_features", "labelCol": target, "predictionCol": PREDICTION}
    if family == "LR":
        return LinearRegression(regParam=0.0, **columns)
    if family == "RF":
        return RandomForestRegressor(**forest_params(dict(params)), **columns)
    if family == "LGBM":
        return GBTRegressor(**boosting_params(dict(params)), **columns)
    raise ValueError(f"unknown model family {family!r}, expected one of {list(FAMILIES)}")


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target value: features and target go by the same filter."""
    return df.filter(col(target).isNotNull())


def fit_regressor(
    train: DataFrame,
    family: str,
    target: str,
    params: Mapping | None = None,
    scaler: Mapping | None = None,
    features: Sequence[str] | None = None,
) -> PipelineModel:
    """Unweighted regressor on the rows that have a target."""
    params = HYPERPARAMETERS[family] if params is None else params
    features = list(features) if features is not None else feature_columns(train)
    stages = input_stages(features, scaler)
    prepared = prepare(with_target(train, target), stages, [target]).persist()
    shared_dir(train.sparkSession)
    try:
        fitted = regressor_estimator(family, params, target).fit(prepared)
    finally:
        prepared.unpersist()
    return PipelineModel([*stages, fitted])


def model_features(model: PipelineModel) -> list[str]:
    """Feature names in training order, as the saved model's assembler holds them."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.strip("`").removeprefix(SCALED) for c in assembler.getInputCols()]


def feature_importances(train: DataFrame, model: PipelineModel) -> DataFrame:
    """(feature, importance) of a tree model, largest first; one row per feature column."""
    fitted = next(s for s in model.stages if hasattr(s, "featureImportances"))
    scores = fitted.featureImportances.toArray().tolist()
    rows = list(zip(model_features(model), scores, strict=True))
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def regressor_run(
    parted: DataFrame, family: str, target: str, params: Mapping, scaler: Mapping | None
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the train part and predict the test rows that have a target: (model, predictions)."""
    train, test = (parted.filter(F.col("part") == part) for part in (TRAIN, TEST))
    model = fit_regressor(train, family, target, params, scaler, feature_columns(parted))
    return model, model.transform(with_target(test, target))


def multipredictor(
    features: DataFrame,
    run_name: str,
    family: str,
    window: int = 800,
    split: float = 0.8,
    params: Mapping | None = None,
    ties: Sequence[str] = (),
    output_dir: str | None = None,
    save: bool = False,
    histograms: bool = False,
) -> dict[str, DataFrame]:
    """Train and score the three predictors of a family on a feature table.

    Returns the tables of a run: ``run`` (scores and parameters), ``confusion``, ``balance_<target>``
    (values the split shares out unevenly), for tree families ``importances_speed`` and
    ``importances_incline``, and with ``histograms`` the prediction histograms of both regressors.
    With ``output_dir`` the run record and the importances are written below it, with ``save`` the
    models as well. ``features`` should be a stored table: it is read once per step.
    """
    params = HYPERPARAMETERS[family] if params is None else params
    columns = [c for c in features.columns if c not in ties]
    parted = sequential_split(features, split, window, [ACTIVITY, SPEED, INCLINE], ties)
    parted = parted.select(*[col(c) for c in columns], "part").persist()
    try:
        train, test = (parted.filter(F.col("part") == part) for part in (TRAIN, TEST))
        names = feature_columns(parted)
        scaler = fit_scaler(train, names) if family == "LR" else None

        activity = fit_classifier(train, family, params, scaler, names)
        predicted = activity.transform(test)
        scored = classification_scores(predicted, ACTIVITY, PREDICTION).first()
        matrix = confusion_matrix(predicted, label_list(features), ACTIVITY, PREDICTION).collect()
        result = {f"balance_{t.lower()}": split_balance(parted, t) for t in (ACTIVITY, SPEED, INCLINE)}
        models = {"activity": activity}
        regression = {}
        for target in (SPEED, INCLINE):
            name = target.lower()
            models[name], tested = regressor_run(parted, family, target, params, scaler)
            regression[name] = regression_scores(tested, target, PREDICTION).first()
            if histograms:
                result[f"histogram_{name}"] = regression_histogram(tested, target, PREDICTION)
    finally:
        parted.unpersist()

    spark = features.sparkSession
    score = {
        "activity": scored["accuracy"],
        "activity_weighted": scored["weighted_f1"],
        "speed_r2": regression["speed"]["r2"],
        "speed_rmse": regression["speed"]["rmse"],
        "incline_r2": regression["incline"]["r2"],
        "incline_rmse": regression["incline"]["rmse"],
    }
    logged = {"window": window, "split": split, **schema_components(columns), "hyperparams": dict(params)}
    result["run"] = run_record(spark, run_name, score, logged)
    result["confusion"] = spark.createDataFrame(matrix)
    if family != "LR":
        for name in ("speed", "incline"):
            result[f"importances_{name}"] = feature_importances(features, models[name])
    if output_dir is not None:
        base = f"{output_dir.rstrip('/')}/{run_name}"
        write_run(result["run"], f"{base}/output")
        for name in ("speed", "incline"):
            if f"importances_{name}" in result:
                write_importances(result[f"importances_{name}"], f"{base}/feature_importances_{name}")
        if save:
            for name, model in models.items():
                model.write().overwrite().save(f"{base}/{name}")
    return result
