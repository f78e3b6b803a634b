"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.catalog import tables
from strideframe.functions import labels
from strideframe.functions.names import ACTIVITY, INCLINE, SPEED, TIME, TRIAL, col, component_columns
from strideframe.functions.strata import stratum_key
from strideframe.operators import metrics
from strideframe.operators.checks import assert_schema, feature_schema, reattach_labels, time_reset_offenders
from strideframe.operators.extraction import feature_extraction
from strideframe.operators.positions import row_position
from strideframe.operators.rolling import rolling_stats
from strideframe.operators.scale import apply_scaler, fit_scaler
from strideframe.operators.split import TEST, TRAIN, sequential_split, split_balance
from strideframe.plans import neural, scoring, training
from strideframe.plans.workflow import run_workflow
from strideframe.sources import increment
from strideframe.sources import recordings as rec
from strideframe.sources.tables import append_ledger, read_ledger, record_once, write_features
from strideframe.storage import scratch_path

PERIOD = 10
CHANNELS = ["accel_shank_l.x", "gyro_pelvis.z"]
HOUR = 3_600_000
FOUR = ["min", "max", "mean", "std"]


def six(name: str) -> Column:
    """Six decimals: the last bits of a sum depend on the order of adding."""
    return F.round(col(name), 6).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[six(c) if c in doubles else col(c) for c in df.columns])


# --- rolling windows and features -------------------------------------------------------------


def rolling(method: str, stats: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = tables.interim(spark, sf_dir)
        return rounded(rolling_stats(data, CHANNELS, PERIOD, stats, method=method))

    return query


def rolling_long_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trials that hold a third of the lines each, four channels, a window of 1,000 samples."""
    data = tables.long_trials(spark, sf_dir)
    rolled = rolling_stats(data, tables.LINE_CHANNELS, 1000, FOUR)
    spread = [f"std_{c}" for c in tables.LINE_CHANNELS]
    return rounded(rolled.withColumns({c: F.round(c, 4) for c in spread}))


def rolling_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two days over irregular times, with all rows kept."""
    data = tables.labelled(spark, sf_dir)
    stats = ["min", "max", "mean", "std", "first", "last"]
    days = 48 * HOUR
    rolled = rolling_stats(data, ["value"], days, stats, ["event_id"], ["event_id"], full_windows=False, chunk_span=days)
    return rounded(rolled)


def time_reset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd trials start late, so they are reported wherever the trial before them exists."""
    data = tables.signals(spark, sf_dir)
    late = data.select(TRIAL, (F.col(TIME) + F.col(TRIAL) % 2 * 5).alias(TIME))
    return time_reset_offenders(late.groupBy(TRIAL).agg(F.min(TIME).alias("first_time")))


def reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.labelled(spark, sf_dir)
    rows = data.select(TRIAL, TIME, "event_id")
    return reattach_labels(rows, data, [ACTIVITY, SPEED, INCLINE], ["event_id"])


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_extraction(tables.interim(spark, sf_dir), PERIOD, validate_schema=False))


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per trial of a feature table that passed the schema check."""
    stats = ["min", "max"]
    features = feature_extraction(tables.interim(spark, sf_dir), PERIOD, stats, validate_schema=False)
    checked = assert_schema(features, feature_schema(CHANNELS, stats))
    return checked.groupBy(TRIAL).agg(F.count("*").alias("rows"), F.min(TIME).alias("first_time"))


def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each line of a part in ship-date order: frame numbers for unnumbered rows."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", *tables.LINE_TIES)
    placed = row_position(lines, tables.epoch("l_shipdate", 1_000), "position", ["l_returnflag"], tables.LINE_TIES)
    return placed.drop("l_shipdate")


# --- split, balance, weights ------------------------------------------------------------------


def stratum_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.labelled(spark, sf_dir)
    return data.select("event_id", stratum_key([ACTIVITY, SPEED, INCLINE]).alias("stratum"))


def split(columns: list[str], train_size: float, gap: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = tables.labelled(spark, sf_dir)
        parted = sequential_split(data, train_size, gap, columns, ["event_id"])
        return parted.select(TRIAL, TIME, "event_id", ACTIVITY, "value", "part")

    return query


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.labelled(spark, sf_dir)
    parted = sequential_split(data, 0.8, 5, [ACTIVITY], ["event_id"])
    return rounded(split_balance(parted, INCLINE, threshold=0.0001))


def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = metrics.label_order(tables.labelled(spark, sf_dir), ACTIVITY, ["event_id"])
    return ordered.select(ACTIVITY, F.col("first_seen")["TRIAL"].alias(TRIAL), F.col("first_seen")["TIME"].alias(TIME))


def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.value_counts(tables.labelled(spark, sf_dir), ACTIVITY))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = metrics.with_class_weights(tables.labelled(spark, sf_dir), ACTIVITY)
    return rounded(weighted.select("event_id", ACTIVITY, "weight"))


def null_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.with_target(tables.labelled(spark, sf_dir), SPEED).select("event_id", SPEED, "value")


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.labelled(spark, sf_dir).select("event_id", ACTIVITY)
    encoded = training.encode_labels(data).transform(data)
    return encoded.select("event_id", ACTIVITY, F.col("_label").cast("long").alias("code"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.labelled(spark, sf_dir).withColumn("hour", F.floor(F.col(TIME) / HOUR % 24).cast("double"))
    parted = sequential_split(data, 0.8, 5, [ACTIVITY], ["event_id"])
    scaler = fit_scaler(parted.filter(F.col("part") == TRAIN), ["value", "hour"])
    both = apply_scaler(parted.filter(F.col("part").isin(TRAIN, TEST)), scaler)
    return rounded(both.select("event_id", "part", "value", "hour"))


# --- ingest -----------------------------------------------------------------------------------


def participant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rec.participants(tables.files(spark, sf_dir), [15, 16])
    return found.select("participant", F.col("participant_no").cast("long").alias("participant_no"))


def trial_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.trial_files(tables.files(spark, sf_dir), [15, 16]).select("o_orderkey", "participant", "filename")


def trial_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = rec.with_labels(tables.files(spark, sf_dir))
    return named.select(
        "o_orderkey",
        "filename",
        ACTIVITY,
        F.col(INCLINE).cast("long").alias(INCLINE),
        F.round(F.col(SPEED).cast("double"), 4).alias(SPEED),
    )


def trial_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = rec.number_trials(tables.files(spark, sf_dir), [15, 16])
    return numbered.select("participant", "filename", F.col(TRIAL).cast("long").alias(TRIAL))


def time_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frame numbers at three rates, exact and as the older tool had them."""
    frames = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("frame"), F.explode(F.array(*[F.lit(r) for r in tables.RATES])).alias("rate")
    )
    frame, rate = F.col("frame"), F.col("rate")
    return frames.select(
        "frame",
        rate.cast("long").alias("rate"),
        labels.time_ms(frame, rate).alias("time_exact"),
        labels.time_ms(frame, rate, compat=True).alias("time_compat"),
    )


MISSING = {2: "pelvis"}


def channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = rec.normalise_labels(tables.recordings(spark, sf_dir), MISSING)
    return data.select("participant", "filename", "frame", "label", six("value"))


def channel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.recordings(spark, sf_dir)
    kept = rec.select_samples(data, MISSING, ["accel", "gyro"], ["foot sensor", "shank", "thigh"], ["y"])
    return kept.select("participant", "filename", "frame", "label", six("value"))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rec.ingest_trials(tables.recordings(spark, sf_dir), [4], MISSING)
    whole = {TRIAL: "long", INCLINE: "long", SPEED: "double"}
    cast = wide.select(*[col(c).cast(whole[c]).alias(c) if c in whole else col(c) for c in wide.columns])
    return rounded(cast)


def ingest_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even takes come first, then a batch with all takes, of which the odd ones are new; that batch is given twice."""
    data, path = tables.recordings(spark, sf_dir), scratch_path(spark, "increment")
    even = F.regexp_extract("filename", r"take(\d+)", 1).cast("int") % 2 == 0
    increment.ingest_increment(data.where(even), path, 1, [4], missing_locations=MISSING)
    for _ in range(2):
        increment.ingest_increment(data, path, 2, [4], missing_locations=MISSING)
    return increment.trial_extents(spark, path).select(
        "batch",
        "participant",
        "filename",
        F.col(TRIAL).cast("long").alias(TRIAL),
        ACTIVITY,
        F.col(INCLINE).cast("long").alias(INCLINE),
        F.round(F.col(SPEED).cast("double"), 4).alias(SPEED),
        "frames",
        "last_time",
    )


def channel_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that trials lack or have besides those of the first trial."""
    found = rec.ingest_parts(tables.altered_recordings(spark, sf_dir), [4], MISSING, strict=False).differences
    return found.select(F.col(TRIAL).cast("long").alias(TRIAL), "channel", "difference")


def empty_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files with their samples; files without any take no number."""
    states = rec.recording_states(tables.files(spark, sf_dir), tables.file_samples(spark, sf_dir), [15, 16])
    return states.withColumn(TRIAL, F.col(TRIAL).cast("long"))


# --- scores -----------------------------------------------------------------------------------


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.class_predictions(spark, sf_dir)
    classes = [r[0] for r in data.select("label").distinct().orderBy("label").collect()]
    return rounded(metrics.confusion_matrix(data, classes, "label", "prediction"))


def classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_scores(tables.class_predictions(spark, sf_dir), "label", "prediction"))


def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_scores(tables.value_predictions(spark, sf_dir), "label", "prediction"))


def regression_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_histogram(tables.value_predictions(spark, sf_dir), "label", "prediction"))


def feature_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = component_columns(F.col("feature"))
    return tables.feature_names(spark, sf_dir).select(
        "p_partkey", "feature", *[value.alias(name) for name, value in parts.items()]
    )


def importance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = metrics.importance_rollup(tables.feature_names(spark, sf_dir))
    return rolled.select("component", "value", F.round("importance", 3).alias("importance"))


def run_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.name_components(tables.feature_names(spark, sf_dir))


def validation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored sets appended to a new ledger, read back."""
    path = scratch_path(spark, "ledger")
    classes = metrics.classification_scores(tables.class_predictions(spark, sf_dir), "label", "prediction")
    values = metrics.regression_scores(tables.value_predictions(spark, sf_dir), "label", "prediction")
    model = "models/LR_run"
    append_ledger(scoring.ledger_row(classes, ACTIVITY, f"{model}/activity", "data/events.parquet"), path)
    append_ledger(scoring.ledger_row(values, SPEED, f"{model}/speed", "data/lineitem.parquet"), path)
    return rounded(read_ledger(spark, path))


def ledger_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rows appended twice, as a retried job would: each stands once."""
    path = scratch_path(spark, "ledger")
    classes = metrics.classification_scores(tables.class_predictions(spark, sf_dir), "label", "prediction")
    values = metrics.regression_scores(tables.value_predictions(spark, sf_dir), "label", "prediction")
    for _ in range(2):
        record_once(scoring.ledger_row(classes, ACTIVITY, "models/LR_run/activity", "data/events.parquet"), path)
        record_once(scoring.ledger_row(values, SPEED, "models/LR_run/speed", "data/lineitem.parquet"), path)
    return rounded(read_ledger(spark, path))


# --- models -----------------------------------------------------------------------------------


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored feature table of the events."""
    features = feature_extraction(tables.interim(spark, sf_dir), PERIOD, ["min", "max"], validate_schema=False)
    return write_features(features, scratch_path(spark, "features"))


def model_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split feature table, stored."""
    parted = sequential_split(model_features(spark, sf_dir), 0.8, 5, [ACTIVITY])
    return write_features(parted, scratch_path(spark, "parts"))


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("part") == name)


def activity_classifier(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parted = model_parts(spark, sf_dir)
        train = _part(parted, TRAIN)
        scaler = fit_scaler(train, training.feature_columns(train)) if family == "LR" else None
        model = training.fit_classifier(train, family, scaler=scaler)
        return metrics.classification_scores(model.transform(_part(parted, TEST)), ACTIVITY, training.PREDICTION)

    return query


def speed_regressor(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parted = model_parts(spark, sf_dir)
        train = _part(parted, TRAIN)
        scaler = fit_scaler(train, training.feature_columns(train)) if family == "LR" else None
        model = training.fit_regressor(train, family, SPEED, scaler=scaler)
        test = training.with_target(_part(parted, TEST), SPEED)
        return rounded(metrics.regression_scores(model.transform(test), SPEED, training.PREDICTION))

    return query


def regressor_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both regressors of a linear run, on parts cut by all three labels."""
    parted = sequential_split(model_features(spark, sf_dir), 0.8, 0, [ACTIVITY, SPEED, INCLINE])
    parted = write_features(parted, scratch_path(spark, "parts"))
    scaler = fit_scaler(_part(parted, TRAIN), training.feature_columns(parted))
    runs = [
        metrics.regression_scores(training.regressor_run(parted, "LR", target, {}, scaler)[1], target, training.PREDICTION)
        .select(F.lit(target).alias("target"), "*")
        for target in (SPEED, INCLINE)
    ]
    return rounded(runs[0].unionByName(runs[1]))


def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _part(model_parts(spark, sf_dir), TRAIN)
    return training.feature_importances(train, training.fit_regressor(train, "RF", INCLINE))


def multipredictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.multipredictor(model_features(spark, sf_dir), "LR_run", "LR", PERIOD, 0.8)["run"]


def apply_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regressor fitted on the train part, saved, loaded and scored on the test part."""
    parted = model_parts(spark, sf_dir)
    train = _part(parted, TRAIN)
    scaler = fit_scaler(train, training.feature_columns(train))
    path = f"{scratch_path(spark, 'models')}/run_lr/speed"
    training.fit_regressor(train, "LR", SPEED, scaler=scaler).write().save(path)
    return rounded(scoring.apply_model(_part(parted, TEST), SPEED, path, f"{sf_dir}/features.parquet")["result"])


def apply_model_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier fitted on the train part, saved, loaded and applied to the test part: its confusion matrix."""
    parted = model_parts(spark, sf_dir)
    train = _part(parted, TRAIN)
    scaler = fit_scaler(train, training.feature_columns(train))
    path = f"{scratch_path(spark, 'models')}/run_lr/activity"
    training.fit_classifier(train, "LR", scaler=scaler).write().save(path)
    return scoring.apply_model(_part(parted, TEST), ACTIVITY, path, f"{sf_dir}/features.parquet")["confusion"]


def mlp_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = model_parts(spark, sf_dir)
    model = neural.fit_mlp(_part(parted, TRAIN), 32, 32)
    return metrics.classification_scores(model.transform(_part(parted, TEST)), ACTIVITY, training.PREDICTION)


def mlp_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = model_parts(spark, sf_dir)
    _, losses = neural.mlp_grid_search(_part(parted, TRAIN), _part(parted, TEST), (32, 64), (32, 64))
    return losses


def network_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's whole job on the stored feature table."""
    return neural.train_network(model_features(spark, sf_dir), None, PERIOD, 0.8, (32,), (32, 64))[1]


def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings to a trained family."""
    return run_workflow(
        tables.recordings(spark, sf_dir),
        scratch_path(spark, "workflow"),
        models=["LR"],
        missing_locations=MISSING,
        skip_participants=[4],
        window=2,
        split=0.7,
        save=False,
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rolling_stats": rolling("plain", FOUR),
    "rolling_stats_arrow": rolling("arrow", FOUR),
    "rolling_stats_blocked": rolling("blocked", FOUR),
    "rolling_first_last": rolling("arrow", ["first", "last"]),
    "rolling_irregular": rolling_irregular,
    "rolling_long_trials": rolling_long_trials,
    "time_reset_check": time_reset_check,
    "reattach_labels": reattach,
    "feature_extraction": extraction,
    "schema_check": schema_check,
    "row_position": row_positions,
    "stratum_key": stratum_keys,
    "train_test_split": split([ACTIVITY], 0.8, 5),
    "train_test_split_strata": split([ACTIVITY, SPEED, INCLINE], 0.29, 3),
    "split_balance": balance,
    "label_order": label_order,
    "activity_counts": activity_counts,
    "class_weights": class_weights,
    "null_target_filter": null_targets,
    "label_encode": label_encode,
    "standard_scaler": scaled,
    "participant_scan": participant_scan,
    "trial_file_filter": trial_file_filter,
    "trial_metadata": trial_metadata,
    "trial_numbering": trial_numbering,
    "time_column": time_column,
    "channel_normalise": channel_normalise,
    "channel_select": channel_select,
    "ingest_trials": ingest,
    "ingest_increment": ingest_increment,
    "channel_alignment": channel_alignment,
    "empty_recordings": empty_recordings,
    "confusion_matrix": confusion_matrix,
    "classification_scores": classification_scores,
    "regression_scores": regression_scores,
    "regression_histogram": regression_histogram,
    "feature_name_parse": feature_name_parse,
    "importance_rollup": importance_rollup,
    "run_components": run_components,
    "validation_ledger": validation_ledger,
    "ledger_retry": ledger_retry,
    "activity_classifier": activity_classifier("LR"),
    "activity_classifier_forest": activity_classifier("RF"),
    "activity_classifier_boosted": activity_classifier("LGBM"),
    "speed_regressor": speed_regressor("LR"),
    "speed_regressor_forest": speed_regressor("RF"),
    "speed_regressor_boosted": speed_regressor("LGBM"),
    "feature_importances": feature_importances,
    "multipredictor": multipredictor,
    "regressor_run": regressor_run,
    "apply_model": apply_model,
    "apply_model_activity": apply_model_activity,
    "mlp_classifier": mlp_classifier,
    "mlp_grid_search": mlp_grid_search,
    "network_run": network_run,
    "workflow": workflow,
}
