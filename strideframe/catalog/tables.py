"""The given tables seen as sensor data: trials, recordings, predictions, feature names.

Each view reads a whole table. ``catalog.oracle`` holds the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.names import ACTIVITY, INCLINE, SPEED, TIME, TRIAL
from strideframe.operators.positions import row_position

# Words the views put together names from.
FILE_WORDS = ["Walk", "Jog", "Run", "Jump", "Calib", "Walk_transition"]
SLOPE_WORDS = ["Incline", "Decline", ""]
RAW_MEASURES = ["Global Angle", "HighG", "Accel", "Gyro"]
RAW_PLACES = ["Pelvis", "Foot_L", "Foot_R", "L_Shank", "Shank_R", "Thigh_L", "_Thigh_R"]
RAW_DIMENSIONS = ["x", "y", "z"]
RATES = [100, 1000, 1500]
STATISTICS = ["max", "min", "mean", "std"]
MEASURES = ["global angle", "highg", "accel", "gyro", "mag"]
PLACES = ["pelvis", "foot_l", "foot_r", "shank_l", "shank_r", "thigh_l", "thigh_r"]

LINE_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", *LINE_CHANNELS]

#: Recordings the embedding rows are dealt to.
RECORDINGS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str, per_second: int) -> Column:
    """Time since 1970 of a timestamp without zone, whatever the session's zone."""
    minutes = (F.datediff(F.to_date(ts), F.lit("1970-01-01")) * 24 + F.hour(ts)) * 60 + F.minute(ts)
    second = F.extract(F.lit("SECOND"), F.col(ts))
    return minutes.cast("long") * (60 * per_second) + F.floor(second * per_second).cast("long")


def pick(words: list, index: Column) -> Column:
    """Word at a zero-based index."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as unnumbered samples: a trial per user, frames in (ts, event_id) order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias(TRIAL), "ts", "event_id", "event_type", "value"
    )
    return row_position(events, epoch("ts", 1_000_000), TIME, [TRIAL], ["event_id"])


def interim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interim table of the events: two channels and the labels; errors have no speed or incline."""
    error = F.col("event_type") == "error"
    return signals(spark, sf_dir).select(
        TRIAL,
        TIME,
        F.col("value").alias("accel_shank_l.x"),
        F.minute("ts").cast("double").alias("gyro_pelvis.z"),
        F.col("event_type").alias(ACTIVITY),
        F.when(~error, F.length("event_type") / F.lit(2.0)).cast("float").alias(SPEED),
        F.when(~error, F.col(TRIAL) % 3 - 1).cast("smallint").alias(INCLINE),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with labels per row and the event time, in ms, as an irregular TIME; map-only."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias(TRIAL),
        epoch("ts", 1_000).alias(TIME),
        "event_id",
        F.col("event_type").alias(ACTIVITY),
        F.when(~error, F.length("event_type") / F.lit(2.0)).alias(SPEED),
        F.when(~error, F.col("user_id") % 3 - 1).alias(INCLINE),
        "value",
    )


def long_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples of three long trials, one per return flag, in ship-date order."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.ascii("l_returnflag") - 65).alias(TRIAL), "l_shipdate", *LINE_TIES
    )
    return row_position(lines, epoch("l_shipdate", 1_000), TIME, [TRIAL], LINE_TIES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of participants, with some folders and files that do not count."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    participant = (
        F.when(key % 23 == 7, F.concat(F.lit("P"), (customer % 17 + 100).cast("string")))
        .when(key % 23 == 11, F.lit("notes"))
        .otherwise(F.concat(F.lit("P"), (customer % 17 + 1).cast("string")))
    )
    filename = F.concat(
        F.lit("P"),
        (customer % 17 + 1).cast("string"),
        F.lit("_"),
        pick(FILE_WORDS, key % 6),
        F.lit("_"),
        (key % 4).cast("string"),
        F.lit("_"),
        (key % 10).cast("string"),
        F.lit("ms_"),
        (key % 12).cast("string"),
        pick(SLOPE_WORDS, key % 5 % 3),
        F.lit(".c3d"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", participant.alias("participant"), filename.alias("filename"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as decoded samples: a vector is a frame, a position is a channel.

    Participant 2 lacks the pelvis label; every recording ends with two foot sensors.
    """
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    recording, p = F.col("vec_id") % RECORDINGS, F.col("p")
    number = recording % 5 + 1
    place = pick(RAW_PLACES, F.floor(p / 3) % 7)
    unnamed = (number == 2) & (place == "Pelvis")
    label = (
        F.when(p == 62, F.lit("Left Foot Sensor.lfs"))
        .when(p == 63, F.lit("Right Foot Sensor.rfs"))
        .otherwise(
            F.concat(
                pick(RAW_MEASURES, F.floor(p / 21) % 4),
                F.when(unnamed, F.lit("")).otherwise(F.concat(F.lit("_"), place)),
                F.lit("."),
                pick(RAW_DIMENSIONS, p % 3),
            )
        )
    )
    participant = F.concat(F.lit("P"), number.cast("string"))
    filename = F.concat(
        participant,
        F.lit("_"),
        pick(FILE_WORDS[:4], recording % 4),
        F.lit("_"),
        (recording % 3 + 1).cast("string"),
        F.lit("_"),
        (recording % 10).cast("string"),
        F.lit("ms_"),
        (recording % 12).cast("string"),
        pick(SLOPE_WORDS, recording % 3),
        F.lit("_take"),
        recording.cast("string"),
        F.lit(".c3d"),
    )
    return frames.select(
        participant.alias("participant"),
        filename.alias("filename"),
        F.floor(F.col("vec_id") / RECORDINGS).cast("long").alias("frame"),
        label.alias("label"),
        F.col("v").cast("double").alias("value"),
        pick(RATES, recording % 3).alias("rate"),
    )


def altered_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose channels differ: some takes lack one, some have another name for one."""
    take = F.regexp_extract("filename", r"take(\d+)", 1).cast("int")
    changed = F.when((take % 5 == 1) & (F.col("label") == "Accel_Foot_L.x"), F.lit("Mag_Foot_L.x")).otherwise(F.col("label"))
    kept = ~((take % 7 == 3) & (F.col("label") == "Accel_L_Shank.z"))
    return recordings(spark, sf_dir).where(kept).withColumn("label", changed)


def file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the order files: lines of the largest quantity, so that some files have none."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    named = files(spark, sf_dir).withColumnRenamed("o_orderkey", "l_orderkey")
    return lines.select("l_orderkey", "l_linenumber").join(named, "l_orderkey")


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as classes; a third of the predictions say ``click``."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        kind.alias("label"), F.when(F.col("event_id") % 3 == 0, F.lit("click")).otherwise(kind).alias("prediction")
    )


def value_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as true values, predicted from the price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("label"), F.round(F.col("l_extendedprice") / 2000, 2).alias("prediction")
    )


def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as feature names with an importance; some are foot sensors, some no feature names."""
    key = F.col("p_partkey")
    stat = pick(STATISTICS, key % 4)
    name = (
        F.when(key % 13 == 0, F.lit("value"))
        .when(key % 11 == 0, F.concat(stat, F.lit("_left foot sensor.lfs")))
        .when(key % 11 == 1, F.concat(stat, F.lit("_right foot sensor.rfs")))
        .otherwise(
            F.concat(
                stat,
                F.lit("_"),
                pick(MEASURES, key % 5),
                F.lit("_"),
                pick(PLACES, key % 7),
                F.lit("."),
                pick(RAW_DIMENSIONS, key % 3),
            )
        )
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("feature"), F.col("p_retailprice").alias("importance"))
