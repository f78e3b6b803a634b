"""Labels from file names, channel names, sample times."""

import pytest
from pyspark.sql import functions as F

from strideframe.functions import labels, names
from strideframe.functions.strata import stratum_key

FILES = [
    ("P1_Walk_1_7ms_10Incline.c3d", "walk", 10, 1.7, True),
    ("P2_Run_3_0ms_5Decline.c3d", "run", -5, 3.0, True),
    ("P3_Run_3_0ms.c3d", "run", 0, 3.0, True),
    ("P3_Jump.c3d", "jump", None, None, True),
    ("walk_2_incline_3_5ms.c3d", "walk", 2, 3.5, True),
    ("P4_Jog_2_5MS.c3d", "run", 0, None, True),
    ("P4_Walk_transition_1_1ms.c3d", "walk", 0, 1.1, False),
    ("P4_Calibration.c3d", None, 0, None, False),
    ("P4_Walk.C3D", "walk", 0, None, False),
    ("Jogging2_5ms_weighted_10 decline", "run", -10, 2.5, False),
    ("walk_incline_decline_7decline.c3d", "walk", 0, None, True),
    ("runjump_4incline.c3d", "run", None, None, True),
]


def test_file_name_labels(spark):
    df = spark.createDataFrame([(f[0],) for f in FILES], "filename string")
    name = F.col("filename")
    rows = df.select(
        name, labels.activity(name), labels.incline(name), F.round(labels.speed(name).cast("double"), 4), labels.is_trial_file(name)
    ).collect()
    assert {tuple(r) for r in rows} == set(FILES)


def test_time_is_exact_and_compat(spark):
    frames = spark.range(10_000).select("id", F.lit(1000.0).alias("rate"))
    both = frames.select("id", labels.time_ms(F.col("id"), F.col("rate")).alias("e"), labels.time_ms(F.col("id"), F.col("rate"), True).alias("c"))
    rows = both.collect()
    assert all(r["e"] == r["id"] for r in rows)
    assert all(r["c"] == int(r["id"] / 1000.0 * 1000) for r in rows)
    assert next(r["c"] for r in rows if r["id"] == 1001) == 1000


def test_feature_name_components(spark):
    cases = {
        "min_gyro_thigh_r.z": ("min", "gyro", "thigh_r", "z"),
        "max_global angle_foot_l.x": ("max", "global angle", "foot_l", "x"),
        "std_accel_pelvis.y": ("std", "accel", "pelvis", "y"),
        "max_left foot sensor.lfs": ("max", None, "left foot sensor", None),
        "ACTIVITY": (None, None, None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    rows = df.select("n", *names.component_columns(F.col("n")).values()).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == cases
    assert names.schema_components(cases)["measure"] == ["accel", "global angle", "gyro"]


def test_channel_selection_agrees_in_both_forms(spark):
    channels = [
        "Global Angle_Foot_L.y", "Global Angle_Thigh_L.y", "Global Angle_Thigh_L.x",
        "left foot sensor.lfs", "Accel Thigh_R.y", "Gyro Thigh_R.z",
    ]
    lists = (["Global Angle"], ["foot sensor", "thigh"], ["y"])
    wide = names.select_channels(channels, *lists)
    df = spark.createDataFrame([(c,) for c in channels], "label string")
    long = [r[0] for r in df.filter(names.is_selected(F.col("label"), *lists)).collect()]
    assert wide == long == ["Global Angle_Thigh_L.y", "left foot sensor.lfs"]
    assert lists == (["Global Angle"], ["foot sensor", "thigh"], ["y"])


@pytest.mark.parametrize(
    ("label", "location", "expected"),
    [
        ("accel.x", "pelvis", "accel_pelvis.x"),
        ("global angle.z", "thigh_l", "global angle_thigh_l.z"),
        ("accel_foot_l.x", "pelvis", "accel_foot_l.x"),
        ("accel.x", None, "accel.x"),
        ("accel.x", "", "accel.x"),
        ("accelx.x", "pelvis", "accelx.x"),
        ("gyro__l_shank.y", None, "gyro_shank_l.y"),
    ],
)
def test_label_repair(spark, label, location, expected):
    df = spark.createDataFrame([(label, location)], "label string, loc string")
    filled = names.tidy_label(names.fill_location(F.col("label"), F.col("loc")))
    assert df.select(filled).first()[0] == expected


def test_stratum_key_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert [r[0] for r in df.select(stratum_key(["x", "y", "z"])).collect()] == ["a__b", "a_b_"]
