"""Recordings to the interim table."""

import pytest
from pyspark.sql import functions as F

from strideframe.sources import recordings as rec
from strideframe.sources.tables import read_features

SCHEMA = "participant string, filename string, frame long, label string, value double, rate double"


def samples(spark, spec, participant="P1", filename="P1_Walk_1_7ms_10Incline.c3d", rate=100.0):
    rows = [
        (participant, filename, frame, label, float(v), rate) for label, values in spec.items() for frame, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_mock_recording(spark):
    spec = {"Global Angle_Foot_L.x": [1, 2, 3], "Global Angle_Foot_L.y": [4, 5, 6], "left foot sensor.lfs": [7, 8, 9]}
    df = samples(spark, spec, filename="Jogging2_5ms_weighted_10 decline.c3d")
    rows = rec.ingest_trials(df).orderBy("TIME").collect()
    assert [r["TIME"] for r in rows] == [0, 10, 20]
    assert [r["global angle_foot_l.y"] for r in rows] == [4, 5, 6]
    assert [r["left foot sensor.lfs"] for r in rows] == [7, 8, 9]
    assert {(r["TRIAL"], r["ACTIVITY"], r["SPEED"], r["INCLINE"]) for r in rows} == {(0, "run", 2.5, -10)}


def test_selection_lists(spark):
    spec = {
        "Global Angle_Foot_L.y": [1, 2, 3], "Global Angle_Thigh_L.y": [4, 5, 6], "Global Angle_Thigh_L.x": [7, 8, 9],
        "left foot sensor.lfs": [10, 11, 12], "Accel Thigh_R.y": [13, 14, 15], "Gyro Thigh_R.z": [16, 17, 18],
    }
    wide = rec.ingest_trials(
        samples(spark, spec), measures=["Global Angle"], locations=["foot sensor", "thigh"], dimensions=["y"]
    )
    assert set(wide.columns) - {"TRIAL", "TIME", "ACTIVITY", "INCLINE", "SPEED"} == {
        "global angle_thigh_l.y",
        "left foot sensor.lfs",
    }


def test_trials_are_numbered_by_participant_and_name(spark):
    names = [
        ("P10", "b_walk.c3d"), ("P2", "z_run.c3d"), ("P2", "a_walk.c3d"), ("P2", "calibration.c3d"), ("P3", "walk.c3d"),
        ("P100", "walk.c3d"), ("notes", "walk.c3d"), ("P2", "walk_transition.c3d"), ("P10", "walk.txt"),
    ]
    files = spark.createDataFrame(names, "participant string, filename string").repartition(5)
    rows = rec.number_trials(files.union(files), [3]).orderBy("TRIAL").collect()
    assert [(r["TRIAL"], r["participant"], r["filename"]) for r in rows] == [
        (0, "P2", "a_walk.c3d"), (1, "P2", "z_run.c3d"), (2, "P10", "b_walk.c3d"),
    ]
    assert [r["participant"] for r in rec.participants(files, [3]).collect()] == ["P2", "P10"]


def test_no_participants(spark):
    with pytest.raises(ValueError, match="none of the folders"):
        rec.ingest_trials(samples(spark, {"accel_foot_l.x": [1]}, participant="notes"))


def test_later_trials_are_laid_on_the_first(spark):
    first = samples(spark, {"accel_foot_l.x": [1, 2]}, filename="a_walk.c3d")
    extra = samples(spark, {"accel_foot_l.x": [3], "gyro_foot_l.x": [4]}, filename="b_walk.c3d")
    lacking = samples(spark, {"gyro_foot_l.x": [4]}, filename="c_walk.c3d")
    unrelated = samples(spark, {"emg": [4]}, filename="d_walk.c3d")
    wide = rec.ingest_trials(first.union(extra))
    assert wide.columns == ["TRIAL", "TIME", "accel_foot_l.x", "ACTIVITY", "INCLINE", "SPEED"]
    assert wide.count() == 3
    for bad in (lacking, unrelated):
        with pytest.raises(ValueError, match="trials \\[1\\] lack"):
            rec.ingest_trials(first.union(bad))


def test_missing_location_is_filled_per_participant(spark):
    one = samples(spark, {"accel_pelvis.x": [1]}, "P1", "walk.c3d")
    two = samples(spark, {"Accel.x": [2]}, "P2", "walk.c3d")
    rows = rec.ingest_trials(one.union(two), missing_locations={2: "pelvis"}).orderBy("TRIAL").collect()
    assert [r["accel_pelvis.x"] for r in rows] == [1, 2]


def test_nan_samples_become_null(spark):
    rows = rec.ingest_trials(samples(spark, {"accel_pelvis.x": [1, float("nan")]})).orderBy("TIME").collect()
    assert [r["accel_pelvis.x"] for r in rows] == [1, None]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_recordings_are_read_from_participant_folders(spark, tmp_path, fmt):
    name = "P1 Walk_1_7ms_10 Incline+.c3d"
    data = samples(spark, {"accel_pelvis.x": [1, 2]}).select("frame", "label", "value", "rate")
    staged = tmp_path / "staged"
    data.coalesce(1).write.format(fmt).option("header", "true").save(str(staged))
    folder = tmp_path / "raw" / "P7"
    folder.mkdir(parents=True)
    part = next(p for p in staged.iterdir() if p.name.startswith("part-"))
    (folder / f"{name}.{fmt}").write_bytes(part.read_bytes())
    read = rec.read_recordings(spark, str(tmp_path / "raw"), fmt)
    assert {(r["participant"], r["filename"]) for r in read.collect()} == {("P7", name)}
    rec.process_recordings(read, str(tmp_path / "interim"))
    rows = read_features(spark, str(tmp_path / "interim")).orderBy("TIME").collect()
    assert [(r["TIME"], r["accel_pelvis.x"], r["INCLINE"]) for r in rows] == [(0, 1.0, 10), (10, 2.0, 10)]


def test_interim_types(spark):
    wide = rec.ingest_trials(samples(spark, {"accel_pelvis.x": [1]}))
    types = {f.name: f.dataType.simpleString() for f in wide.schema}
    assert types == {
        "TRIAL": "int", "TIME": "bigint", "accel_pelvis.x": "double",
        "ACTIVITY": "string", "INCLINE": "smallint", "SPEED": "float",
    }
    assert wide.select(F.round(F.col("SPEED").cast("double"), 3)).first()[0] == 1.7
