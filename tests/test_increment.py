"""Batches of recordings, listed files without samples, differing channels, results recorded once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strideframe.sources import increment
from strideframe.sources import recordings as rec
from strideframe.sources.tables import append_ledger, read_ledger, record_once
from strideframe.storage import committed_below

SCHEMA = "participant string, filename string, frame long, label string, value double, rate double"
CHANNELS = ["Accel_Foot_L.x", "Gyro_Pelvis.z"]


def samples(spark, *files, labels=CHANNELS, frames=3):
    rows = [(p, f, i, c, float(i), 100.0) for p, f in files for i in range(frames) for c in labels]
    return spark.createDataFrame(rows, SCHEMA)


def numbers(df):
    return {(r.participant, r.filename): (r.batch, r.TRIAL) for r in df.collect()}


FIRST = [("P2", "b_walk_1_5ms.c3d"), ("P10", "a_run_2_0ms.c3d")]
LATER = [("P1", "z_walk_1_0ms.c3d"), ("P2", "a_jump.c3d"), ("P3", "notes_transition_walk.c3d"), ("notes", "walk.c3d")]


def test_later_batches_keep_earlier_numbers(spark, tmp_path):
    path = str(tmp_path)
    one = numbers(increment.ingest_increment(samples(spark, *FIRST), path, 1))
    assert one == {FIRST[0]: (1, 0), FIRST[1]: (1, 1)}
    # the second batch holds a file of the first again, with more frames: it stays as it was
    both = samples(spark, *LATER).unionByName(samples(spark, FIRST[0], frames=9))
    two = numbers(increment.ingest_increment(both, path, 2))
    assert two == one | {LATER[0]: (2, 2), LATER[1]: (2, 3)}
    held = {r.TRIAL: (r.frames, r.last_time) for r in increment.trial_extents(spark, path).collect()}
    assert held == {t: (3, 20) for t in range(4)}
    # a batch that ended is not done again, and one without new files adds none
    assert numbers(increment.ingest_increment(samples(spark, ("P9", "c_walk.c3d")), path, 2)) == two
    assert numbers(increment.ingest_increment(both, path, 3)) == two
    assert numbers(increment.ingest_increment(samples(spark, ("P9", "c_walk.c3d")), path, 4))[("P9", "c_walk.c3d")] == (4, 4)


def test_a_batch_that_was_cut_off_is_done_again(spark, tmp_path):
    path = str(tmp_path)
    increment.ingest_increment(samples(spark, *FIRST), path, 1)
    # samples of batch 2 were written, its ledger was not
    samples(spark, ("P7", "lost_walk.c3d")).withColumn("TRIAL", F.lit(2)).write.parquet(f"{path}/interim/batch=2")
    (tmp_path / "trials" / "batch=2" / "_temporary").mkdir(parents=True)
    assert increment.batches(spark, path) == [1]
    assert set(increment.trial_extents(spark, path).select("TRIAL").toPandas()["TRIAL"]) == {0, 1}
    two = numbers(increment.ingest_increment(samples(spark, *LATER), path, 2))
    assert two[LATER[0]] == (2, 2) and increment.batches(spark, path) == [1, 2]
    assert increment.read_interim(spark, path).count() == 12


def test_later_batches_use_the_first_columns(spark, tmp_path):
    path = str(tmp_path)
    increment.ingest_increment(samples(spark, FIRST[0]), path, 1)
    more = samples(spark, LATER[0], labels=[*CHANNELS, "Mag_Pelvis.x"])
    increment.ingest_increment(more, path, 2)
    assert "mag_pelvis.x" not in increment.read_interim(spark, path).columns
    with pytest.raises(ValueError, match="trials \\[2\\] lack"):
        increment.ingest_increment(samples(spark, LATER[1], labels=CHANNELS[:1]), path, 3)
    assert increment.batches(spark, path) == [1, 2]


def test_channel_differences(spark):
    data = samples(spark, FIRST[0]).unionByName(samples(spark, FIRST[1], labels=["Accel_Foot_L.x", "Mag_Pelvis.x", "Noise"]))
    made = rec.ingest_parts(data, strict=False)
    found = {tuple(r) for r in made.differences.collect()}
    assert found == {(1, "gyro_pelvis.z", "missing"), (1, "mag_pelvis.x", "extra")}
    rows = made.table.where("TRIAL = 1").collect()
    assert len(rows) == 3 and all(r["gyro_pelvis.z"] is None for r in rows)
    with pytest.raises(ValueError, match="lack"):
        rec.ingest_parts(data)
    assert rec.ingest_parts(samples(spark, *FIRST)).differences.count() == 0


def test_empty_files_are_listed_and_take_no_number(spark, tmp_path):
    path = str(tmp_path)
    wanted = [("P1", "a walk+1.c3d"), ("P1", "b_walk.c3d"), ("P2", "c_run.c3d")]
    for i, (participant, name) in enumerate(wanted):
        rows = samples(spark, (participant, name)).drop("participant", "filename")
        folder = tmp_path / participant
        folder.mkdir(exist_ok=True)
        (rows.limit(0) if i == 0 else rows).toPandas().astype({"frame": "int64"}).to_parquet(folder / f"{name}.parquet")
    listing = rec.list_recordings(spark, path)
    assert {(r.participant, r.filename) for r in listing.collect()} == set(wanted)
    assert all(r.length > 0 for r in listing.collect())
    states = rec.recording_states(listing, rec.read_recordings(spark, path))
    found = {(r.participant, r.filename): (r.samples, r.TRIAL) for r in states.collect()}
    assert found == {wanted[0]: (0, None), wanted[1]: (6, 0), wanted[2]: (6, 1)}
    assert rec.recording_states(listing, rec.read_recordings(spark, path), [1]).count() == 1


def test_results_are_recorded_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "val_data string, run_id string, feature string, score double, plot_path string, rmse double"
    row = lambda name, score: spark.createDataFrame([("d", name, "SPEED", score, None, 1.25)], schema)
    record_once(row("r", 0.5), path)
    assert record_once(row("r", 0.75), path).count() == 1
    assert {r.score for r in read_ledger(spark, path).collect()} == {0.5}
    # an append that was cut off has no marker and is written again
    (entry,) = committed_below(spark, path)
    marker = entry.removeprefix("file:") + "/_SUCCESS"
    import os

    os.replace(marker, str(tmp_path / "marker"))
    assert {r.score for r in record_once(row("r", 0.75), path).collect()} == {0.75}
    assert record_once(row("s", None), path).count() == 2
    assert append_ledger(row("t", 1.0), path).count() == 3
