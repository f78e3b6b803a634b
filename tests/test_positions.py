"""Positions and frames where groups are NULL, keys are large and times are far apart."""

import numpy as np
from pyspark.sql import functions as F

from strideframe.functions.labels import time_ms
from strideframe.operators.frames import frame_bounds
from strideframe.operators.positions import row_position


def test_null_groups_and_large_keys(spark):
    keys = [2**60 + i for i in range(4)]
    rows = [(g, k, -k) for g in (None, "a") for k in keys]
    df = spark.createDataFrame(rows, "g string, k long, tie long")
    got = row_position(df, F.col("k"), "pos", ["g"], ["tie"]).collect()
    assert {(r.g, r.k): r.pos for r in got} == {(g, k): i for g in (None, "a") for i, k in enumerate(keys)}


def test_long_frames(spark):
    df = spark.createDataFrame([(3_000_000, 1000)], "frame int, rate int")
    assert df.select(time_ms(F.col("frame"), F.col("rate"))).first()[0] == 3_000_000


def test_frames_of_many_far_groups():
    group = np.arange(200_000)
    time = group * 10_000_000_000
    low, high = frame_bounds(group, time, 1000)
    assert (high - low == 1).all()
