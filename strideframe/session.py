"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "strideframe") -> SparkSession:
    """Single-machine session for tests and the benchmark.

    On a cluster use the session the cluster provides: the operators only need adaptive execution
    (on by default) and ``spark.checkpoint.dir``.
    """
    threads = os.cpu_count() if str(cpus) == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
