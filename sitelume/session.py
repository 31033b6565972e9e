"""Session defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None, app: str = "sitelume") -> SparkSession:
    """A local[n] session with AQE, UTC and Arrow; existing settings of a running session stay."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # else the checkpoints of a loop's rounds stay in the shared folder
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # else every Column call records its caller
        .getOrCreate()
    )
