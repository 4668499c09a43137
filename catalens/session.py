"""A local Spark session for tests, benchmarks and trials.

On a cluster the session is made by spark-submit. Of the settings below, the
UTC time zone, ANSI mode and AQE (with its splitting of skewed joins) are the
ones the library counts on.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, **settings: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("catalens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Without call-site capture, building a plan takes half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
