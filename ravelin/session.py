"""Spark sessions for tests, benches and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, name: str = "ravelin", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, adaptive execution, Arrow).

    On a cluster, make the session with the cluster's own settings instead: operators read what they need
    (``spark.checkpoint.dir``, ``spark.sql.shuffle.partitions``) from the session they are given.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RAVELIN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
