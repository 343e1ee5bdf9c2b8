"""Session factory shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tessera", cores: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster, pass your own session instead: nothing in the library
    depends on these values except the UTC time zone.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")  # sets of a few names a key: 128 keys are sorted far too early
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
