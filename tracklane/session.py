"""Session factory: UTC, ANSI, AQE and Arrow on, sized from the machine or cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tracklane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator relies on.

    On a cluster the master, memory and shared folders come from spark-submit;
    only semantics (time zone, ANSI, AQE, Arrow) are fixed here.
    """
    cores = os.cpu_count() or 8
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or max(8, cores)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TRACKLANE_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()
