"""Readers for the Parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table by name; Spark's reader opens whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with an epoch-millisecond axis `t_ms`."""
    return table(spark, sf_dir, "events").withColumn("t_ms", F.unix_millis(F.col("ts").cast("timestamp")))
