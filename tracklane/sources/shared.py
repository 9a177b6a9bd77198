"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracklane-')}")
        held = context.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


#: Rows of a partition that each grow to many.
SPREAD_ROWS, LEAST_ROWS = 20_000, 1_000


def spread(df: DataFrame, *keys: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """df dealt by keys to partitions of about so many rows, and to all cores: for narrow rows that are to grow, however few files hold them.

    What a row grows to stays with its key, so windows and groups by the keys
    (and by more columns) move nothing again.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-n // rows), min(cores, -(-n // LEAST_ROWS)), 1), *keys)


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: what follows reads it instead of computing it again."""
    path = new_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
