"""What the corpus operators share: tables, staging in the shared folder, bucketed running sums."""

from __future__ import annotations

import contextlib
import ctypes
import ctypes.util
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that one bucket of a hash-ordered group is to hold at most, on average.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 64
#: Rows of an Arrow batch at most, where batches hold texts.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; a cluster has none."""
    context = spark.sparkContext
    held = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracklane-')}")
        held = context.getCheckpointDir()
    return held.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    batch_bytes: the most that an Arrow batch of df's own steps is to hold, for rows of many kilobytes.
    The folder goes with discard(), or when the application ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tracklane/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes):
        df.write.parquet(path)
    fs, at = _file_system(spark, root)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: int | None) -> Iterator[None]:
    if value is None:
        yield
        return
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Removes the folders of staged tables that nothing reads any more."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, df.staged_path)
        fs.delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is written by now: what the first collection frees holds them until the second."""
    return_memory()
    for seconds in (0.1, 0.3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(seconds)  # the cleaner works beside


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows per Arrow batch to BATCH_ROWS if they are more: texts are large rows.

    The setting stays: df may run at any later time.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and then the memory it freed goes back to the system: workers live on between tasks."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            return_memory()

    return inner


def return_memory() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and for text without words."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def buckets_for(rows: int) -> int:
    """Buckets per group; grows with the data, so no bucket outgrows a task."""
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def hash_bucket(hex16: Column, buckets: int) -> Column:
    """Bucket of a 16-digit hex hash, in the hash's own order."""
    return F.floor(F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def running_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the inclusive running sum of `value` per group, in the order (bucket, *order).

    A group of any size is spread over its buckets: bucket totals come from one
    pre-aggregated pass, their prefix sums are a window over totals only, and
    rows meet only those of their own bucket. `order` must not contradict the
    buckets. Group columns must not be null.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, keys).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__before")
