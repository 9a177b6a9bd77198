"""Nearest as-of joins.

Ties go to the earlier right row, then to the smaller id. Null keys and times
never match. Right rows that share key and time are reduced to the smallest id
first, so no row multiplies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, by: Sequence[str], tolerance: int) -> DataFrame:
    """left (.., t) with r_id and r_t of the nearest right row (id, t) no farther than tolerance, else nulls.

    Times are dealt to buckets as wide as the tolerance and a left row looks
    into three of them, so a key is spread over all its buckets.
    """
    bucket = F.floor(F.col("t") / tolerance)
    row_key = [*by, "t"]
    r = right.groupBy(*by, "t").agg(F.min("id").alias("r_id")).withColumnRenamed("t", "r_t").withColumn("bucket", F.floor(F.col("r_t") / tolerance))
    probes = left.select(*row_key).distinct().withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    gap = F.abs(F.col("r_t") - F.col("t"))
    best = (
        probes.join(r, [*by, "bucket"])
        .where(gap <= tolerance)
        .groupBy(*row_key)
        .agg(F.min(F.struct(gap.alias("gap"), "r_t", "r_id")).alias("best"))
        .select(*row_key, F.col("best.r_id").alias("r_id"), F.col("best.r_t").alias("r_t"))
    )
    return left.join(best, row_key, "left")


def nearest_sample(samples: Column, t: Column, tolerance: int) -> Column:
    """The nearest of samples (an array of structs that begin with t and id) no farther from t than tolerance; null if there is none.

    As nearest_within, for keys whose right rows are a few and meet the left
    ones as one row of the key: nothing is moved for their times.
    """
    gaps = F.transform(samples, lambda s: F.struct(F.abs(s["t"] - t).alias("gap"), s.alias("s")))
    return F.array_min(F.filter(gaps, lambda g: g["gap"] <= tolerance))["s"]


def nearest_by_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left (id, t, ..) with r_id and r_t of the nearest right row (id, t) of the same group, at any distance.

    One pass over the union of both sides, sorted by time within the group: the
    last right row at or before, and the first after.
    """
    r = right.groupBy(*by, "t").agg(F.min("id").alias("r_id")).select(*by, "t", F.lit(0).alias("side"), F.struct(F.col("t").alias("r_t"), "r_id").alias("r"), F.lit(None).cast(left.schema["id"].dataType).alias("id"))
    tagged = left.select(*by, "t", F.lit(1).alias("side"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), "id").unionByName(r)
    order = Window.partitionBy(*by).orderBy("t", "side", "id")
    before = F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = tagged.withColumn("b", before).withColumn("a", after).where("side = 1 and t is not null")
    later = F.col("b").isNull() | (F.col("a.r_t") - F.col("t") < F.col("t") - F.col("b.r_t"))
    chosen = F.when(F.col("a").isNotNull() & later, F.col("a")).otherwise(F.col("b"))
    return near.select("id", *by, "t", chosen["r_id"].alias("r_id"), chosen["r_t"].alias("r_t"))
