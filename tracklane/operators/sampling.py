"""Samples for review: disjoint strata with a shared cap for each group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.sources.shared import shared_dir

PICKS = "category string, key {key}, grp {grp}, place int, pool long"


def pool_sizes(candidates: DataFrame) -> DataFrame:
    """Different keys of each category."""
    return candidates.where("key is not null and category is not null").groupBy("category").agg(F.count_distinct("key").alias("pool"))


def disjoint_strata(candidates: DataFrame, takes: Mapping[str, int], per_group: int, seed: int) -> DataFrame:
    """Picks up to takes[category] keys for each category, none twice, at most per_group keys of a group over all categories.

    candidates: category, key, grp. Categories are served by the number of their
    candidates, the smallest first (ties by name), and each takes its candidates
    in the order of md5(seed:category:key), passing over keys and groups that are
    used up. A key that repeats counts once, with its least group; a null group
    is a group; rows without key or category, and of categories without a take,
    take no part. Returns category, key, grp, place (from 1 in the category's
    order), pool; a category that runs out has fewer.

    Only the first per_group candidates of a group can matter, so tasks keep no
    more of a group than that before they shuffle. What is carried from category
    to category is bounded by the sum of takes.
    """
    spark = candidates.sparkSession
    shared_dir(spark)
    held = candidates.where("key is not null").where(F.col("category").isin(list(takes))).groupBy("category", "key").agg(F.min("grp").alias("grp")).checkpoint()
    sizes = {r.category: r.pool for r in pool_sizes(held).collect()}
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("key", "grp")}
    picked = spark.createDataFrame([], PICKS.format(**kinds))
    bound = sum(takes.values())
    for name in sorted(sizes, key=lambda c: (sizes[c], c)):
        draw = F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("key")).cast("binary"))
        used = picked.groupBy(F.col("grp").alias("u")).agg(F.count(F.lit(1)).alias("used"))
        free = held.where(F.col("category") == name).join(_small(picked.select("key"), bound), "key", "left_anti").withColumn("draw", draw)
        first = free.withColumn("nth", F.row_number().over(Window.partitionBy("grp").orderBy("draw", "key"))).where(F.col("nth") <= per_group)
        open_ = first.join(_small(used, bound), F.col("grp").eqNullSafe(F.col("u")), "left").where(F.col("nth") + F.coalesce("used", F.lit(0)) <= per_group)
        taken = open_.orderBy("draw", "key").limit(takes[name])
        placed = taken.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("draw", "key")))
        picked = picked.unionByName(placed.select("category", "key", "grp", "place", F.lit(sizes[name]).cast("long").alias("pool"))).checkpoint()
    return picked


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where its bound is small."""
    return F.broadcast(df) if rows <= 100_000 else df
