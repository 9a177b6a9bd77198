"""Interval, band and first-after-anchor joins.

Every join carries a time bucket in its equi keys, so one hot key is spread
over as many reduce groups as it has buckets and no task compares all pairs of
a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_after_anchor(anchors: DataFrame, responses: DataFrame, horizon_ms: int) -> DataFrame:
    """Earliest response of the same key within [t, t + horizon] of each anchor.

    anchors: anchor_id, key, t_ms; responses: response_id, key, t_ms. Ties go to
    the smaller response_id. Anchors without a response keep nulls. A null key
    or time never matches. Buckets are one horizon wide, so an anchor looks into
    two of them.
    """
    width = F.lit(horizon_ms)
    a = anchors.select("anchor_id", "key", F.col("t_ms").alias("a_ms"))
    bucket = F.floor(F.col("a_ms") / width)
    probes = a.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    r = responses.select("response_id", "key", F.col("t_ms").alias("r_ms")).withColumn("bucket", F.floor(F.col("r_ms") / width))
    hits = (
        probes.join(r, ["key", "bucket"])
        .where((F.col("r_ms") >= F.col("a_ms")) & (F.col("r_ms") <= F.col("a_ms") + width))
        .groupBy("anchor_id")
        .agg(F.min(F.struct((F.col("r_ms") - F.col("a_ms")).alias("delay_ms"), "response_id")).alias("best"))
        .select("anchor_id", F.col("best.response_id").alias("response_id"), F.col("best.delay_ms").alias("delay_ms"))
    )
    return a.join(hits, "anchor_id", "left")


def _cells(start, end, width: int):
    return F.sequence(F.floor(start / width), F.floor(end / width))


def point_in_interval(points: DataFrame, intervals: DataFrame, by: list[str], lead_ms: int, cell_ms: int, prefer_inside: bool = False) -> DataFrame:
    """points (point_id, t, ..) with the first interval (interval_id, t_start, t_end) that holds t, else null.

    An interval reaches lead_ms before its start. First is by interval_id, or,
    with prefer_inside, intervals that hold t themselves come before those that
    hold it by their lead only, then by t_start and interval_id. Intervals are
    repeated for each cell of cell_ms that they touch, so a key's intervals
    meet its points cell by cell.
    """
    i = intervals.where("t_end >= t_start").withColumn("cell", F.explode(_cells(F.col("t_start") - lead_ms, F.col("t_end"), cell_ms)))
    p = points.select(*by, "point_id", "t").withColumn("cell", F.floor(F.col("t") / cell_ms))
    by_lead = (F.col("t") < F.col("t_start")).cast("int")
    order = F.struct(by_lead.alias("lead"), "t_start", "interval_id") if prefer_inside else F.struct("interval_id")
    first = (
        p.join(i, [*by, "cell"])
        .where((F.col("t") >= F.col("t_start") - lead_ms) & (F.col("t") <= F.col("t_end")))
        .groupBy("point_id")
        .agg(F.min(order).alias("first"))
        .select("point_id", F.col("first.interval_id").alias("interval_id"))
    )
    return points.join(first, "point_id", "left")


def band_pairs(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of rows of the same key with |t - r_t| <= width; left has t, right has r_t."""
    cell = F.floor(F.col("t") / width)
    probes = left.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    return probes.join(right.withColumn("cell", F.floor(F.col("r_t") / width)), [*by, "cell"]).where(F.abs(F.col("r_t") - F.col("t")) <= width).drop("cell")


def first_after_anchor_excluding(anchors: DataFrame, responses: DataFrame, horizon_ms: int) -> DataFrame:
    """As first_after_anchor, by an actor who is not in the anchor's array `without`.

    anchors: anchor_id, key, t_ms, without; responses: response_id, key, t_ms,
    actor. Responses without an actor never match; a null array excludes nobody.
    """
    width = F.lit(horizon_ms)
    bucket = F.floor(F.col("a_ms") / width)
    a = anchors.select("anchor_id", "key", F.col("t_ms").alias("a_ms"), "without")
    r = responses.select("response_id", "key", "actor", F.col("t_ms").alias("r_ms")).withColumn("bucket", F.floor(F.col("r_ms") / width))
    allowed = F.col("actor").isNotNull() & ~F.coalesce(F.array_contains("without", F.col("actor")), F.lit(False))
    met = a.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).join(r, ["key", "bucket"]).where(F.col("r_ms").between(F.col("a_ms"), F.col("a_ms") + width) & allowed)
    first = met.groupBy("anchor_id").agg(F.min(F.struct((F.col("r_ms") - F.col("a_ms")).alias("delay_ms"), "response_id", "actor")).alias("f")).select("anchor_id", "f.*")
    return a.drop("without").join(first, "anchor_id", "left")


def covering(points: DataFrame, intervals: DataFrame, by: list[str], cell_ms: int) -> DataFrame:
    """Every pair of a point and an interval of the same key that holds it: by, point_id, t, interval_id, t_start, t_end.

    points: by, point_id, t; intervals: by, interval_id, t_start, t_end, ends
    included. Times may be negative; rows with null keys or times, and intervals
    that end before they start, hold nothing. An interval of length up to
    cell_ms * 2^k lies in at most two cells of that width; it is put into these
    alone, whatever its length, and a point looks into one cell of each width
    that occurs (64 at most). So a long interval meets its points cell by cell of
    its own width and is never repeated along its length.
    """
    span = (F.col("t_end") - F.col("t_start")).cast("double") / cell_ms
    level = F.greatest(F.ceil(F.log2(F.greatest(span, F.lit(1.0)))), F.lit(0)).cast("int")
    wide = lambda c, k: F.floor(c / (F.lit(cell_ms).cast("double") * F.pow(F.lit(2.0), k))).cast("long")
    held = intervals.where("t_end >= t_start").select(*by, "interval_id", "t_start", "t_end").withColumn("level", level)
    placed = held.withColumn("cell", F.explode(F.array_distinct(F.array(wide(F.col("t_start"), F.col("level")), wide(F.col("t_end"), F.col("level"))))))
    levels = sorted(r[0] for r in held.select("level").distinct().collect())
    probes = points.select(*by, "point_id", "t").where("t IS NOT NULL").withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("cell", wide(F.col("t"), F.col("level")))
    return probes.join(placed, [*by, "level", "cell"]).where(F.col("t").between(F.col("t_start"), F.col("t_end"))).drop("level", "cell")


def covering_sets(points: DataFrame, intervals: DataFrame, by: list[str], actor: str, cell_ms: int) -> DataFrame:
    """Per point and actor whose intervals hold it: by, point_id, actor, intervals (sorted ids), first_start, last_end. intervals have the actor's column."""
    owners = intervals.select(F.col("interval_id"), actor)
    pairs = covering(points, intervals, by, cell_ms).join(owners, "interval_id")
    return pairs.groupBy(*by, "point_id", actor).agg(F.sort_array(F.collect_set("interval_id")).alias("intervals"), F.min("t_start").alias("first_start"), F.max("t_end").alias("last_end"))
