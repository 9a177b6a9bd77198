"""Shot context: the shooter's touch and the zone prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def touch_state(shots: DataFrame, touches: DataFrame, dribbles: DataFrame, lookback: int, slack: int) -> DataFrame:
    """shots (shot_id, actor, t) with the actor's latest touch, dribbles so far and its age in seconds.

    A touch (touch_id, actor, t_start, t_end) counts if it began within lookback
    before t and ended no earlier than slack before t; dribbles (actor,
    t_dribble) count from its start to t. Without a touch the columns are null.
    Times are dealt to cells of `lookback`, so an actor's history is split.
    """
    cell = lambda c: F.floor(F.col(c) / lookback)
    probes = shots.withColumn("cell", F.explode(F.array(cell("t") - 1, cell("t"))))
    near = probes.join(touches.withColumn("cell", cell("t_start")), ["actor", "cell"])
    near = near.where((F.col("t_start") <= F.col("t")) & (F.col("t_start") >= F.col("t") - lookback) & (F.col("t_end") >= F.col("t") - slack))
    latest = near.groupBy("shot_id").agg(F.max(F.struct("t_start", "touch_id")).alias("last")).select("shot_id", "last.touch_id", "last.t_start")
    with_touch = shots.join(latest, "shot_id", "left")
    own = with_touch.where("t_start is not null").withColumn("cell", F.explode(F.array(cell("t") - 1, cell("t"))))
    hits = own.join(dribbles.withColumn("cell", cell("t_dribble")), ["actor", "cell"]).where((F.col("t_dribble") >= F.col("t_start")) & (F.col("t_dribble") <= F.col("t")))
    counts = hits.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n"))
    return with_touch.join(counts, "shot_id", "left").select(
        "shot_id",
        "actor",
        "t",
        "touch_id",
        F.when(F.col("t_start").isNotNull(), F.coalesce("n", F.lit(0)).cast("long")).alias("n_dribbles"),
        ((F.col("t") - F.col("t_start")) / 1000).alias("touch_s"),
    )


def catch_and_shoot(n_dribbles: Column, touch_s: Column, limit_s: float = 2.0) -> Column:
    """No dribble so far (null: none) within limit_s of the catch; false without a touch."""
    return (F.coalesce(n_dribbles, F.lit(0)) == 0) & F.coalesce(touch_s < limit_s, F.lit(False))
