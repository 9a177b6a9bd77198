"""Labels of annotators: lanes, consensus, comparisons, segments, clips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_written(labels: DataFrame, item: Sequence[str], lane: str, written: Sequence[str], label: str) -> DataFrame:
    """One label per item and lane: the one written last; null labels withdraw earlier ones, so such items are left out."""
    return labels.groupBy(*item, lane).agg(F.max_by(F.struct(F.col(label).alias("v")), F.struct(*written)).alias("last")).select(*item, lane, F.col("last.v").alias(label)).where(F.col(label).isNotNull())


def consensus(labels: DataFrame, item: Sequence[str], label: str, least: int = 2) -> DataFrame:
    """The label that at least `least` lanes gave an item and no other as often; items without one are left out."""
    counts = labels.groupBy(*item, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*item).agg(F.max("n").alias("top"), F.max_by(label, "n").alias(label), F.collect_list("n").alias("all"))  # a few labels
    alone = F.size(F.filter("all", lambda n: n == F.col("top"))) == 1
    return best.where((F.col("top") >= least) & alone).select(*item, label, F.col("top").alias("votes"))


def weighted_accuracy(judged: DataFrame, right: Column, stratum: str, weights: DataFrame | None = None) -> DataFrame:
    """One row: n, plain accuracy, and the mean of the strata's accuracies by weight (stratum, weight); by default all weigh the same."""
    strata = judged.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    rows = strata.join(F.broadcast(weights), stratum) if weights is not None else strata.withColumn("weight", F.lit(1.0))
    return rows.agg(F.sum("n").alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"), (F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight")).alias("weighted"))


def blind_against_assisted(blind: DataFrame, assisted: DataFrame, model: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """One row over the items that all three have: the model's accuracy against either kind of label, the anchoring gap, and their agreement."""
    named = lambda df, name: df.select(*item, F.col(label).alias(name))
    rows = named(blind, "b").join(named(assisted, "a"), [*item]).join(named(model, "m"), [*item])
    share = lambda x: F.avg(x.cast("double"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("m") == F.col("b")).alias("against_blind"), share(F.col("m") == F.col("a")).alias("against_assisted"), share(F.col("a") == F.col("b")).alias("agreement"))
    return out.withColumn("anchoring_gap", F.col("against_assisted") - F.col("against_blind"))


def disagreements(labels: DataFrame, item: Sequence[str], lane: str, label: str) -> DataFrame:
    """Items that two lanes label differently, once for each two of them: lane_a < lane_b."""
    a = labels.select(*item, F.col(lane).alias("lane_a"), F.col(label).alias("label_a"))
    b = labels.select(*item, F.col(lane).alias("lane_b"), F.col(label).alias("label_b"))
    return a.join(b, [*item]).where((F.col("lane_a") < F.col("lane_b")) & (F.col("label_a") != F.col("label_b")))  # an item's lanes are a few


def segments(steps: DataFrame, by: Sequence[str], step: str, label: str) -> DataFrame:
    """Runs of equal labels on consecutive steps: first, last, label."""
    w = Window.partitionBy(*by, label).orderBy(step)
    return steps.withColumn("__run", F.col(step) - F.row_number().over(w)).groupBy(*by, label, "__run").agg(F.min(step).alias("first"), F.max(step).alias("last")).drop("__run")


def clip(t: Column, t0: Column, step_ms: int, steps: int, before: int, after: int) -> Column:
    """Struct (step, first, last): the step of a time, and the window around it, all within 0..steps - 1."""
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(steps - 1)).cast("long")
    step = inside(F.floor((t - t0) / step_ms))
    return F.struct(step.alias("step"), inside(step - before).alias("first"), inside(step + after).alias("last"))


def item_id(*parts: Column, digits: int = 10) -> Column:
    """A short name of an item that does not tell its parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, digits)
