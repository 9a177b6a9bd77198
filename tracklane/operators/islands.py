"""Gaps and islands: segments, runs, sticky labels, merged intervals.

All are windows over one key in time order. A key here is one game period or
one chain; a longer history is cut into such keys before it comes here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def running_id(df: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, name: str) -> DataFrame:
    """Adds a number per key that grows by one at each row where `starts` holds; the first row has 0."""
    w = _ordered(by, order)
    first = F.row_number().over(w) == 1
    flag = F.when(first, 0).otherwise(F.coalesce(starts, F.lit(False)).cast("int"))
    return df.withColumn("__flag", flag).withColumn(name, F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__flag")


def gap_segments(df: DataFrame, by: Sequence[str], t: str, tie: str, max_gap: int, jump: Column | None = None) -> DataFrame:
    """Adds dt, gap (dt null or above max_gap) and segment_id, which also grows where `jump` holds."""
    w = _ordered(by, [t, tie])
    with_dt = df.withColumn("dt", F.col(t) - F.lag(t).over(w))
    with_gap = with_dt.withColumn("gap", F.col("dt").isNull() | (F.col("dt") > max_gap))
    return running_id(with_gap, by, [t, tie], F.col("gap") if jump is None else F.col("gap") | F.coalesce(jump, F.lit(False)), "segment_id")


def label_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Adds run_id (changes of label, null a label of its own), run_length and, per row, its place in the run from 0."""
    w = _ordered(by, order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    runs = running_id(df.withColumn("__changed", changed), by, order, F.col("__changed"), "run_id").drop("__changed")
    run = Window.partitionBy(*by, "run_id")
    return runs.withColumn("run_length", F.count(F.lit(1)).over(run)).withColumn("run_place", F.row_number().over(run.orderBy(*order)) - 1)


def stable_labels(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, min_hold: int, first_holds: bool = True) -> DataFrame:
    """Adds `stable`: the label of the last run that was accepted.

    A run is accepted if it is at least min_hold rows long and, with
    first_holds, the first run always; runs of null labels are never accepted.
    """
    runs = label_runs(df, by, order, label)
    accepted = F.col(label).isNotNull() & ((F.col("run_length") >= min_hold) | (F.lit(first_holds) & (F.col("run_id") == 0)))
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("stable", F.last(F.when(accepted, F.col(label)), ignorenulls=True).over(w))


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Rows at which a label follows a different one, with from_label; nulls take no part."""
    w = _ordered(by, order)
    return df.where(F.col(label).isNotNull()).withColumn("from_label", F.lag(label).over(w)).where(F.col("from_label") != F.col(label))


def true_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, value: str, min_length: int = 1) -> DataFrame:
    """Runs of rows where flag holds (null: not): key, run, start and end place, length, peak of value."""
    w = _ordered(by, order)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("place", F.row_number().over(w) - 1)
    runs = marked.withColumn("__island", F.col("place") - F.sum(F.col("__f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__f")
    return (
        runs.groupBy(*by, "__island")
        .agg(F.min("place").alias("start_place"), (F.max("place") + 1).alias("end_place"), F.count(F.lit(1)).alias("length"), F.max(value).alias("peak"))
        .where(F.col("length") >= min_length)
        .drop("__island")
    )


def sustained_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """Per key, the largest minimum of value over `width` consecutive rows without null: the level held that long. Null if there is none."""
    frame = _ordered(by, order).rowsBetween(-(width - 1), 0)
    held = F.when(F.count(value).over(frame) == width, F.min(value).over(frame))
    return df.withColumn("__held", held).groupBy(*by).agg(F.max("__held").alias("sustained"))


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, gap: int) -> DataFrame:
    """Adds cascade_id: intervals whose start is no later than the latest end so far plus gap belong together."""
    w = _ordered(by, [start, tie])
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return running_id(df.withColumn("__apart", F.col(start) > reached + gap), by, [start, tie], F.col("__apart"), "cascade_id").drop("__apart")
