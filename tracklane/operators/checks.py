"""Table checks: equality, agreement, release policy, required columns, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that would give away positions, apart from the shot location.
FORBIDDEN = re.compile(r"(^|_)(x|y|z|vx|vy)$")
ALLOWED = {"shot_x", "shot_y"}
MAX_ROWS_PER_POSSESSION = 30


def frames_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: equal (as multisets of rows) and the number of rows of left.

    Rows are counted per value on either side, in one shuffle.
    """
    counted = left.select("*", F.lit(1).alias("__d"), F.lit(1).alias("__l")).unionAll(right.select("*", F.lit(-1).alias("__d"), F.lit(0).alias("__l")))
    per_row = counted.groupBy(*left.columns).agg(F.sum("__d").alias("d"), F.sum("__l").alias("l"))
    return per_row.agg(F.coalesce(F.bool_and(F.col("d") == 0), F.lit(True)).alias("equal"), F.coalesce(F.sum("l"), F.lit(0)).alias("n"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two raters' labels; rows with a null are left out."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0.0)).alias("same"))
    by_a, by_b = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("na")), cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("c"))
    expected = F.col("c") / (F.col("n") * F.col("n"))
    share = F.col("same") / F.col("n")
    return total.withColumn("c", chance.scalar()).select(F.col("n").cast("long").alias("n"), share.alias("agreement"), ((share - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"))


def release_problems(df: DataFrame, shot_key: tuple[str, ...] = ("game_id", "t_release_ms")) -> list[str]:
    """Why a table may not be released: position columns, repeated shots, too many rows of a possession."""
    found = [f"forbidden column {c}" for c in df.columns if FORBIDDEN.search(c.lower()) and c not in ALLOWED]
    if ALLOWED & set(df.columns):
        missing = [c for c in shot_key if c not in df.columns]
        if missing:
            found.append(f"shot location without key {missing}")
        elif not df.groupBy(*shot_key).count().where("count > 1").isEmpty():
            found.append("shot key repeats")
    if {"game_id", "possession_id"} <= set(df.columns):
        most = df.groupBy("game_id", "possession_id").count().agg(F.max("count")).first()[0]
        if most and most > MAX_ROWS_PER_POSSESSION:
            found.append(f"{most} rows of a possession")
    return found


def max_abs_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest absolute difference of value between tables with the same keys, and keys on one side only."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full")
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_unmatched"))


def carried_over(base: DataFrame, extended: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether extended has every row of base unchanged, and how the tables differ by key.

    n_base, n_extended, n_added (keys of extended alone), n_missing (of base
    alone), n_changed (in both, with another value in a column of base; nulls
    are equal) and unchanged (nothing is missing or changed). Keys are distinct
    on either side; columns that extended has beyond base are not compared.
    """
    values = F.struct(*[c for c in base.columns if c not in keys], F.lit(0).alias("__none"))
    sides = base.select(*keys, values.alias("b"), F.lit(True).alias("__b")).join(extended.select(*keys, values.alias("x"), F.lit(True).alias("__x")), keys, "full_outer")
    here, there = F.col("__b").isNotNull(), F.col("__x").isNotNull()
    counts = {"n_base": here, "n_extended": there, "n_added": ~here, "n_missing": ~there, "n_changed": here & there & ~F.col("b").eqNullSafe(F.col("x"))}
    return sides.agg(*[F.count_if(hit).alias(name) for name, hit in counts.items()]).withColumn("unchanged", F.expr("n_missing + n_changed = 0"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
