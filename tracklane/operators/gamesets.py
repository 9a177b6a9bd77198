"""Sets of games, splits and folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DataVersion:
    """A pinned data version; "latest" would make results change under the same code."""

    version: str

    def __post_init__(self) -> None:
        if self.version.strip().lower() in ("", "latest"):
            raise ValueError("a data version must be pinned")


def game_set(games: DataFrame, wanted: DataFrame, usable: str = "ok") -> DataFrame:
    """Games of a list that are usable; raises if a listed game is not in the table at all."""
    missing = wanted.select("game_id").distinct().join(games, "game_id", "left_anti")
    unknown = [r["game_id"] for r in missing.limit(10).collect()]  # a few to name in the message
    if unknown:
        raise ValueError(f"unknown games: {unknown}")
    return games.where(F.col("status") == usable).join(wanted.select("game_id").distinct(), "game_id", "left_semi")


def left_out_means(df: DataFrame, unit: str, fold: str, value: str) -> DataFrame:
    """Per unit and fold, the mean of value over the unit's other folds; null where there are none."""
    cells = df.groupBy(unit, fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = cells.groupBy(unit).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    return cells.join(whole, unit).select(unit, fold, ((F.col("all_s") - F.col("s")) / rest).alias("mean_of_others"))


def assert_grid(frames: DataFrame, rows: int) -> DataFrame:
    """Possessions whose long table has other than `rows` rows; a complete table gives none."""
    return frames.groupBy("game_id", "possession_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != rows)
