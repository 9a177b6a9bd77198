"""Defender context on tracking frames: expected position, sightline cone, paint, help, closeouts.

Frames carry the ten positions of a step as two arrays of five, so everything
at one step is column arithmetic and only sequences over steps need a window
over one possession and defender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions import court
from tracklane.operators.islands import true_runs

STRONG, WEAK = (0.70, 0.12, 0.18), (0.55, 0.18, 0.27)
HZ = 5.0


def defenders(frames: DataFrame) -> DataFrame:
    """One row per frame and defender slot: def_x, def_y beside the frame's columns."""
    return frames.select("*", F.posexplode("def").alias("slot", "d")).withColumn("slot", F.col("slot").cast("long")).select("*", F.col("d.x").alias("def_x"), F.col("d.y").alias("def_y")).drop("d", "def")


def at(slot: Column) -> tuple[Column, Column]:
    """Position of the attacker in a slot; null outside 0-4."""
    return F.get("off", slot.cast("int"))["x"], F.get("off", slot.cast("int"))["y"]


def min_residual(frames: DataFrame, strong=STRONG, weak=WEAK) -> DataFrame:
    """The attacker slot whose expected defender position is nearest, the first of ties, and that distance.

    Expected positions are computed once for a step, as plain columns, before
    defenders are told apart; the nearest is a choice among five numbers.
    """
    spots, names = {}, []
    for j in range(5):
        o = F.get("off", F.lit(j))
        x, y = court.expected_position(o["x"], o["y"], F.col("ball_x"), F.col("ball_y"), court.side_weights(court.same_side(o["y"], F.col("ball_y")), strong, weak))
        spots[f"__x{j}"], spots[f"__y{j}"] = x, y
        names += [f"__x{j}", f"__y{j}"]
    rows = defenders(frames.select("possession", "step", "def", "off", "ball_x", "ball_y").withColumns(spots).drop("off")).withColumns({f"__r{j}": court.distance(F.col("def_x"), F.col("def_y"), F.col(f"__x{j}"), F.col(f"__y{j}")) for j in range(5)})
    least = F.least(*[F.col(f"__r{j}") for j in range(5)])
    man = F.coalesce(*[F.when(F.col(f"__r{j}") == F.col("residual"), j) for j in range(5)]).cast("long")
    return rows.withColumn("residual", least).select("possession", "step", "slot", man.alias("man"), "residual")


def expected_deviation(frames: DataFrame, strong=STRONG, weak=WEAK) -> DataFrame:
    """Per frame and defender guarding the attacker of its own slot: deviation from the expected position, and sag toward the hoop."""
    own = F.transform("def", lambda d, j: F.struct(d["x"].alias("dx"), d["y"].alias("dy"), F.get("off", j)["x"].alias("ox"), F.get("off", j)["y"].alias("oy")))
    rows = frames.select("possession", "step", "ball_x", "ball_y", F.posexplode(own).alias("slot", "p")).select("possession", "step", F.col("slot").cast("long").alias("slot"), "ball_x", "ball_y", "p.*")
    ox, oy = F.col("ox"), F.col("oy")
    side = court.same_side(oy, F.col("ball_y"))
    ex, ey = court.expected_position(ox, oy, F.col("ball_x"), F.col("ball_y"), court.side_weights(side, strong, weak))
    vx, vy = F.col("dx") - ex, F.col("dy") - ey
    reach = F.greatest(court.distance(ox, oy, court.HOOP_X, court.HOOP_Y), F.lit(1e-6))
    sag = (vx * (court.HOOP_X - ox) + vy * (court.HOOP_Y - oy)) / reach
    return rows.select("possession", "step", "slot", side.alias("strong"), F.hypot(vx, vy).alias("dev"), sag.alias("sag"))


def geometric_help(frames: DataFrame, leave: float = 6.0, speed: float = 3.0, zone: float = 20.0, min_steps: int = 2) -> DataFrame:
    """Runs of steps in which a defender off the handler leaves his man and closes on the handler near the hoop.

    The man is the attacker of the defender's slot. Speed is the backward
    difference of the distance to the handler.
    """
    rows = defenders(frames)
    (mx, my), (hx, hy) = at(F.col("slot")), at(F.col("handler"))
    rows = rows.withColumn("to_man", court.distance(F.col("def_x"), F.col("def_y"), mx, my)).withColumn("to_handler", court.distance(F.col("def_x"), F.col("def_y"), hx, hy))
    order = Window.partitionBy("possession", "slot").orderBy("step")
    closing = (F.lag("to_handler").over(order) - F.col("to_handler")) * HZ
    helping = (F.col("slot") != F.col("handler")) & (court.distance(hx, hy, court.HOOP_X, court.HOOP_Y) <= zone) & (F.col("to_man") >= leave) & (F.col("closing") >= speed)
    rows = rows.withColumn("closing", closing).withColumn("helping", F.coalesce(helping, F.lit(False)))
    return true_runs(rows, ["possession", "slot"], ["step"], F.col("helping"), "to_man", min_steps)
