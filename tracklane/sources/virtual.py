"""Synthetic tracking frames from order keys, by integer arithmetic that any SQL engine repeats exactly.

These are not measured positions: they only give geometric operators an input
whose results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 8
STEP_MS = 200


def frames(orders: DataFrame, steps: Sequence[int] | None = None) -> DataFrame:
    """One row per possession (o_orderkey) and step (those given, else all): ball, handler slot, and arrays of the five attackers and defenders."""
    k, s = F.col("possession"), F.col("step")
    feet = lambda c: c.cast("double") / F.lit(100.0)
    off_x = lambda j: (k * 37 + j * 911) % 3400 + s * ((k * 3 + j) % 5 - 2) * 40
    off_y = lambda j: (k * 53 + j * 677) % 5000 + s * ((k + j * 2) % 5 - 2) * 40
    def_x = lambda j: off_x(j) + (k * 13 + j * 7 + s * 37) % 600 - 300
    def_y = lambda j: off_y(j) + (k * 17 + j * 5 + s * 53) % 600 - 300
    place = lambda x, y: F.array(*[F.struct(feet(x(j)).alias("x"), feet(y(j)).alias("y")) for j in range(5)])
    handler = k % 5
    return (
        orders.select(F.col("o_orderkey").alias("possession"))
        .withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in (range(STEPS) if steps is None else steps)])))
        .select(
            "possession",
            "step",
            handler.alias("handler"),
            feet(off_x(handler) + 50).alias("ball_x"),
            feet(off_y(handler) + 50).alias("ball_y"),
            place(off_x, off_y).alias("off"),
            place(def_x, def_y).alias("def"),
        )
    )


#: The same frames for DuckDB, one row per slot.
SQL = f"""
    st AS (SELECT o_orderkey AS possession, unnest(range({STEPS})) AS step FROM orders),
    raw AS (SELECT possession AS k, step AS s, unnest(range(5)) AS j FROM st),
    pos AS (SELECT k, s, j, k % 5 AS handler,
      (k * 37 + j * 911) % 3400 + s * ((k * 3 + j) % 5 - 2) * 40 AS ox, (k * 53 + j * 677) % 5000 + s * ((k + j * 2) % 5 - 2) * 40 AS oy,
      (k * 37 + (k % 5) * 911) % 3400 + s * ((k * 3 + (k % 5)) % 5 - 2) * 40 + 50 AS bxx, (k * 53 + (k % 5) * 677) % 5000 + s * ((k + (k % 5) * 2) % 5 - 2) * 40 + 50 AS byy FROM raw),
    vt AS (SELECT k AS possession, s AS step, j AS slot, handler, ox / 100e0 AS off_x, oy / 100e0 AS off_y, bxx / 100e0 AS ball_x, byy / 100e0 AS ball_y,
      (ox + (k * 13 + j * 7 + s * 37) % 600 - 300) / 100e0 AS def_x, (oy + (k * 17 + j * 5 + s * 53) % 600 - 300) / 100e0 AS def_y FROM pos)
"""
