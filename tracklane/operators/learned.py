"""What mixtures of a defender's position say: expected points against draws of them, their densest regions, two places at once.

Mixtures are columns of rows, as mixture.rank_rows has them; how they came about
does not matter here. A row is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from tracklane.functions import court
from tracklane.operators import mixture
from tracklane.operators.shot_quality import ShotModel

# Share of the region, side of a grid cell, least weight and distance of two places, draws of a position, the grid's sides.
LEVEL, CELL_FT, LEAST_WEIGHT, LEAST_GAP_FT, DRAWS = 0.8, 0.5, 0.15, 5.0, 100
EXTENT = ((-5.0, 60.0), (-5.0, 55.0))
#: Rows that a kernel works on at once.
CHUNK = 64


def _numbers(batch: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, *shape)


def densest(w: np.ndarray, m: np.ndarray, s: np.ndarray, level: float, grid: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(area, log density at the edge) of the fewest grid cells that hold this share of a mixture's mass on the grid. Arrays w (n, M), m (n, M, 2), s (n, M)."""
    heights = mixture.log_density(w[:, None], m[:, None], s[:, None], grid[None])
    falling = -np.sort(-heights, axis=1)
    mass = np.cumsum(np.exp(falling), axis=1)
    cells = (mass < level * mass[:, -1:]).sum(axis=1)
    return (cells + 1) * cell**2, np.take_along_axis(falling, cells[:, None], axis=1)[:, 0]


def regions(rows: DataFrame, level: float = LEVEL, cell: float = CELL_FT, extent: tuple[tuple[float, float], tuple[float, float]] = EXTENT) -> DataFrame:
    """rows with area (square feet of the densest region that holds `level`) and inside (whether z is in it).

    weights and sigmas are arrays of M numbers, means of 2 M (x and y in turn), z
    of 2; M is the same in all rows. The grid has the middles of cells within
    extent (x, then y); mass beyond it does not count. Rows with nulls are left out.
    """
    rows = rows.na.drop(subset=["weights", "means", "sigmas", "z"])
    gx, gy = (np.arange(low + cell / 2, high, cell) for low, high in extent)
    grid = np.stack(np.meshgrid(gx, gy, indexing="ij"), axis=-1).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                w, s = _numbers(part, "weights", -1), _numbers(part, "sigmas", -1)
                m, z = _numbers(part, "means", w.shape[1], 2), _numbers(part, "z", 2)
                area, edge = densest(w, m, s, level, grid, cell)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(area), pa.array(mixture.log_density(w, m, s, z) >= edge)], names=[*part.schema.names, "area", "inside"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("area", DoubleType()), StructField("inside", BooleanType())]))


def two_places(weights: Column, means: Column, anchors: Column, least_weight: float = LEAST_WEIGHT, least_gap: float = LEAST_GAP_FT) -> Column:
    """Whether a mixture is at two anchors at once: components go to their nearest anchor (the first of ties), and two anchors have enough weight and weighted means far enough apart.

    anchors: an array of (x, y); none, or a null, gives null or false as Spark's comparisons do.
    """
    square = lambda a, b, x, y: (a - x) * (a - x) + (b - y) * (b - y)
    at = lambda x, y: F.array_min(F.transform(anchors, lambda a, j: F.struct(square(a["x"], a["y"], x, y).alias("d"), j.alias("j"))))["j"]
    x, y = lambda i: F.get(means, 2 * i), lambda i: F.get(means, 2 * i + 1)
    parts = F.transform(weights, lambda w, i: F.struct(w.alias("w"), (w * x(i)).alias("wx"), (w * y(i)).alias("wy"), at(x(i), y(i)).alias("j")))
    total = lambda own, c: F.aggregate(own, F.lit(0.0), lambda t, p: t + p[c])
    owned = F.transform(anchors, lambda a, j: F.filter(parts, lambda p: p["j"] == j))
    sums = F.transform(owned, lambda own: F.struct(*[total(own, c).alias(c) for c in ("w", "wx", "wy")]))
    places = F.transform(F.filter(sums, lambda g: g["w"] >= least_weight), lambda g: F.struct((g["wx"] / g["w"]).alias("x"), (g["wy"] / g["w"]).alias("y")))
    return F.exists(places, lambda p: F.exists(places, lambda q: square(p["x"], p["y"], q["x"], q["y"]) >= least_gap**2))


def gaps_to(shot: np.ndarray, men: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feet from shots (.., 2) to each of their defenders (.., K, 2), and the same for those in front, infinite for others."""
    off, rim = men - shot[..., None, :], np.array([court.HOOP_X, court.HOOP_Y]) - shot
    gap = np.hypot(off[..., 0], off[..., 1])
    along = off[..., 0] * rim[..., None, 0] + off[..., 1] * rim[..., None, 1]
    reach = np.maximum(gap * np.maximum(np.hypot(rim[..., 0], rim[..., 1]), 1e-6)[..., None], 1e-6)
    return gap, np.where(along >= np.cos(np.radians(court.FRONT_CONE_DEGREES)) * reach, gap, np.inf)


def least(gaps: np.ndarray) -> np.ndarray:
    """The minimum over the last axis, which is short: one comparison of whole arrays for each of its places."""
    return functools.reduce(np.minimum, np.moveaxis(gaps, -1, 0))


def shot_defence(shot: np.ndarray, men: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest defender, nearest in front) of shots (.., 2) with defenders (.., K, 2), in feet; nobody in front is far."""
    near, front = (g.min(axis=-1) for g in gaps_to(shot, men))
    return near, np.where(np.isfinite(front), front, court.NO_FRONT)


def learned_points(shots: DataFrame, model: ShotModel, key: list[str], draws: int = DRAWS, seed: int = 9) -> DataFrame:
    """key, xfg_real, dep and dep_team: points that a shot is expected to give beyond what it would with defenders drawn from mixtures.

    dep has a number for each defender, who alone is moved; for dep_team all are,
    drawn one by one. shots: the model's inputs, shot_x, shot_y (the hoop is the
    left one), defenders (2 K numbers, x and y in turn), weights and sigmas (K M
    numbers, a defender after the other), means (2 K M); K and M are the same in
    all rows. Draws depend on the key and seed alone. Rows with a null in one of
    these or in a feature are left out.
    """
    rows = model.with_inputs(shots)
    eta = model.eta()
    settings = {"rest": (0.5, 0.5), "near": (np.e - 0.5, 0.5), "front": (0.5, np.e - 0.5)}
    for name, (near, front) in settings.items():  # eta is linear in the logarithms, which are 0 or 1 here
        rows = rows.withColumns({"def1_ft": F.lit(float(near)), "def_front_ft": F.lit(float(front))}).withColumn(f"__{name}", eta)
    mixed = ["defenders", "weights", "means", "sigmas"]
    rest = F.col("__rest")
    rows = rows.select(
        *key, F.when(F.col("is_three"), 3.0).otherwise(2.0).alias("value"), F.array(F.col("shot_x"), F.col("shot_y")).alias("shot"), *mixed,
        F.array(rest, F.col("__near") - rest, F.col("__front") - rest).alias("line"), F.xxhash64(F.lit(seed), *key).alias("seed"),
    ).na.drop(subset=mixed).where(F.forall("line", lambda v: v.isNotNull()) & F.forall("shot", lambda v: v.isNotNull()))
    extra = [StructField("xfg_real", DoubleType()), StructField("dep", ArrayType(DoubleType())), StructField("dep_team", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                n = part.num_rows
                men, shot, line = _numbers(part, "defenders", -1, 2), _numbers(part, "shot", 2), _numbers(part, "line", 3)
                k = men.shape[1]
                w, s = _numbers(part, "weights", k, -1), _numbers(part, "sigmas", k, -1)
                m = _numbers(part, "means", k, w.shape[2], 2)
                seeds = part.column("seed").to_numpy().view(np.uint64)
                u, normal = np.empty((n, draws, k)), np.empty((n, draws, k, 2))
                for seed, *own in zip(seeds, u, normal, strict=True):
                    mixture.noise(draws, (k,), np.random.default_rng(int(seed)), *own)
                still, moved = gaps_to(shot, men), gaps_to(shot[:, None], mixture.placed(w[:, None], m[:, None], s[:, None], u, normal))
                line = line[:, :, None]

                def made(near: np.ndarray, front: np.ndarray) -> np.ndarray:  # rows by draws
                    front = np.where(np.isfinite(front), front, court.NO_FRONT)
                    return 1 / (1 + np.exp(-(line[:, 0] + line[:, 1] * np.log(near + 0.5) + line[:, 2] * np.log(front + 0.5))))

                def one_moved(d: int) -> np.ndarray:  # of the gaps only the one of d differs between draws
                    return made(*(np.minimum(b[..., d], np.delete(a, d, axis=1).min(axis=1, initial=np.inf)[:, None]) for a, b in zip(still, moved, strict=True)))

                real, value = made(*(a.min(axis=1)[:, None] for a in still))[:, 0], part.column("value").to_numpy()
                alone = [one_moved(d).mean(axis=1) for d in range(k)]
                dep = (real[:, None] - np.stack(alone, axis=1)) * value[:, None]
                each = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, dep.ravel())
                out = [pa.array(real), each, pa.array((real - made(*(least(b) for b in moved)).mean(axis=1)) * value)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), *out], names=[*key, *(f.name for f in extra)])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in key), *extra]))
