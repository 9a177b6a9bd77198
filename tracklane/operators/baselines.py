"""Rule baselines of defender positions: mixtures over attackers, best assignments, the left-over attacker, regions.

A rule position is the weighted mean of an attacker, the ball and the hoop. Work
at one step, and permutations within it, is NumPy on a batch of possessions;
what leaves a task are sums, or one row per step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import court
from tracklane.operators.hmm import HOOP, K, Batch
from tracklane.operators.matchup import at, defenders
from tracklane.operators.mixture import best_assignment
from tracklane.operators.stats import linear_quantiles
from tracklane.sources.shared import staged

# Weights of attacker, ball and hoop after Franks et al. (2015).
GAMMA = (0.62, 0.11, 0.27)


def rule_distance(gamma: tuple = GAMMA, man: Column | None = None) -> Column:
    """Feet between a defender (def_x, def_y) and the rule position of an attacker, by default that of his own slot."""
    ox, oy = at(F.col("slot") if man is None else man)
    g = F.struct(*[F.lit(v).alias(n) for n, v in zip("obh", gamma, strict=True)])
    ex, ey = court.expected_position(ox, oy, F.col("ball_x"), F.col("ball_y"), g)
    return court.distance(F.col("def_x"), F.col("def_y"), ex, ey)


def mixture_nll(frames: DataFrame, sigma: float, gamma: tuple = GAMMA) -> DataFrame:
    """One row: n, and the mean negative log density of defenders under equal mixtures over the attackers' rule positions."""
    rows = defenders(frames)
    square = [F.pow(rule_distance(gamma, F.lit(j)), F.lit(2)) for j in range(K)]
    least = F.least(*square)  # the largest part is taken out, so no sum underflows
    parts = sum((F.exp((least - q) / (2 * sigma * sigma)) for q in square), F.lit(0.0))
    nll = least / (2 * sigma * sigma) - F.ln(parts / K) + math.log(2 * math.pi * sigma * sigma)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(nll).alias("nll"))


def _costs(raw: pa.RecordBatch, gamma: tuple) -> tuple[Batch, np.ndarray]:
    """Square distances of defenders to rule positions: (N,T,defender,attacker)."""
    batch = Batch.of(raw)
    mean = gamma[0] * batch.off + gamma[1] * batch.ball[:, :, None] + gamma[2] * HOOP
    return batch, np.square(batch.men[:, :, :, None] - mean[:, :, None]).sum(axis=-1)


def set_errors(chain_rows: DataFrame, gamma: tuple = GAMMA) -> DataFrame:
    """Per possession: n (defenders times steps) and the least total square distance over assignments that hold for all its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            if raw.num_rows:
                batch, cost = _costs(raw, gamma)
                total, _ = best_assignment((cost * batch.valid[:, :, None, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([raw.column("possession"), pa.array(batch.valid.sum(axis=1) * K), pa.array(total)], names=["possession", "n", "square"])

    return chain_rows.mapInArrow(run, "possession long, n long, square double")


def _pairs(cost: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Least total distance of two defenders on two attackers, (10, ..) for each pair of defenders; rows as in _PAIRS. cost: (K, K, ..)."""
    i, j = np.array(_PAIRS).T
    return {(p, q): np.minimum(cost[p, i] + cost[q, j], cost[p, j] + cost[q, i]) for p, q in _PAIRS}


_PAIRS = tuple(combinations(range(K), 2))
#: For each attacker, the ways to part the four others into two pairs, in either order: places in _PAIRS.
_PARTS = [[(a, b) for a, one in enumerate(_PAIRS) for b, two in enumerate(_PAIRS) if sorted((*one, *two, k)) == list(range(K))] for k in range(K)]


def left_over(cost: np.ndarray) -> np.ndarray:
    """Of each defender, the attacker left over when the four others are assigned at the least total distance: (.., K) from square distances (.., K, K).

    Four on four are two pairs on two pairs, so the assignments of pairs are
    found once for all hidden defenders. Work is on whole rows of steps.
    """
    distance = np.ascontiguousarray(np.moveaxis(np.sqrt(cost).reshape(-1, K, K), 0, -1))
    pairs = _pairs(distance)
    out = np.empty((K, distance.shape[-1]), dtype=np.int64)
    for hidden in range(K):
        p, q, r, s = (d for d in range(K) if d != hidden)
        one, two = pairs[p, q], pairs[r, s]
        totals = [reduce(np.minimum, [one[a] + two[b] for a, b in parts]) for parts in _PARTS]
        out[hidden] = np.argmin(totals, axis=0)
    return out.T.reshape(cost.shape[:-1])


def left_over_errors(chain_rows: DataFrame, gamma: tuple = GAMMA) -> DataFrame:
    """possession, step, slot, square: of a hidden defender, the square distance to the left-over attacker's rule position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            if raw.num_rows:
                batch, cost = _costs(raw, gamma)
                square = np.take_along_axis(cost, left_over(cost)[..., None], axis=-1)[..., 0]
                row, step = np.nonzero(batch.valid)
                ids = raw.column("possession").take(pa.array(np.repeat(row, K)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(step, K)), pa.array(np.tile(np.arange(K), len(row))), pa.array(square[row, step].ravel())], names=["possession", "step", "slot", "square"])

    return chain_rows.mapInArrow(run, "possession long, step long, slot long, square double")


#: Possessions whose distances are compared together: their arrays stay in a core's cache.
CHUNK = 512


def left_over_sums(chain_rows: DataFrame, gamma: tuple = GAMMA) -> DataFrame:
    """left_over_errors added up in their task: possession, n (defenders times steps), square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                raw = whole.slice(at, CHUNK)
                batch, cost = _costs(raw, gamma)
                square = np.take_along_axis(cost, left_over(cost)[..., None], axis=-1)[..., 0].sum(axis=-1)
                yield pa.RecordBatch.from_arrays([raw.column("possession"), pa.array(batch.valid.sum(axis=1) * K), pa.array((square * batch.valid).sum(axis=1))], names=["possession", "n", "square"])

    return chain_rows.mapInArrow(run, "possession long, n long, square double")


def _counted(errors: DataFrame) -> tuple[Column, Column]:
    """Number and mean of square errors, which come one by one or as sums of n of them."""
    n = F.sum("n") if "n" in errors.columns else F.count(F.lit(1))
    return n, F.try_divide(F.sum("square"), n) if "n" in errors.columns else F.avg("square")


def fitted_sigma(errors: DataFrame) -> float:
    """The standard deviation per axis that fits square errors (left_over_errors or left_over_sums) best: that of a split, to be used on others."""
    return math.sqrt((errors.agg(_counted(errors)[1]).first()[0] or 0.0) / 2)


def scores(errors: DataFrame, sigma: float) -> DataFrame:
    """One row: n, root mean square error and negative log density of an isotropic Gaussian. errors as for fitted_sigma."""
    n, mean = _counted(errors)
    nll = mean / (2 * sigma * sigma) + math.log(2 * math.pi * sigma * sigma)
    return errors.agg(F.coalesce(n, F.lit(0)).alias("n"), F.sqrt(mean).alias("rmse"), nll.alias("nll"))


def region(errors: DataFrame, distance: str, level: float = 0.8) -> DataFrame:
    """One row: the radius that holds `level` of the distances and its area, those of a Gaussian fitted to them, and what the latter really holds."""
    errors = staged(errors.select(distance))  # read for the radius, the variance and the share
    sigma = F.sqrt(F.avg(F.col(distance) * F.col(distance)) / 2)
    first = errors.agg(F.lit(linear_quantiles(errors, distance, [level], stage=False)[0]).alias("radius"), (sigma * math.sqrt(-2 * math.log(1 - level))).alias("nominal")).first()
    held = errors.agg(F.avg((F.col(distance) <= F.lit(first["nominal"])).cast("double")).alias("held"))
    area = lambda r: F.lit(math.pi * r * r)
    return held.select(F.lit(first["radius"]).alias("radius"), area(first["radius"]).alias("area"), F.lit(first["nominal"]).alias("nominal_radius"), area(first["nominal"]).alias("nominal_area"), "held")
