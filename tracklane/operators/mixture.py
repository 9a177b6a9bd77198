"""Mixtures of isotropic Gaussians in the plane, given as parameters: density, mode, draws, regions, losses.

Arrays: weights (.., M), means (.., M, 2), sigmas (.., M), points (.., 2). rank_rows
takes them as columns of rows and works on a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations as orders

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def log_density(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, z: np.ndarray) -> np.ndarray:
    dx, dy = (z[..., None, axis] - means[..., axis] for axis in (0, 1))
    area = 2 * np.pi * np.square(sigmas)
    with np.errstate(divide="ignore"):  # a component without weight adds nothing
        return np.logaddexp.reduce(np.log(weights / area) - np.pi * (dx * dx + dy * dy) / area, axis=-1)


def mean(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.einsum("...m,...mx->...x", weights, means)


def mode(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """The component mean at which the density is highest, the first of ties."""
    heights = np.stack([log_density(weights, means, sigmas, means[..., k, :]) for k in range(means.shape[-2])], axis=-1)
    top = heights.argmax(axis=-1)[..., None]
    return np.stack([np.take_along_axis(means[..., axis], top, axis=-1)[..., 0] for axis in (0, 1)], axis=-1)


def sample(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """(draws, .., 2)."""
    return placed(weights, means, sigmas, *noise(draws, weights.shape[:-1], rng))


def noise(draws: int, shape: tuple[int, ...], rng: np.random.Generator, u: np.ndarray | None = None, normal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What a sample needs of the generator: uniforms (draws, ..) and normals (draws, .., 2), in the arrays given if there are any."""
    return rng.random((draws, *shape), out=u), rng.standard_normal((draws, *shape, 2), out=normal)


def placed(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, u: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The sample that this noise gives; its shape is that of normal, against which mixtures are broadcast."""
    shape = np.broadcast_shapes(weights.shape, means.shape[:-1], sigmas.shape)
    below = np.zeros(u.shape, dtype=np.int64)  # components whose cumulated weight u has passed
    for edge in np.moveaxis(np.cumsum(weights, axis=-1), -1, 0)[:-1]:
        below += u > edge
    at = np.arange(np.prod(shape[:-1], dtype=int)).reshape(shape[:-1]) * shape[-1] + below  # the picked component among all
    centre = np.broadcast_to(means, (*shape, 2)).reshape(-1, 2).take(at, axis=0)
    return centre + np.broadcast_to(sigmas, shape).reshape(-1).take(at)[..., None] * normal


def density_rank(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, z: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Share of draws at least as dense as z: uniform for calibrated mixtures, and the least region of highest density that covers z."""
    own = log_density(weights, means, sigmas, z)
    hits = np.zeros(own.shape)
    for point in sample(weights, means, sigmas, draws, rng):
        hits += log_density(weights, means, sigmas, point) >= own
    return hits / draws


def region_thresholds(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, levels: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Log densities (.., levels) at the edge of the regions of highest density that hold each share, from draws."""
    heights = log_density(weights, means, sigmas, sample(weights, means, sigmas, draws, rng))
    return np.moveaxis(np.quantile(heights, 1 - np.asarray(levels), axis=0), 0, -1)


def entropy(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    return -log_density(weights, means, sigmas, sample(weights, means, sigmas, draws, rng)).mean(axis=0)


def spread(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Root of the mean square distance of a draw from the mean."""
    off = np.square(means - mean(weights, means)[..., None, :]).sum(axis=-1)
    return np.sqrt((weights * (off + 2 * np.square(sigmas))).sum(axis=-1))


def excess_spread(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """The part of spread that comes from components apart from one another."""
    off = np.square(means - mean(weights, means)[..., None, :]).sum(axis=-1)
    return np.sqrt((weights * off).sum(axis=-1))


def coverage(ranks: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.array([np.mean(ranks <= level) for level in np.atleast_1d(levels)])


def permutations(k: int = 5) -> np.ndarray:
    """All orders of k slots."""
    return np.array(list(orders(range(k))))


def best_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least total cost over one-to-one assignments (.., K, K) and the assignment, the first of ties."""
    ways = permutations(cost.shape[-1])
    totals = np.stack([np.trace(cost[..., way], axis1=-2, axis2=-1) for way in ways], axis=-1)
    best = totals.argmin(axis=-1)
    return totals.min(axis=-1), ways[best]


def slot_loss(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Negative log densities of points (.., K, 2) under the mixture of their own slot, averaged over slots."""
    return -log_density(weights, means, sigmas, z).mean(axis=-1)


def set_loss(weights: np.ndarray, means: np.ndarray, sigmas: np.ndarray, z: np.ndarray) -> np.ndarray:
    """As slot_loss, with points given to slots (.., K) by the assignment that costs least."""
    cost = -log_density(weights[..., :, None, :], means[..., :, None, :, :], sigmas[..., :, None, :], z[..., None, :, :])
    return best_assignment(cost)[0] / z.shape[-2]


def rank_rows(rows: DataFrame, draws: int = 256, seed: int = 1) -> DataFrame:
    """rows with rank (density_rank), nll, spread and excess.

    Columns weights and sigmas are arrays of M numbers, means of 2 M (x and y in
    turn), z of 2; M is the same in all rows. Draws are seeded by the row's
    place in its partition and `seed`. Rows with nulls are left out.
    """
    rows = rows.na.drop(subset=["weights", "means", "sigmas", "z"])
    extra = ("rank", "nll", "spread", "excess")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w, m, s, z = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c in ("weights", "means", "sigmas", "z"))
            m = m.reshape(n, -1, 2)
            values = density_rank(w, m, s, z, draws, rng), -log_density(w, m, s, z), spread(w, m, s), excess_spread(w, m, s)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], names=[*batch.schema.names, *extra])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in extra)]))
