"""Centroid clustering with exact integer arithmetic, most distances screened off by block norms.

A vector is cut into segments. For each segment its sum and the norm of what is
left when the segment's mean is taken off are computed once and stored: 16
numbers stand for 64. With x and c cut alike, Pythagoras within a segment and
Cauchy-Schwarz for the rests give

    |x - c|^2  >=  sum over segments of (sum_x - sum_c)^2 / length + (rest_x - rest_c)^2,

which is one small matrix product for a batch. A batch first takes the exact
distance to the centroid whose bound is least; a centroid whose bound is above
it cannot be nearest. Only what is left gets exact integer distances, and of
equal ones the smaller number wins.

A round reads the stored vectors once, sends out the centroids (their number and
length are parameters) and brings back one row of sums for each centroid, summed
in tasks, before the shuffle and after it. The driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import discard, staged

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Segments of a vector; must divide DIMENSIONS.
SEGMENTS = 8
#: Integers beyond this have squared distances beyond a long.
LARGEST = 1 << 27
#: Relative and absolute margin for the rounding of bounds.
MARGIN, LEAST_MARGIN = 1e-9, 1e-3


def integers(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that are not kept."""
    fit = F.size(embedding) == DIMENSIONS
    scaled = F.transform(embedding, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    inside = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (x >= -LARGEST) & (x < LARGEST), F.lit(False)))
    return F.when(fit & inside, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def kept_vectors(table: DataFrame) -> DataFrame:
    """vec_id, q (integers), sums and squares (of each segment of q) of the vectors kept, stored.

    Kept are vectors with exactly 64 components, none null or non-finite, nor so
    large that a squared distance would not fit into a long (2^27 and more after
    scaling). Rows with null or repeated ids are vectors of their own. Other
    columns have no effect.
    """
    width = DIMENSIONS // SEGMENTS
    part = lambda s: F.slice("q", s * width + 1, width)
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + f(x.cast("long")))
    kept = table.select("vec_id", integers(F.col("embedding")).alias("q")).where("q is not null")
    sums = F.array(*[total(part(s), lambda x: x) for s in range(SEGMENTS)])
    squares = F.array(*[total(part(s), lambda x: x * x) for s in range(SEGMENTS)])
    return staged(kept.select("vec_id", "q", sums.alias("sums"), squares.alias("squares")), "kept_vectors")


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors least by the hash of `seed:vec_id` (a null id is empty text; of equal hashes the smaller vector)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(text, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def compressed(sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Scaled sums and rests' norms of vectors given by segment sums and sums of squares."""
    width = DIMENSIONS // SEGMENTS
    rest = np.maximum(squares.astype(np.float64) - sums.astype(np.float64) ** 2 / width, 0)
    return np.concatenate([sums / np.sqrt(width), np.sqrt(rest)], axis=1)


def of_vectors(q: np.ndarray) -> np.ndarray:
    cut = q.reshape(len(q), SEGMENTS, DIMENSIONS // SEGMENTS)
    return compressed(cut.sum(axis=2), (cut * cut).sum(axis=2))


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances from compressed vectors, less a margin for rounding."""
    xx, cc = (x * x).sum(axis=1)[:, None], (c * c).sum(axis=1)[None, :]
    return xx + cc - 2 * (x @ c.T) - MARGIN * (xx + cc) - LEAST_MARGIN


def nearest(q: np.ndarray, x: np.ndarray, centroids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, its exact squared distance, and how many exact distances that took."""

    def exact(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        apart = q[rows] - centroids[of]
        return np.einsum("ij,ij->i", apart, apart)

    low = bounds(x, c)
    every = np.arange(len(q))
    best = low.argmin(axis=1)
    distance = exact(every, best)
    low[every, best] = np.inf
    rows, of = np.nonzero(low <= distance[:, None])
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    edges = np.searchsorted(of, np.arange(len(centroids) + 1))
    for j in np.flatnonzero(np.diff(edges)):
        mine = rows[edges[j] : edges[j + 1]]
        d = exact(mine, np.full(len(mine), j))
        better = (d < distance[mine]) | ((d == distance[mine]) & (j < best[mine]))
        best[mine[better]], distance[mine[better]] = j, d[better]
    return best, distance, len(q) + len(rows)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    wide = lambda name, n: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.int64)
    return wide("q", DIMENSIONS), compressed(wide("sums", SEGMENTS), wide("squares", SEGMENTS))


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = of_vectors(centroids)
        for batch in batches:
            if batch.num_rows:
                best, distance, _ = nearest(*_columns(batch), centroids, c)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(kept: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Centroids after one round, vectors, and exact distances taken; a centroid without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, counts, sums, taken = of_vectors(centroids), np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                q, x = _columns(batch)
                best, _, n = nearest(q, x, centroids, c)
                order = np.argsort(best, kind="stable")
                there, starts = np.unique(best[order], return_index=True)
                sums[there] += np.add.reduceat(q[order], starts, axis=0)
                counts += np.bincount(best, minlength=k)
                taken += n
        if taken:
            listed = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * DIMENSIONS), pa.array(sums.ravel()))
            spent = np.zeros(k, np.int64)
            spent[0] = taken
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), listed, pa.array(spent)], ["cluster", "n", "sums", "taken"])

    parts = kept.select("vec_id", "q", "sums", "squares").mapInArrow(run, "cluster int, n long, sums array<long>, taken long")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.array(*[F.sum(F.get("sums", i)) for i in range(DIMENSIONS)]).alias("sums")).collect()
    out = centroids.copy()
    for r in totals:
        if r.n:
            out[r.cluster] = np.array(r.sums, np.int64) // r.n
    return out, sum(r.n for r in totals), sum(r.taken for r in totals)


def fitted(kept: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after all rounds."""
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids, _, _ = moved(kept, centroids)
    return centroids


def clusters(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    With fewer than k vectors each is a centroid at first; a table without kept
    vectors gives no rows. An inertia that does not fit into a long is null.
    """
    kept = kept_vectors(table)
    centroids = fitted(kept, k, rounds, seed)
    found = staged(assigned(kept, centroids), "assigned")
    discard(kept)
    spark = table.sparkSession
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    fits = lambda n: int(n) if n < 1 << 63 else None
    inertia = fits(sum(r.d for r in each))
    prints = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    figures = spark.createDataFrame([(r.cluster, fits(r.d), inertia, prints[r.cluster]) for r in each], schema)
    return found.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
