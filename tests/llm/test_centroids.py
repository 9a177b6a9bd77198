"""Centroid clustering: against plain integer rounds, bounds below distances, screening that screens."""

from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklane.llm import centroids


def plain(rows, k, rounds):
    """The contract, in Python integers."""
    kept = [(i, [floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and isfinite(x) and abs(x) < 1e5 for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), j) for j, m in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            mine = [q for (_, q), (_, of) in zip(kept, found, strict=True) if of == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = assign()
    each = [sum(d for d, of in found if of == j) for j in range(len(c))]
    return sorted(
        ((i, j, d, each[j], sum(each), sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)),
        key=str,
    )


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 64)) / 8
    rows = [(i * 37 % 1009, (centres[i % 6] + rng.standard_normal(64) / rng.choice([20, 400])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (None, rows[1][1]), (2003, [0.0] * 64), (2004, [-0.5 / 256] * 64)]
    bad = [(3000, None), (3001, []), (3002, [float("nan")] + [0.0] * 63), (3003, [None] + [0.0] * 63), (3004, [float("inf")] * 64), (3005, [0.0] * 63), (3006, [3e38] + [0.0] * 63)]
    return rows + bad


@pytest.mark.parametrize(("n", "k", "rounds"), [(200, 9, 3), (60, 40, 5), (3, 40, 2)])
def test_against_plain_rounds(spark, n, k, rounds):
    rows = vectors(n, n)
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int, q string").repartition(5)
    got = centroids.clusters(df, k, rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, rounds)


def test_empty_and_nothing_kept(spark):
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert centroids.clusters(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 300, 1 << 20, (1 << 27) - 1]))
def test_bounds_lie_below_distances(seed, scale):
    rng = np.random.default_rng(seed)
    q, c = (rng.integers(-scale, scale, (12, 64), endpoint=True) for _ in range(2))
    c[:4] = q[:4]
    c[4:8] = q[4:8] + rng.integers(-1, 1, (4, 64), endpoint=True)
    low = centroids.bounds(centroids.of_vectors(q), centroids.of_vectors(c))
    true = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    assert (low <= true).all()
    best, distance, _ = centroids.nearest(q, centroids.of_vectors(q), c, centroids.of_vectors(c))
    assert (best == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()


def test_most_distances_are_screened_off(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    df = spark.createDataFrame([(i, (centres[i % 40] + rng.standard_normal(64) / 10).tolist()) for i in range(4000)], "vec_id long, embedding array<double>")
    kept = centroids.kept_vectors(df)
    at, n, taken = centroids.moved(kept, np.floor(centres * 256).astype(np.int64))
    assert n == 4000 and taken < 1.2 * n
    assert np.abs(at - centres * 256).max() < 20
