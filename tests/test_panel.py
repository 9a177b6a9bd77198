"""Fixed effects, clustered errors and resampling, against designs written out in full."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import inference, panel, regression

SCHEMA = "team string, rival long, y double, x double, z double, w double"


def rows(n=240, seed=1):
    """An unbalanced panel whose effects go with the regressor; some cells are missing, one level has one row."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randrange(7), rng.randrange(9)
        if (a + b) % 5 == 0:
            continue
        x = a * 0.7 - b * 0.4 + rng.gauss(0, 1)
        out.append((f"t{a}", b, 2 * x + 3 * a - b + rng.gauss(0, 1) * (1 + a / 3), x, rng.gauss(0, 1) + 0.3 * x, rng.uniform(0.5, 3)))
    return [*out, ("solo", 2, 5.0, 1.0, 0.0, 1.0), (None, 1, 1.0, 1.0, 1.0, 1.0), ("t1", 1, None, 1.0, 1.0, 1.0), ("t1", 1, 1.0, 1.0, None, 1.0)]


def full(data, effects):
    held = [r for r in data if None not in r]
    y, x, z, w = (np.array([r[i] for r in held]) for i in (2, 3, 4, 5))
    dummies = [np.array([r[e] == v for r in held], float) for e in effects for v in sorted({r[e] for r in held})[1:]]
    return held, y, np.column_stack([x, z, np.ones(len(held)), *dummies]), w


def cr1(design, y, w, labels):
    inverse = np.linalg.pinv(design.T @ (w[:, None] * design))
    beta = inverse @ design.T @ (w * y)
    s = design * (w * (y - design @ beta))[:, None]
    sums = np.array([s[[i for i, c in enumerate(labels) if c == g]].sum(axis=0) for g in sorted(set(labels))])
    n, k, g = len(y), design.shape[1], len(sums)
    return beta, inverse @ sums.T @ sums @ inverse * g / (g - 1) * (n - 1) / (n - k), sums @ inverse


@pytest.mark.parametrize("effects", [[], ["team"], ["team", "rival"]])
def test_effects_and_errors(spark, effects):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    fit = panel.fixed_effects(df, F.col("y"), {"x": F.col("x"), "z": F.col("z")}, effects, F.col("w"), ["team", "rival"])
    held, y, design, w = full(data, [SCHEMA.split(", ").index(f"{e} {'string' if e == 'team' else 'long'}") for e in effects])
    team, rival = [r[0] for r in held], [r[1] for r in held]
    beta, v, influence = cr1(design, y, w, team)
    assert fit.n == len(held) and fit.parameters == design.shape[1]
    assert fit.beta == pytest.approx(beta[:2], rel=1e-7)
    assert fit.errors("team") == pytest.approx(np.sqrt(np.diag(v)[:2]), rel=1e-6)
    both = v + cr1(design, y, w, rival)[1] - cr1(design, y, w, list(zip(team, rival, strict=True)))[1]
    assert fit.errors("team", "rival") == pytest.approx(np.sqrt(np.maximum(np.diag(both)[:2], 0)), rel=1e-6)
    got = {r.team: (r.x, r.z) for r in fit.influence("team").collect()}
    for g, own in zip(sorted(set(team)), influence, strict=True):
        assert got[g] == pytest.approx(own[:2], rel=1e-5, abs=1e-9)


def test_wild_bootstrap_against_refits(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    moments = panel.cluster_moments(df, "team", F.col("y"), {"x": F.col("x"), "z": F.col("z")}, ["team", "rival"], F.col("w"))
    held, y, design, w = full(data, [0, 1])
    team = [r[0] for r in held]
    assert moments.n == len(held) and moments.clusters == sorted(set(team))
    weights = panel.SIX_POINTS[np.random.default_rng(1).integers(0, 6, (150, len(moments.clusters)))]
    beta, v, _ = cr1(design, y, w, team)
    seen = abs(beta[0] / np.sqrt(v[0, 0]))
    rest = design[:, 1:]
    null = rest @ np.linalg.pinv(rest.T @ (w[:, None] * rest)) @ rest.T @ (w * y)
    hits = 0
    for draw in weights:
        sign = np.array([draw[moments.clusters.index(c)] for c in team])
        b, bv, _ = cr1(design, null + sign * (y - null), w, team)
        hits += abs(b[0] / np.sqrt(bv[0, 0])) >= seen
    assert panel.wild_p(moments, weights=weights) == (hits + 1) / 151
    x_only = panel.cluster_moments(df.withColumn("y", F.col("z")), "team", F.col("y"), {"x": F.col("x")}, ["team"])
    assert 0 < panel.wild_p(x_only, 99, 4) <= 1 and panel.wild_p(x_only, 99, 4) == panel.wild_p(x_only, 99, 4)


def test_resampled_clusters(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    moments = panel.cluster_moments(df, "team", F.col("y"), {"x": F.col("x"), "z": F.col("z")}, ["rival"], F.col("w"))
    held, y, design, w = full(data, [1])
    point, draws = panel.resampled(moments, 20, 5)
    assert point == pytest.approx((np.linalg.pinv(design.T @ (w[:, None] * design)) @ design.T @ (w * y))[:2], rel=1e-8)
    g = len(moments.clusters)
    picked = np.random.default_rng(5).multinomial(g, np.full(g, 1 / g), size=20)
    for times, own in zip(picked, draws, strict=True):
        v = w * np.array([times[moments.clusters.index(r[0])] for r in held])
        assert own == pytest.approx((np.linalg.pinv(design.T @ (v[:, None] * design)) @ design.T @ (v * y))[:2], rel=1e-6, abs=1e-9)


def test_limits(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(panel, "MOST_COLUMNS", 8)
    with pytest.raises(ValueError, match="columns"):
        panel.cluster_moments(df, "team", F.col("y"), {"x": F.col("x")}, ["rival"])
    with pytest.raises(ArithmeticError):
        panel.demeaned(df.na.drop(), ["x"], ["team", "rival"], most_rounds=1)


def test_small_formulas():
    n, a, b = np.array([3.0, 5.0, 2.0]), np.array([1.0, 2.0, 3.0]), np.array([2.0, 1.0, 4.0])
    assert regression.design_effect(n, 0.2, 0.1) == (pytest.approx(4.0), pytest.approx(2.5))
    draws = regression.paired_ratio_bootstrap((a, n), (b, n), 500, 2)
    assert abs(draws.mean() - (a.sum() - b.sum()) / n.sum()) < 0.1
    assert (regression.paired_ratio_bootstrap((a, n), (a, n), 20, 2) == 0).all()
    assert inference.bonferroni([0.01, 0.4, 0.2]) == pytest.approx([0.03, 1.0, 0.6])
    x, y = np.random.default_rng(3).standard_normal((2, 9))
    assert inference.leave_one_out(x, y) == pytest.approx([np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] for i in range(9)])
