"""Adjusted effects, against fits written out in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import effects


def data(n=900, seed=2):
    rng = np.random.default_rng(seed)
    a, b, team = rng.standard_normal(n), rng.integers(0, 4, n) / 1.0, rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(a + 0.4 * (team == 1) - 0.2 * b)))
    t = (rng.random(n) < p).astype(int)
    y = 1.5 * t + 2 * a - b + (team == 2) + rng.standard_normal(n)
    game = rng.integers(0, 40, n)
    return a, b, team, t, y, game


def frame(spark, d):
    a, b, team, t, y, game = d
    rows = [(i, float(a[i]), float(b[i]), f"t{team[i]}", int(t[i]), float(y[i]), int(game[i])) for i in range(len(a))]
    return spark.createDataFrame(rows, "id long, a double, b double, team string, t int, y double, game long").repartition(4)


def features(d):
    a, b, team = d[:3]
    cols = []
    for v in (a, b):
        cols.append((v - v.mean()) / (v.std() + 1e-9))
    dummies = []
    for v in (a, b):
        edges = np.unique(np.quantile(v, np.arange(1, 10) / 10))
        bins = np.searchsorted(edges, v, side="right")
        dummies += [bins == k for k in range(1, len(edges) + 1)]
    dummies += [team == 1, team == 2]
    return np.column_stack([*cols, *dummies]).astype(float)


def logistic(x, t, c):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [1 / c] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + penalty, x.T @ (p - t) + penalty @ w)
    return w


@pytest.mark.parametrize("folds", [1, 3])
def test_against_fits_in_full(spark, folds):
    d = data()
    a, b, team, t, y, game = d
    made = effects.design(frame(spark, d), {"a": F.col("a"), "b": F.col("b")}, ["team"])
    x = features(d)
    got = {r.id: r.features for r in made.rows.collect()}
    assert np.allclose([got[i] for i in range(len(a))], x, atol=1e-9) and len(made.names) == x.shape[1] and made.linear == ["a", "b"]
    fitted = effects.cross_fitted(made.rows, "t", "y", F.col("game") % folds, folds)
    e, m = np.zeros(len(a)), np.zeros(len(a))
    for k in range(folds):
        own, rest = (np.ones(len(a), bool),) * 2 if folds == 1 else (game % folds == k, game % folds != k)
        w = logistic(x[rest], t[rest], 10.0)
        e[own] = 1 / (1 + np.exp(-(np.column_stack([np.ones(own.sum()), x[own]]) @ w)))
        plain = rest & (t == 0)
        full = np.column_stack([np.ones(plain.sum()), x[plain]])
        m[own] = np.column_stack([np.ones(own.sum()), x[own]]) @ np.linalg.lstsq(full, y[plain], rcond=None)[0]
    rows = {r.id: (r.propensity, r.expected) for r in fitted.collect()}
    assert np.allclose([rows[i][0] for i in range(len(a))], e, atol=2e-4)
    assert np.allclose([rows[i][1] for i in range(len(a))], m, atol=2e-3)
    found = {r.estimator: r for r in effects.effect(fitted, "t", "y", "game").collect()}
    w1, w0 = (1 - e) * t, e * (1 - t)
    m1, m0 = (w1 @ y) / w1.sum(), (w0 @ y) / w0.sum()
    keep = (e >= 0.05) & (e <= 0.95)
    r = np.where(keep, t * (y - m) - (1 - t) * e / (1 - e) * (y - m), 0)
    att = r.sum() / t[keep].sum()
    assert found["overlap"].estimate == pytest.approx(m1 - m0, abs=1e-3) and found["att"].estimate == pytest.approx(att, abs=3e-3)
    assert found["att"].n == pytest.approx(keep.sum(), abs=2) and abs(found["att"].estimate - 1.5) < 0.35
    one = w1 * (y - m1) / w1.sum() - w0 * (y - m0) / w0.sum()
    two = (r - np.where(keep, t, 0) * att) / t[keep].sum()
    for name, psi in (("overlap", one), ("att", two)):
        sums = np.array([psi[game == g].sum() for g in np.unique(game)])
        assert found[name].se == pytest.approx(np.sqrt((sums**2).sum()), rel=2e-2)
    after = {r.covariate: r for r in effects.balance(fitted, F.col("t"), F.col("propensity"), {"a": F.col("a"), "b": F.col("b")}).collect()}
    spread = np.sqrt((a[t == 1].var() + a[t == 0].var()) / 2) + 1e-9
    assert after["a"].before == pytest.approx((a[t == 1].mean() - a[t == 0].mean()) / spread)
    assert after["a"].after == pytest.approx((np.average(a, weights=w1) - np.average(a, weights=w0)) / spread, abs=1e-3) and abs(after["a"].after) < abs(after["a"].before) / 5


def test_odd_rows_and_empty_arms(spark):
    d = data(60)
    df = frame(spark, d)
    odd = df.withColumn("a", F.when(F.col("id") == 1, None).otherwise(F.col("a"))).withColumn("y", F.when(F.col("id") == 2, None).otherwise(F.col("y"))).withColumn("c", F.lit(1.0))
    made = effects.design(odd, {"a": F.col("a"), "c": F.col("c")})
    fitted = effects.cross_fitted(made.rows, "t", "y", F.col("game") % 2, 2)
    assert fitted.count() == 58 and effects.effect(fitted, "t", "y", "game").count() == 2
    with pytest.raises(ValueError, match="lack rows"):
        effects.cross_fitted(made.rows.where("t = 0"), "t", "y", F.col("game") % 2, 2)
    with pytest.raises(ValueError, match="no rows"):
        effects.effect(fitted.where("t = 1"), "t", "y", "game")
