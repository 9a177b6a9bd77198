"""Least squares, ridge logistic regression and clustered errors: sums in Spark, small matrices on the driver.

Designs have a few dozen columns at most, so X'X and X'y are a few thousand
numbers whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    r2: float
    n: int

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, float(b), float(s), float(self.r2), int(self.n)) for name, b, s in zip(self.names, self.beta, self.se, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, se double, r2 double, n long")


def _moments(df: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """Matrix of weighted sums of products of all columns, in one aggregate; rows with a null are left out."""
    names = list(columns)
    held = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).na.drop()
    products = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    row = held.agg(*products, F.count(F.lit(1)).alias("n")).first()
    m = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i + 1):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m, row["n"]


def ols(df: DataFrame, y: Column, x: Mapping[str, Column], weight: Column | None = None) -> Fit:
    """Weighted least squares with an intercept; columns are centred and scaled by one first pass, for stable sums."""
    names = ["intercept", *x]
    scale = df.agg(*[f(c.cast("double")).alias(f"{k}{i}") for i, c in enumerate([*x.values(), y]) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = np.array([scale[f"m{i}"] or 0.0 for i in range(len(x) + 1)])
    spread = np.array([scale[f"s{i}"] or 1.0 for i in range(len(x) + 1)])
    columns = {"intercept": F.lit(1.0)} | {f"z{i}": (c - float(centre[i])) / float(spread[i]) for i, c in enumerate([*x.values(), y])}
    m, n = _moments(df, columns, weight)
    xtx, xty, yty = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    beta = np.linalg.pinv(xtx) @ xty
    rss = float(yty - beta @ xty)
    total = float(yty - m[0, -1] ** 2 / m[0, 0]) if m[0, 0] else 0.0
    cov = np.linalg.pinv(xtx) * rss / max(n - len(beta), 1)
    slopes = beta[1:] / spread[:-1] * spread[-1]
    back = np.concatenate([[spread[-1] / 1.0], spread[-1] / spread[:-1]])
    intercept = centre[-1] + beta[0] * spread[-1] - slopes @ centre[:-1]
    turn = np.diag(back)
    turn[0, 1:] = -(centre[:-1] / spread[:-1]) * spread[-1]
    se = np.sqrt(np.maximum(np.diag(turn @ cov @ turn.T), 0))
    return Fit(names, np.concatenate([[intercept], slopes]), se, 1 - rss / total if total else float("nan"), n)


def newton_logistic(df: DataFrame, y: Column, x: Mapping[str, Column], c: float = 1.0, tol: float = 1e-8, max_iter: int = 50) -> Fit:
    """L2-penalised logistic regression by Newton steps: 1/2 |w|^2 + c * sum of losses, the intercept free of penalty.

    A step is one aggregate that gives gradient and Hessian. Raises if it does
    not converge.
    """
    names = ["intercept", *x]
    d = len(names)
    kept = df.select(F.lit(1.0).alias("x0"), *[v.cast("double").alias(f"x{i + 1}") for i, v in enumerate(x.values())], y.cast("double").alias("y")).persist()
    held = kept.na.drop()  # after columns are kept: before, each would be computed in the condition too, with all that it is made of
    beta, penalty = np.zeros(d), np.diag([0.0] + [1.0] * (d - 1))
    n = held.count()
    try:
        for _ in range(max_iter):
            eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
            p = F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))
            part = held.withColumn("p", p)
            row = part.agg(
                *[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)],
                *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(d) for j in range(i + 1)],
            ).first()
            g = c * np.array([row[f"g{i}"] for i in range(d)]) + penalty @ beta
            h = np.zeros((d, d))
            for i in range(d):
                for j in range(i + 1):
                    h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            h = c * h + penalty
            step = np.linalg.solve(h, g)
            beta = beta - step
            if np.abs(step).max() < tol:
                return Fit(names, beta, np.sqrt(np.diag(np.linalg.inv(h))), float("nan"), n)
    finally:
        kept.unpersist()
    raise ArithmeticError(f"no convergence in {max_iter} steps")


def clustered_wls(y: np.ndarray, x: np.ndarray, w: np.ndarray, clusters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares of a panel with CR1 errors by one cluster variable, or by two (V1 + V2 - V12)."""
    bread = np.linalg.pinv(x.T @ (w[:, None] * x))
    beta = bread @ (x.T @ (w * y))
    scores = x * (w * (y - x @ beta))[:, None]
    n, k = x.shape

    def meat(labels: np.ndarray) -> np.ndarray:
        codes = np.unique(labels, return_inverse=True, axis=0)[1].ravel()
        sums = np.zeros((codes.max() + 1, k))
        np.add.at(sums, codes, scores)
        g = len(sums)
        return (g / (g - 1)) * ((n - 1) / (n - k)) * bread @ (sums.T @ sums) @ bread

    v = meat(clusters[0])
    if len(clusters) == 2:
        v = v + meat(clusters[1]) - meat(np.stack(clusters, axis=1))
    return beta, np.sqrt(np.maximum(np.diag(v), 0))


def cluster_bootstrap(numerator: np.ndarray, denominator: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Ratios of sums over clusters drawn with replacement; each draw is a vector of multiplicities."""
    rng = np.random.default_rng(seed)
    n = len(numerator)
    out = np.empty(draws)
    for d in range(draws):
        times = np.bincount(rng.integers(0, n, n), minlength=n)
        out[d] = (times @ numerator) / (times @ denominator)
    return out


def calibration_slope(df: DataFrame, y: Column, p: Column) -> Fit:
    """Logistic regression of y on the logit of predicted chances: 0 and 1 for calibrated ones. Chances of 0 and 1 are left out."""
    held = df.where((p > 0) & (p < 1))
    return newton_logistic(held, y, {"logit": F.ln(p / (1 - p))}, c=1e6)


def moments_by_cluster(df: DataFrame, cluster: str, y: Column, x: Mapping[str, Column]) -> DataFrame:
    """Per cluster: n, and the sums of products of (1, x, y) that least squares need, as an array by rows."""
    names = [F.lit(1.0), *(c.cast("double") for c in x.values()), y.cast("double")]
    rows = df.select(cluster, *[c.alias(f"v{i}") for i, c in enumerate(names)]).na.drop()
    k = len(names)
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(k) for j in range(k)]
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("m"))


def game_bootstrap(moments: DataFrame, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, their draws) of least squares with whole clusters resampled: a draw adds up clusters' moments, which are a row each."""
    rows = moments.select("n", "m").collect()  # a row for each cluster
    m = np.array([r["m"] for r in rows], dtype=float)
    k = int(math.isqrt(m.shape[1]))
    m = m.reshape(-1, k, k)

    def solve(total: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(total[:-1, :-1], total[:-1, -1], rcond=None)[0]

    rng = np.random.default_rng(seed)
    picked = rng.multinomial(len(m), np.full(len(m), 1 / len(m)), size=draws)
    return solve(m.sum(axis=0)), np.stack([solve(np.einsum("c,cij->ij", w, m)) for w in picked])


def design_effect(n: np.ndarray, se_clustered: float, se_plain: float) -> tuple[float, float]:
    """(design effect, effective number of rows)."""
    effect = (se_clustered / se_plain) ** 2
    return effect, float(n.sum() / effect)


def paired_ratio_bootstrap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], draws: int, seed: int) -> np.ndarray:
    """Differences of two ratios of sums over the same clusters, drawn together."""
    rng = np.random.default_rng(seed)
    n = len(a[0])
    picked = rng.multinomial(n, np.full(n, 1 / n), size=draws)
    ratio = lambda pair: (picked @ pair[0]) / (picked @ pair[1])
    return ratio(a) - ratio(b)
