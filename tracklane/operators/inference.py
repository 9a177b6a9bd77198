"""Causal weighting, sensitivity and hierarchical estimates: sums in Spark, small vectors on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_effect(df: DataFrame, treated: Column, propensity: Column, outcome: Column) -> DataFrame:
    """One row: the difference of means under overlap weights (1 - p for treated, p for others), and effective sizes."""
    p, t, y = propensity.cast("double"), treated.cast("double"), outcome.cast("double")
    rows = df.select((t * (1 - p)).alias("w1"), ((1 - t) * p).alias("w0"), y.alias("y")).na.drop()
    mean = lambda w: F.sum(F.col(w) * F.col("y")) / F.sum(w)
    size = lambda w: F.pow(F.sum(w), F.lit(2)) / F.sum(F.col(w) * F.col(w))
    return rows.agg((mean("w1") - mean("w0")).alias("effect"), size("w1").alias("n_treated"), size("w0").alias("n_control"))


def standardised_difference(df: DataFrame, treated: Column, x: Column, weight: Column | None = None) -> DataFrame:
    """One row: (mean treated - mean others) / pooled standard deviation, weighted if weight is given."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(treated.cast("int").alias("t"), x.cast("double").alias("x"), w.cast("double").alias("w")).na.drop()
    part = lambda v, k: F.sum(F.when(F.col("t") == k, v))
    mean = {k: part(F.col("w") * F.col("x"), k) / part(F.col("w"), k) for k in (0, 1)}
    spread = {k: part(F.col("w") * F.col("x") * F.col("x"), k) / part(F.col("w"), k) - mean[k] * mean[k] for k in (0, 1)}
    return rows.agg(((mean[1] - mean[0]) / F.sqrt((spread[0] + spread[1]) / 2)).alias("smd"))


def e_value(risk_ratio: Column) -> Column:
    """Strength that an unmeasured confounder needs with treatment and outcome to explain the ratio away."""
    r = F.when(risk_ratio < 1, 1 / risk_ratio).otherwise(risk_ratio)
    return r + F.sqrt(r * (r - 1))


def robustness_value(t_value: float, dof: int) -> float:
    """Share of residual variance that a confounder must explain of both sides to bring the estimate to 0."""
    f2 = (abs(t_value) / math.sqrt(dof)) ** 2
    return 0.5 * (math.sqrt(f2 * f2 + 4 * f2) - f2)


def steiger_z(r12: float, r13: float, r23: float, n: int) -> float:
    """Test of two dependent correlations that share the first variable, with the covariance at their pooled value."""
    pooled = (r12 * r12 + r13 * r13) / 2
    f = min((1 - r23) / (2 * (1 - pooled)), 1.0)
    h = (1 - f * pooled) / (1 - pooled)
    return (math.atanh(r12) - math.atanh(r13)) * math.sqrt((n - 3) / (2 * (1 - r23) * h))


def permutation_p(x: np.ndarray, y: np.ndarray, draws: int, seed: int) -> float:
    """Two-sided p of the correlation: the share of random pairings that are as strong."""
    rng = np.random.default_rng(seed)
    a, b = ((v - v.mean()) / v.std() for v in (np.asarray(x, float), np.asarray(y, float)))
    random = np.stack([rng.permutation(b) for _ in range(draws)]) @ a
    return float(np.mean(np.abs(random) >= abs(b @ a) - 1e-9))


def cell_errors(df: DataFrame, cell: list[str], cluster: str, value: str) -> DataFrame:
    """Per cell: n, mean and clustered standard error of the mean, no smaller than sigma / sqrt(n) of all rows."""
    per_cluster = df.groupBy(*cell, cluster).agg(F.count(value).alias("m"), F.sum(value).alias("s"))
    total = per_cluster.groupBy(*cell).agg(F.sum("m").alias("n"), F.sum("s").alias("s_all"), F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("m")).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    mean = F.col("s_all") / F.col("n")
    scores = F.greatest(F.col("ss") - 2 * mean * F.col("sm") + mean * mean * F.col("mm"), F.lit(0.0))
    clustered = F.sqrt(F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1)).otherwise(1.0) * scores) / F.col("n")
    floor = df.agg(F.stddev_samp(value)).scalar() / F.sqrt("n")
    return total.select(*cell, "n", mean.alias("mean"), F.greatest(clustered, floor).alias("se"))


def gibbs_shrinkage(mean: np.ndarray, se: np.ndarray, draws: int = 2000, burn_in: int = 500, seed: int = 1, scale: float | None = None) -> dict[str, np.ndarray]:
    """Normal cells with known errors around a common mean; the spread has a half-normal prior, drawn on a grid.

    Returns the posterior means and deviations of the cells, and draws of mu and tau.
    """
    rng = np.random.default_rng(seed)
    scale = scale or float(np.std(mean)) or 1.0
    grid = np.linspace(1e-3, 4, 400) * scale
    mu, tau = float(np.average(mean, weights=1 / se**2)), scale
    total, square, kept = np.zeros(len(mean)), np.zeros(len(mean)), []
    for i in range(draws + burn_in):
        weight = tau**2 / (tau**2 + se**2)
        theta = rng.normal(weight * mean + (1 - weight) * mu, np.sqrt(weight) * se)
        mu = rng.normal(theta.mean(), tau / math.sqrt(len(theta)))
        log_p = -len(theta) * np.log(grid) - ((theta - mu) ** 2).sum() / (2 * grid**2) - grid**2 / (2 * scale**2)
        p = np.exp(log_p - log_p.max())
        tau = float(rng.choice(grid, p=p / p.sum()))
        if i >= burn_in:
            total += theta
            square += theta**2
            kept.append((mu, tau))
    post = total / draws
    return {"theta": post, "sd": np.sqrt(np.maximum(square / draws - post**2, 0)), "mu": np.array([k[0] for k in kept]), "tau": np.array([k[1] for k in kept])}


def greedy_matches(truth: list[tuple], found: list[tuple], window: int) -> list[tuple[int, int]]:
    """One-to-one pairs of events (kind, player, step): same kind and player, at most window apart, nearest first, then by place.

    In rounds: a pair is taken if it is the first choice of both its events
    among those left, which is what going through all pairs in order would do.
    """
    gap = np.full((len(truth), len(found)), np.inf)
    for i, (kind, player, step) in enumerate(truth):
        for j, other in enumerate(found):
            if other[:2] == (kind, player) and abs(other[2] - step) <= window:
                gap[i, j] = abs(other[2] - step)
    pairs = []
    while gap.size and np.isfinite(gap).any():
        i, j = np.unravel_index(np.arange(gap.size), gap.shape)
        order = np.where(np.isfinite(gap.ravel()), np.argsort(np.lexsort((j, i, gap.ravel()))), np.inf).reshape(gap.shape)
        first = np.isfinite(order) & (order == order.min(axis=1, keepdims=True)) & (order == order.min(axis=0, keepdims=True))
        for a, b in np.argwhere(first).tolist():
            pairs.append((gap[a, b], a, b))
            gap[a, :] = gap[:, b] = np.inf
    return [(a, b) for _, a, b in sorted(pairs)]


def precision_recall(n_truth: int, n_found: int, n_matched: int) -> tuple[float, float, float]:
    p = n_matched / n_found if n_found else float("nan")
    r = n_matched / n_truth if n_truth else float("nan")
    return p, r, 2 * n_matched / (n_truth + n_found) if n_truth + n_found else float("nan")


def evaluate_events(truth: DataFrame, found: DataFrame, by: list[str], window: int) -> DataFrame:
    """kind, n_truth, n_found, n_matched: matching within each key (a possession), summed over keys.

    Pairs of the same kind and player at most window apart are gone through by
    nearness, then by step; an event is matched once. A key's pairs are bounded
    by its events, and only they meet in one place.
    """
    key = [*by, "kind"]

    def numbered(events: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("player", "step")).alias(name)
        return events.select(*key, "player", F.col("step").alias(f"{name}_step"), place)

    gap = F.abs(F.col("i_step") - F.col("j_step"))
    pairs = numbered(truth, "i").join(numbered(found, "j"), [*key, "player"]).where(gap <= window)
    listed = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(gap.alias("gap"), "i", "j"))).alias("pairs"))
    none = F.array().cast("array<int>")
    free = lambda a, x: ~F.array_contains(a["i"], x["i"]) & ~F.array_contains(a["j"], x["j"])
    taken = lambda a, x: F.struct(F.array_append(a["i"], x["i"]).alias("i"), F.array_append(a["j"], x["j"]).alias("j"))
    matched = F.aggregate("pairs", F.struct(none.alias("i"), none.alias("j")), lambda a, x: F.when(free(a, x), taken(a, x)).otherwise(a), lambda a: F.size(a["i"]))
    count = lambda events, name: events.groupBy("kind").agg(F.count(F.lit(1)).alias(name))
    sums = listed.select("kind", matched.alias("m")).groupBy("kind").agg(F.sum("m").alias("n_matched"))
    out = count(truth, "n_truth").join(count(found, "n_found"), "kind", "full").join(sums, "kind", "left")
    return out.select("kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_truth", "n_found", "n_matched")])


def omitted_variable_bounds(estimate: float, se: float, dof: int, r2_treatment: float, r2_outcome: float) -> tuple[float, float, float]:
    """(bias, estimate brought toward 0 by it, its standard error) for an omitted variable that explains these shares of the residual variances of treatment and outcome."""
    bias = se * math.sqrt(dof) * math.sqrt(r2_outcome * r2_treatment / (1 - r2_treatment))
    adjusted = math.copysign(1.0, estimate) * (abs(estimate) - bias)
    return bias, adjusted, se * math.sqrt((1 - r2_outcome) / (1 - r2_treatment)) * math.sqrt(dof / (dof - 1))


def bias_contour(estimate: float, se: float, dof: int, shares: list[float]) -> list[tuple[float, float, float]]:
    """(share of the treatment, share of the outcome, adjusted estimate) over a grid of shares."""
    return [(a, b, omitted_variable_bounds(estimate, se, dof, a, b)[1]) for a in shares for b in shares]


def bonferroni(p: list[float]) -> list[float]:
    return [min(1.0, x * len(p)) for x in p]


def leave_one_out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlations without each of the points in turn, from sums."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    m = len(x) - 1
    sx, sy, sxx, syy, sxy = (v.sum() - v for v in (x, y, x * x, y * y, x * y))
    return (m * sxy - sx * sy) / np.sqrt((m * sxx - sx * sx) * (m * syy - sy * sy))
