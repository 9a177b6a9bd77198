"""Panel regressions: fixed effects taken out by alternating group means, clustered errors, and resampling of clusters.

Effects may have any number of levels: rows are summed to cells of equal levels,
the means of one effect after the other are taken off the cells until nothing
moves, and rows get their cell's adjustment in one join. What follows is sums of
a few columns. Resampling needs each cluster's matrix of moments, one row a
cluster, for designs of a bounded number of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.sources.shared import staged

#: Columns of a design, dummies included, up to which clusters' moments are built; cells up to which they are gathered.
MOST_COLUMNS, MOST_CELLS = 400, 1_000_000

# The six equally likely weights of the wild bootstrap for few clusters.
SIX_POINTS = np.array([-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5)])


def _rows(df: DataFrame, y: Column, x: Mapping[str, Column], weight: Column | None, keep: Sequence[str]) -> DataFrame:
    """Rows without nulls: kept columns under own names, v0.. (regressors), v<last> (y), w."""
    values = [c.cast("double").alias(f"v{i}") for i, c in enumerate([*x.values(), y])]
    w = (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")
    return df.select(*dict.fromkeys(keep), *values, w).na.drop()


def demeaned(rows: DataFrame, columns: Sequence[str], effects: Sequence[str], tolerance: float = 1e-10, most_rounds: int = 500) -> DataFrame:
    """rows with weighted means over each effect taken off columns, all effects at once.

    rows have a weight w, and no nulls. With one effect one round is exact; with
    more, rounds go on until no mean is above tolerance times its column's
    spread. Raises if that takes more than most_rounds.
    """
    if not effects:
        means = rows.agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns]).first()
        return rows.withColumns({c: F.col(c) - F.lit(means[c] or 0.0) for c in columns})
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    cells = staged(rows.groupBy(*effects).agg(*[mean(c) for c in columns], F.sum("w").alias("w")).withColumns({f"{c}_left": F.col(c) for c in columns}))
    spread = cells.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in columns]).first()
    for _ in range(most_rounds):
        part = cells
        for k, e in enumerate(effects):
            means = part.groupBy(e).agg(*[(F.sum(F.col("w") * F.col(f"{c}_left")) / F.sum("w")).alias(f"{c}_{k}") for c in columns])
            part = part.join(means, e).withColumns({f"{c}_left": F.col(f"{c}_left") - F.col(f"{c}_{k}") for c in columns})
        part = staged(part)
        moved = part.agg(*[F.greatest(*[F.max(F.abs(f"{c}_{k}")) for k in range(len(effects))], F.lit(0.0)).alias(c) for c in columns]).first()
        cells = part.drop(*[f"{c}_{k}" for c in columns for k in range(len(effects))])
        if len(effects) == 1 or all((moved[c] or 0.0) <= tolerance * max(spread[c], 1e-300) for c in columns):
            off = cells.select(*effects, *[(F.col(c) - F.col(f"{c}_left")).alias(f"{c}_off") for c in columns])
            return rows.join(off, list(effects)).withColumns({c: F.col(c) - F.col(f"{c}_off") for c in columns}).drop(*[f"{c}_off" for c in columns])
    raise ArithmeticError(f"group means still move after {most_rounds} rounds")


@dataclass
class PanelFit:
    """Coefficients; rows hold w, the regressors less their effects (v0..), and the residual."""

    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    parameters: int
    rows: DataFrame

    def scores(self, clusters: Sequence[str]) -> DataFrame:
        """Per cluster: the sum of w * regressor * residual for each regressor (s0..)."""
        return self.rows.groupBy(*clusters).agg(*[F.sum(F.col("w") * F.col(f"v{i}") * F.col("residual")).alias(f"s{i}") for i in range(len(self.names))])

    def covariance(self, clusters: Sequence[str]) -> np.ndarray:
        """CR1 covariance of the coefficients by the clusters of these columns together."""
        d = range(len(self.names))
        sums = self.scores(clusters).agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in d for j in d]).first()
        meat = np.array([[sums[f"m{i}_{j}"] for j in d] for i in d])
        return self.bread @ meat @ self.bread * (sums["g"] / (sums["g"] - 1)) * ((self.n - 1) / (self.n - self.parameters))

    def errors(self, *clusters: str) -> np.ndarray:
        """Standard errors by one cluster variable or by two (the two less their intersection)."""
        v = self.covariance([clusters[0]])
        if len(clusters) == 2:
            v = v + self.covariance([clusters[1]]) - self.covariance(list(clusters))
        return np.sqrt(np.maximum(np.diag(v), 0))

    def influence(self, cluster: str) -> DataFrame:
        """Per cluster: the sum of the influence on each coefficient, a column by its name; products of two models' sums give their covariance."""
        scores = self.scores([cluster])
        each = [sum((F.lit(float(self.bread[i, j])) * F.col(f"s{j}") for j in range(len(self.names))), F.lit(0.0)).alias(name) for i, name in enumerate(self.names)]
        return scores.select(cluster, *each)


def fixed_effects(df: DataFrame, y: Column, x: Mapping[str, Column], effects: Sequence[str] = (), weight: Column | None = None, clusters: Sequence[str] = ()) -> PanelFit:
    """Weighted least squares of y on x with an intercept and the effects of these columns.

    Rows with a null in y, x, weight, effects or clusters are left out. The
    number of parameters is that of a design with one level left out of each
    effect. Regressors that do not vary within the effects get 0.
    """
    names, d = list(x), len(x)
    given = staged(_rows(df, y, x, weight, [*effects, *clusters]))
    columns = [f"v{i}" for i in range(d + 1)]
    rows = staged(demeaned(given, columns, effects))
    pairs = [(i, j) for i in range(d) for j in range(d + 1)]
    levels = [F.count_distinct(e).alias(f"levels{k}") for k, e in enumerate(effects)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *levels, *[F.sum(F.col("w") * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    m = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in range(d + 1)] for i in range(d)])
    bread = np.linalg.pinv(m[:, :d])
    beta = bread @ m[:, d]
    residual = F.col(f"v{d}") - sum((F.lit(float(b)) * F.col(f"v{i}") for i, b in enumerate(beta)), F.lit(0.0))
    parameters = 1 + d + sum(max(sums[f"levels{k}"] - 1, 0) for k in range(len(effects)))
    return PanelFit(names, beta, bread, sums["n"], parameters, rows.withColumn("residual", residual))


@dataclass
class ClusterMoments:
    """Per cluster, the weighted sums of products of (regressors, 1, effects' dummies, y), in this order; n rows."""

    names: list[str]
    clusters: list
    m: np.ndarray
    n: int


def cluster_moments(df: DataFrame, cluster: str, y: Column, x: Mapping[str, Column], effects: Sequence[str] = (), weight: Column | None = None) -> ClusterMoments:
    """Moments for resampling clusters. Sums are over cells of cluster and levels; raises if a design of dummies is too wide for that."""
    rows = _rows(df, y, x, weight, [cluster, *effects])
    dense = len(x) + 1
    pairs = [(i, j) for i in range(dense) for j in range(i + 1)]
    products = [F.sum(F.col("w") * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    cells = staged(rows.groupBy(*dict.fromkeys([cluster, *effects])).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"v{i}")).alias(f"t{i}") for i in range(dense)], *products))
    levels = [sorted(r[0] for r in cells.select(e).distinct().limit(MOST_COLUMNS + 1).collect())[1:] for e in effects]
    width = dense + 1 + sum(map(len, levels))
    if width > MOST_COLUMNS or cells.count() > MOST_CELLS:
        raise ValueError(f"a design of more than {MOST_COLUMNS} columns or {MOST_CELLS} cells; use fixed_effects")
    held = cells.collect()
    names = sorted({r[cluster] for r in held})
    at, of = {c: i for i, c in enumerate(names)}, {}
    start = dense
    for e, own in zip(effects, levels, strict=True):
        of[e] = {v: start + i for i, v in enumerate(own)}
        start += len(own)
    m = np.zeros((len(names), width, width))
    for r in held:
        place = [*range(dense - 1), width - 1]
        ones = [dense - 1, *(of[e][r[e]] for e in effects if r[e] in of[e])]
        own = m[at[r[cluster]]]
        for i, j in pairs:
            a, b = place[i], place[j]
            own[a, b] += r[f"p{i}_{j}"]
            own[b, a] = own[a, b]
        for a, b in product(ones, ones):
            own[a, b] += r["w"]
        for a, i in product(ones, range(dense)):
            own[a, place[i]] += r[f"t{i}"]
            own[place[i], a] = own[a, place[i]]
    return ClusterMoments(list(x), names, m, sum(r["n"] for r in held))


def coefficients(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]


def resampled(moments: ClusterMoments, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the regressors, their draws) with whole clusters drawn with replacement."""
    d, g = len(moments.names), len(moments.clusters)
    picked = np.random.default_rng(seed).multinomial(g, np.full(g, 1 / g), size=draws)
    return coefficients(moments.m.sum(axis=0))[:d], np.stack([coefficients(np.einsum("c,cij->ij", w, moments.m))[:d] for w in picked])


def wild_p(moments: ClusterMoments, draws: int = 999, seed: int = 10, weights: np.ndarray | None = None) -> float:
    """p of the first regressor's coefficient by the wild cluster bootstrap of t with the null imposed: (hits + 1) / (draws + 1).

    weights: draws x clusters, in place of drawn six-point weights.
    """
    m, g = moments.m, len(moments.clusters)
    total = m.sum(axis=0)
    inverse = np.linalg.pinv(total[:-1, :-1])
    line = inverse[0]
    rest = np.arange(1, total.shape[0] - 1)
    null = np.linalg.pinv(total[np.ix_(rest, rest)]) @ total[rest, -1]
    fitted = m[:, :-1, rest] @ null  # a cluster's products of regressors and fitted values
    shocks = m[:, :-1, -1] - fitted  # and of regressors and restricted residuals
    spread = np.einsum("i,cij->cj", line, m[:, :-1, :-1])

    def t(products: np.ndarray) -> np.ndarray:
        """t of each draw from draws x clusters x columns products of regressors and outcome, reduced to the sums it needs."""
        beta = products.sum(axis=1) @ inverse
        scores = products @ line - beta @ spread.T
        return beta[:, 0] / np.sqrt((scores**2).sum(axis=1))

    if weights is None:
        weights = SIX_POINTS[np.random.default_rng(seed).integers(0, 6, (draws, g))]
    seen = abs(t(m[None, :, :-1, -1])[0])
    hits = sum(int((np.abs(t(fitted[None] + w[:, :, None] * shocks[None])) >= seen).sum()) for w in np.array_split(weights, max(1, len(weights) // 64)))
    return (hits + 1) / (len(weights) + 1)
