"""Adjusted effects of a treatment: cross-fitted propensities and outcomes, overlap weights, doubly robust contrast, balance.

Fits are Spark's own regressions over a feature vector; a fold's rows are
predicted by models of the other folds. Estimates and their errors are sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.operators.stats import linear_quantiles
from tracklane.sources.shared import staged

#: Levels of a factor up to which it becomes indicators.
MOST_LEVELS = 1_000
#: Propensities outside are left out of the doubly robust contrast.
TRIM = (0.05, 0.95)


@dataclass
class Design:
    """Rows with `features` (array of double), and what its places stand for; the first len(linear) are standardised covariates."""

    rows: DataFrame
    names: list[str]
    linear: list[str]


def design(df: DataFrame, numeric: Mapping[str, Column], factors: Sequence[str] = (), bins: int = 10) -> Design:
    """Adds `features`: each covariate standardised, indicators of its quantile bins but the first, and of each factor's levels but the first.

    A value on an edge belongs to the bin above it. Rows with a null covariate or
    factor are left out.
    """
    columns = {f"__x{i}": c.cast("double") for i, c in enumerate(numeric.values())}
    rows = staged(df.withColumns(columns).na.drop(subset=[*columns, *factors]))
    scale = rows.agg(*[f(c).alias(f"{k}{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    linear, dummies, names = [], [], []
    for c, name in zip(columns, numeric, strict=True):
        linear.append((F.col(c) - F.lit(scale[f"m{c}"] or 0.0)) / F.lit((scale[f"s{c}"] or 0.0) + 1e-9))
        edges = sorted({e for e in linear_quantiles(rows, c, [k / bins for k in range(1, bins)]) if e is not None})
        if edges:
            rows = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=c, outputCol=f"{c}_bin").transform(rows)
        dummies += [F.col(f"{c}_bin") == k for k in range(1, len(edges) + 1)]
        names += [f"{name}_bin{k}" for k in range(1, len(edges) + 1)]
    for f in factors:
        levels = [r[0] for r in rows.select(f).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{f} has more than {MOST_LEVELS} levels")
        dummies += [F.col(f) == F.lit(v) for v in sorted(levels)[1:]]
        names += [f"{f}_{v}" for v in sorted(levels)[1:]]
    features = F.array(*linear, *[d.cast("double") for d in dummies])
    drop = [c for name in columns for c in (name, f"{name}_bin")]
    return Design(rows.withColumn("features", features).drop(*drop), [*numeric, *names], list(numeric))


def cross_fitted(rows: DataFrame, treated: str, outcome: str, fold: Column, folds: int, strength: float = 10.0) -> DataFrame:
    """Adds propensity (of treatment) and expected (outcome without treatment), each by models of the other folds.

    Propensity: logistic regression, L2 penalty 1 / (2 * strength) on the weights;
    expected: least squares over rows without treatment. Folds are 0..folds-1;
    with folds = 1 one pair of models is fitted on all rows. Raises if some models
    have no rows of both kinds.
    """
    held = staged(rows.withColumn("__fold", fold.cast("int")).withColumns({"__f": array_to_vector("features"), "__t": F.col(treated).cast("double"), "__y": F.col(outcome).cast("double")}).na.drop(subset=["__t", "__y", "__fold"]))
    counts = {(r["__fold"], r["__t"]): r["n"] for r in held.groupBy("__fold", "__t").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for k in range(folds):
        others = held if folds == 1 else held.where(F.col("__fold") != k)
        n = {t: sum(c for (f, own), c in counts.items() if own == t and (folds == 1 or f != k)) for t in (0.0, 1.0)}
        if not n[0.0] or not n[1.0]:
            raise ValueError(f"fold {k}: the other folds lack rows with or without treatment")
        shared = dict(featuresCol="__f", standardization=False, maxIter=300, tol=1e-9)
        odds = LogisticRegression(labelCol="__t", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label", regParam=1 / (strength * (n[0.0] + n[1.0])), **shared).fit(others)
        plain = LinearRegression(labelCol="__y", predictionCol="expected", regParam=0.0, **shared).fit(others.where("`__t` = 0"))
        mine = held if folds == 1 else held.where(F.col("__fold") == k)
        out.append(plain.transform(odds.transform(mine)).withColumn("propensity", vector_to_array("__p")[1]))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.drop("__f", "__p", "__raw", "__label", "__fold", "__t", "__y")


def effect(rows: DataFrame, treated: str, outcome: str, cluster: str, trim: tuple[float, float] = TRIM) -> DataFrame:
    """One row per estimator (overlap, att): estimate, se (by clusters, from influence sums), n, share (of rows kept).

    overlap: difference of means weighted by the chance of the other arm; att:
    doubly robust effect on the treated over rows whose propensity is within
    trim. rows: propensity, expected, treated, outcome; rows with a null among
    these are left out, a null cluster is one.
    """
    t, y, e, m = (F.col(c).cast("double") for c in (treated, outcome, "propensity", "expected"))
    inside = (e >= trim[0]) & (e <= trim[1])
    odds = F.when(inside, (1 - t) * e / (1 - e)).otherwise(0.0)
    arms = {"w1": (1 - e) * t, "w0": e * (1 - t), "k": inside.cast("double"), "kt": F.when(inside, t).otherwise(0.0), "r": F.when(inside, t * (y - m)).otherwise(0.0) - odds * (y - m)}
    held = rows.where(t.isNotNull() & y.isNotNull() & e.isNotNull() & m.isNotNull()).select(F.col(cluster).alias("g"), y.alias("y"), *[c.alias(n) for n, c in arms.items()])
    sums = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in arms], F.sum(F.col("w1") * F.col("y")).alias("y1"), F.sum(F.col("w0") * F.col("y")).alias("y0"))
    part = staged(sums)  # a row for each cluster
    total = part.agg(*[F.sum(c).alias(c) for c in ("n", "w1", "w0", "y1", "y0", "k", "kt", "r")])
    at = total.select("n", "k", "kt", "w1", "w0", F.try_divide("y1", "w1").alias("m1"), F.try_divide("y0", "w0").alias("m0"), F.try_divide("r", "kt").alias("att")).first()
    if not at["n"] or not at["w1"] or not at["w0"]:
        raise ValueError("no rows with or without treatment")
    one = F.col("y1") / at["w1"] - F.col("w1") * at["m1"] / at["w1"] - F.col("y0") / at["w0"] + F.col("w0") * at["m0"] / at["w0"]
    kept = at["kt"] or math.nan
    two = (F.col("r") - F.col("kt") * F.lit(at["att"])) / F.lit(kept)
    se = part.agg(F.sqrt(F.sum(one * one)).alias("overlap"), F.sqrt(F.sum(two * two)).alias("att")).first()
    found = [("overlap", at["m1"] - at["m0"], se["overlap"], at["n"], 1.0), ("att", at["att"], se["att"], int(at["k"]), at["k"] / at["n"])]
    return rows.sparkSession.createDataFrame(found, "estimator string, estimate double, se double, n long, share double")


def balance(rows: DataFrame, treated: Column, propensity: Column, covariates: Mapping[str, Column]) -> DataFrame:
    """Per covariate: its standardised mean difference (treated less others) before and after overlap weighting.

    Differences are over the root of the mean of both arms' unweighted variances.
    """
    t, e = treated.cast("double"), propensity.cast("double")
    names = list(covariates)
    held = rows.select(t.alias("t"), e.alias("e"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(covariates.values())]).na.drop(subset=["t", "e"])
    weights = {"plain": {1: F.col("t"), 0: 1 - F.col("t")}, "overlap": {1: (1 - F.col("e")) * F.col("t"), 0: F.col("e") * (1 - F.col("t"))}}
    tall = held.select("t", "e", F.explode(F.array(*[F.struct(F.lit(n).alias("covariate"), F.col(f"x{i}").alias("x")) for i, n in enumerate(names)])).alias("c")).select("t", "e", "c.*").where("x IS NOT NULL")
    sums = tall.groupBy("covariate").agg(*[F.sum(w * p).alias(f"{k}{arm}_{q}") for k, own in weights.items() for arm, w in own.items() for q, p in (("w", F.lit(1.0)), ("x", F.col("x")), ("xx", F.col("x") * F.col("x")))])
    mean = lambda k, arm: F.col(f"{k}{arm}_x") / F.nullif(F.col(f"{k}{arm}_w"), F.lit(0.0))
    variance = lambda arm: F.col(f"plain{arm}_xx") / F.nullif(F.col(f"plain{arm}_w"), F.lit(0.0)) - mean("plain", arm) ** 2
    spread = F.sqrt(F.greatest((variance(1) + variance(0)) / 2, F.lit(0.0))) + 1e-9
    return sums.select("covariate", *[((mean(k, 1) - mean(k, 0)) / spread).alias(name) for k, name in (("plain", "before"), ("overlap", "after"))])
