"""Exact order statistics, ranks and split-half statistics with the conventions that results depend on."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.sources.shared import staged


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Value at index round-half-even(q * (n - 1)) of the sorted non-null values of each key."""
    return group_quantiles(df, by, value, {"quantile": q}, nearest=True)


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], nearest: bool = False) -> DataFrame:
    """Exact quantiles of the non-null values of each key, linear or by nearest rank, a column for each share.

    by names one column at least; for a whole column there is linear_quantiles.
    Equal values are counted before they move, and the counts of a key are dealt
    to cells of values, so a key may hold any share of the rows.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    placed = _with_keys(sum_below(counts, "v", "n", "below", by), total, by)
    held = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))
    out = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("__total") - 1)
        if nearest:
            out.append(held(F.rint(rank)).alias(name))
            continue
        low = F.floor(rank)
        a, b = held(low), held(F.least(low + 1, F.col("__total") - 1))
        out.append((a + F.max(rank - low) * (b - a)).alias(name))
    return placed.groupBy(*by).agg(*out)


def _with_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal."""
    other = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(by)]
    return left.join(other, same).drop(*[f"__r{i}" for i in range(len(by))])


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds `rank` (the mean of tied places, from 1) and `rank_pct` (100 * (rank - 1) / (n - 1), null for one row) within each key; null values have nulls.

    As group_quantiles, by counts of equal values.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    ranks = _with_keys(sum_below(counts, value, "__n", "__below", by), total, by)
    rank = F.col("__below") + (F.col("__n") + 1) / 2
    each = ranks.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, value])], rank.alias("rank"), (100 * (rank - 1) / F.nullif(F.col("__total") - 1, F.lit(0))).alias("rank_pct"))
    return df.join(each, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, value])], "left").drop(*[f"__k{i}" for i in range(len(by) + 1)])


def mode_stable(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, null counted as a value; the smallest of tied values, null before all others."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).isNotNull().alias("some"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.v").alias("mode"), (-F.col("best.k")).alias("n"))


#: Cells that values are dealt to, and rows above which they are.
CELLS, LEAF = 128, 1_000_000
#: Cells of equal width that a column's values are counted in.
SLICES = 4_096


def _dealt(df: DataFrame, value: str, cell: str = "__cell") -> DataFrame | None:
    """Adds the cell of a non-null number; None for up to LEAF rows, which are one cell. Approximate quantiles are the edges, so but for equal values cells hold about as many rows, whatever the outliers."""
    n, edges = df.agg(F.count(F.lit(1)), F.percentile_approx(value, [k / CELLS for k in range(1, CELLS)], 10 * CELLS)).first()
    if n <= LEAF:
        return None
    splits = [-math.inf, *sorted({float(e) for e in edges}), math.inf]
    number = df.withColumn("__number", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="__number", outputCol=cell).transform(number).withColumn(cell, F.col(cell).cast("int")).drop("__number")


def _sliced(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Adds the cell of column v: SLICES of equal width from low to high, in order, and one each for what is not finite."""
    wide = math.isinf(high - low)
    v, first, width = (F.col("v") / 2, low / 2, high / 2 - low / 2) if wide else (F.col("v"), low, high - low)
    cell = F.floor((v - F.lit(first)) / F.lit(width) * SLICES).cast("int")
    return rows.withColumn("__cell", F.when(F.isnan("v"), SLICES + 2).when(F.col("v") == math.inf, SLICES + 1).when(F.col("v") == -math.inf, -1).otherwise(cell))


def _values_at(rows: DataFrame, places: Sequence[int]) -> dict[int, float]:
    """The values of the double column v at these places (from 0) of its sorted rows: only the cells that hold them are looked into.

    The least and the greatest value are in different cells, so a cell that is
    cut again loses rows, whatever share of them is equal; a cell of one value
    needs no second look.
    """
    finite = F.when(~F.isnan("v") & (F.abs("v") != math.inf), F.col("v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(finite), F.max(finite)).first()
    cut = _sliced(rows, low, high) if n > LEAF and low is not None and low < high else rows.withColumn("__cell", F.when(F.isnan("v"), 2).when(F.col("v") == math.inf, 1).when(F.col("v") == -math.inf, -1).otherwise(0))
    totals = sorted((r["__cell"], r["c"], r["low"], r["high"]) for r in cut.groupBy("__cell").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")).collect())  # at most SLICES rows and four
    out, near, before = {}, {}, 0
    for cell, count, low, high in totals:
        own = [k - before for k in places if before <= k < before + count]
        if own and not low < high:
            out |= {before + k: low for k in own}
        elif own and count > LEAF:
            out |= {before + k: v for k, v in _values_at(rows.where(F.col("v").between(low, high)), own).items()}
        elif own:
            near[cell] = (before, own)
        before += count
    if near:
        wanted = [F.struct(F.lit(cell).alias("c"), F.lit(k).alias("i")) for cell, (_, own) in near.items() for k in own]
        placed = cut.where(F.col("__cell").isin(list(near))).withColumn("i", F.row_number().over(Window.partitionBy("__cell").orderBy("v")) - 1)  # at most LEAF rows each
        found = placed.where(F.struct(F.col("__cell").alias("c"), F.col("i")).isin(wanted)).select("__cell", "i", "v").collect()
        out |= {near[r["__cell"]][0] + r["i"]: r["v"] for r in found}
    return out


def linear_quantiles(df: DataFrame, value: str, shares: Sequence[float], stage: bool = True) -> list[float | None]:
    """Exact linear quantiles of a column's non-null values, without a task that holds all of them; nulls without values.

    The column is staged, so df is computed once; stage=False is for a df that is cheap to read again.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    rows = staged(rows) if stage else rows
    n = rows.count()
    if not n:
        return [None] * len(shares)
    ranks = [(int(q * (n - 1)), q * (n - 1) - int(q * (n - 1))) for q in shares]
    at = _values_at(rows, sorted({k for low, _ in ranks for k in (low, min(low + 1, n - 1))}))
    return [at[k] + part * (at[min(k + 1, n - 1)] - at[k]) if part else at[k] for k, part in ranks]


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds bin 1..bins by the linear quantiles of value; an edge belongs to the bin below it."""
    edges = [e for e in linear_quantiles(df, value, [k / bins for k in range(1, bins)]) if e is not None]
    below = sum(((F.col(value) > F.lit(e)).cast("int") for e in edges), F.lit(1))
    return df.withColumn("bin", F.when(F.col(value).isNotNull(), below).cast("long"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def split_halves(df: DataFrame, unit: str, half: Column, value: str, min_each: int) -> DataFrame:
    """One row per unit with the mean of value in either half (0 and 1), for units with min_each rows in both."""
    means = df.groupBy(unit).pivot("__half", [0, 1]) if "__half" in df.columns else df.withColumn("__half", half).groupBy(unit).pivot("__half", [0, 1])
    wide = means.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return wide.where((F.col("0_n") >= min_each) & (F.col("1_n") >= min_each)).select(unit, F.col("0_mean").alias("half_0"), F.col("1_mean").alias("half_1"))


def split_half_reliability(halves: DataFrame) -> DataFrame:
    """n, r between the halves, and 2 r / (1 + r)."""
    r = correlation("half_0", "half_1")
    return halves.agg(F.count(F.lit(1)).alias("n"), r.alias("r")).withColumn("reliability", 2 * F.col("r") / (1 + F.col("r")))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / m
    centre = p + z * z / (2 * m)
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    return (centre - spread) / scale, (centre + spread) / scale


def mann_whitney_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC of score for label 1 by average ranks; rows with nulls are left out."""
    held = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = held.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = sum_below(counted, score, "neg", "below")
    wins = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return wins.select("n_pos", "n_neg", (F.col("u") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0))).alias("auc"))


def sum_below(df: DataFrame, order: str, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of value over all rows of the key with a smaller `order` (numbers that are distinct in a key).

    Rows are dealt to cells of about equal size; the cells' totals carry the sums
    from cell to cell, so no task sorts all rows of a key.
    """
    rows_before = lambda *keys: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = _dealt(df, order)
    if dealt is None:
        return df.withColumn(name, rows_before(*by))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(*by, "__cell").agg(F.sum(value).alias("__t")).select(*by, "__cell", before.alias("__before"))
    joined = _with_keys(dealt, totals, [*by, "__cell"]) if by else dealt.join(F.broadcast(totals), "__cell")  # without keys at most CELLS rows
    return joined.withColumn(name, F.col("__before") + rows_before(*by, "__cell")).drop("__cell", "__before")


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, nulls, mean, deviation, least, quartiles and most."""
    held = staged(df.select(*columns))
    figures = {"n": F.count, "nulls": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    found = held.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in figures.items()]).first()
    rows = []
    for i, c in enumerate(columns):
        mean, sd, low, high = (None if found[f"{k}{i}"] is None else float(found[f"{k}{i}"]) for k in ("mean", "sd", "low", "high"))
        rows.append((c, found[f"n{i}"], found[f"nulls{i}"], mean, sd, low, *linear_quantiles(held, c, (0.25, 0.5, 0.75)), high))
    return df.sparkSession.createDataFrame(rows, "name string, n long, nulls long, mean double, sd double, low double, q25 double, q50 double, q75 double, high double")


def place_percentile(by: Sequence[str], value: str, tie: Sequence[str]) -> Column:
    """100 * place / (n - 1) of the sorted values, ties by `tie`; null for a single row."""
    key = Window.partitionBy(*by)
    return 100 * (F.row_number().over(key.orderBy(value, *tie)) - 1) / F.nullif(F.count(F.lit(1)).over(key) - 1, F.lit(0))


def row_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the place of each row in the order of a distinct number, from 0."""
    return sum_below(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name).drop("__one")
