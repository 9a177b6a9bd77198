"""Statistical queries: quantiles, ranks, modes, split halves, rates, calibration and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.operators import stats
from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.fixtures import event_stream, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def r6(column):
    return F.round(column, 6)


@query(
    "mode_by_group",
    f"""WITH {EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL)
    SELECT user_id, event_type AS mode, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type NULLS FIRST) AS k FROM c) WHERE k = 1""",
)
def mode_by_group(spark, sf_dir):
    return stats.mode_stable(event_stream(spark, sf_dir), ["user_id"], "event_type")


@query(
    "nearest_rank_quantile",
    """WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, l_extendedprice AS quantile FROM r WHERE i = round_even(0.9 * (n - 1), 0)""",
)
def nearest_rank_quantile(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9)


@query(
    "linear_quantile",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.8), 6) AS q80, round(median(l_quantity), 6) AS median_quantity, round(quantile_cont(l_discount, 0.25), 6) AS q25 FROM lineitem GROUP BY l_returnflag",
)
def linear_quantile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = [stats.group_quantiles(li, ["l_returnflag"], c, {name: q}) for c, name, q in (("l_extendedprice", "q80", 0.8), ("l_quantity", "median_quantity", 0.5), ("l_discount", "q25", 0.25))]
    return parts[0].join(parts[1], "l_returnflag").join(parts[2], "l_returnflag").select("l_returnflag", *[r6(c).alias(c) for c in ("q80", "median_quantity", "q25")])


@query(
    "avg_rank_pct",
    """SELECT p_partkey, p_brand, round(100 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0), 6) AS pct FROM part""",
)
def avg_rank_pct(spark, sf_dir):
    ranked = stats.average_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")
    return ranked.select("p_partkey", "p_brand", r6("rank_pct").alias("pct"))


@query(
    "quintile_cut",
    """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part)
    SELECT p_partkey, (len(list_filter(e, lambda x: x < p_retailprice)) + 1)::BIGINT AS bin FROM part, q""",
)
def quintile_cut(spark, sf_dir):
    return stats.quantile_bins(table(spark, sf_dir, "part"), "p_retailprice", 5).select("p_partkey", "bin")


_HALVES = """m AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_orderkey % 2 = 0) AS half_0, avg(l_extendedprice) FILTER (l_orderkey % 2 = 1) AS half_1,
   count(*) FILTER (l_orderkey % 2 = 0) AS n0, count(*) FILTER (l_orderkey % 2 = 1) AS n1 FROM lineitem GROUP BY l_suppkey)"""


def _halves(spark, sf_dir):
    return stats.split_halves(table(spark, sf_dir, "lineitem"), "l_suppkey", (F.col("l_orderkey") % 2).cast("int"), "l_extendedprice", 20)


@query("pivot_halves_corr", f"WITH {_HALVES}, r AS (SELECT count(*)::BIGINT AS n, corr(half_0, half_1) AS r FROM m WHERE n0 >= 20 AND n1 >= 20) SELECT n, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS reliability FROM r")
def pivot_halves_corr(spark, sf_dir):
    return stats.split_half_reliability(_halves(spark, sf_dir)).select("n", r6("r").alias("r"), r6("reliability").alias("reliability"))


@query(
    "within_group_centred_corr",
    f"""WITH {_HALVES}, g AS (SELECT s_nationkey, half_0 - avg(half_0) OVER w AS a, half_1 - avg(half_1) OVER w AS b FROM m JOIN supplier ON s_suppkey = l_suppkey WHERE n0 >= 20 AND n1 >= 20 WINDOW w AS (PARTITION BY s_nationkey))
    SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS r FROM g""",
)
def within_group_centred_corr(spark, sf_dir):
    group = Window.partitionBy("s_nationkey")
    joined = _halves(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    centred = joined.select((F.col("half_0") - F.avg("half_0").over(group)).alias("a"), (F.col("half_1") - F.avg("half_1").over(group)).alias("b"))
    return centred.agg(F.count(F.lit(1)).alias("n"), r6(stats.correlation("a", "b")).alias("r"))


@query(
    "variance_shares",
    """WITH c AS (SELECT c_nationkey, c_custkey, avg(o_totalprice) AS m, var_samp(o_totalprice) / count(*) AS noise FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(*) >= 2),
    g AS (SELECT c_nationkey, avg(m) AS gm, var_samp(m) AS within_var, avg(noise) AS noise, count(*) AS k FROM c GROUP BY c_nationkey HAVING count(*) >= 2)
    SELECT round(var_samp(gm) / 1e6, 6) AS between_var, round(avg(within_var) / 1e6, 6) AS within_var, round(avg(noise) / 1e6, 6) AS noise_var, round((avg(within_var) - avg(noise)) / 1e6, 6) AS unit_var FROM g""",
)
def variance_shares(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    cells = joined.groupBy("c_nationkey", "c_custkey").agg(F.avg("o_totalprice").alias("m"), (F.var_samp("o_totalprice") / F.count(F.lit(1))).alias("noise"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    groups = cells.groupBy("c_nationkey").agg(F.avg("m").alias("gm"), F.var_samp("m").alias("w"), F.avg("noise").alias("noise"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    million = F.lit(1e6)
    return groups.agg(
        r6(F.var_samp("gm") / million).alias("between_var"), r6(F.avg("w") / million).alias("within_var"), r6(F.avg("noise") / million).alias("noise_var"), r6((F.avg("w") - F.avg("noise")) / million).alias("unit_var")
    )


@query(
    "conditional_aggregates",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) FILTER (l_discount > 0.05) AS q_discounted, count(*) FILTER (l_tax = 0)::BIGINT AS n_untaxed, avg((l_quantity > 25)::INT) AS share_large,
       bool_or(l_quantity = 50) AS any_full, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY ALL""",
)
def conditional_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("q_discounted"),
        F.count_if(F.col("l_tax") == 0).alias("n_untaxed"),
        F.avg((F.col("l_quantity") > 25).cast("double")).alias("share_large"),
        F.bool_or(F.col("l_quantity") == 50).alias("any_full"),
        F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@query(
    "rate_per_1000",
    f"""WITH {EVENTS}, x AS (SELECT user_id, count(*) AS exposure, count(*) FILTER (event_type = 'error') AS n FROM e GROUP BY user_id)
    SELECT user_id, exposure::BIGINT AS exposure, n::BIGINT AS n, round(1000.0 * n / exposure, 6)::DOUBLE AS rate FROM x""",
)
def rate_per_1000(spark, sf_dir):
    counts = event_stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("exposure"), F.count_if(F.col("event_type") == "error").alias("n"))
    return counts.withColumn("rate", r6(F.lit(1000.0) * F.col("n") / F.col("exposure")))


@query(
    "cube_rates",
    "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(1000.0 * count(*) FILTER (l_discount >= 0.08) / count(*), 6)::DOUBLE AS rate, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def cube_rates(spark, sf_dir):
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count(F.lit(1)).alias("n"), r6(F.lit(1000.0) * F.count_if(F.col("l_discount") >= 0.08) / F.count(F.lit(1))).alias("rate"), F.grouping_id("l_returnflag", "l_linestatus").alias("level"))


@query(
    "eb_shrinkage",
    """WITH c AS (SELECT o_custkey, c_mktsegment AS zone, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    z AS (SELECT zone, sum(k)::DOUBLE / sum(n) AS p FROM c GROUP BY zone),
    v AS (SELECT c.zone, var_pop(k::DOUBLE / n) AS raw, avg(z.p * (1 - z.p) / n) AS noise, count(*) AS u FROM c JOIN z USING (zone) WHERE n >= 5 GROUP BY c.zone),
    s AS (SELECT z.zone, p, CASE WHEN u >= 10 AND raw > noise THEN greatest(5, least(2000, p * (1 - p) / (raw - noise) - 1)) WHEN u >= 10 THEN 2000 ELSE 200 END AS strength FROM z LEFT JOIN v ON z.zone = v.zone)
    SELECT o_custkey, c.zone, n::BIGINT AS n, round((k + s.strength * p) / (n + s.strength), 6) AS shrunk FROM c JOIN s ON c.zone = s.zone""",
)
def eb_shrinkage(spark, sf_dir):
    return _shrunk(spark, sf_dir).select("o_custkey", "zone", "n", r6((F.col("k") + F.col("strength") * F.col("p")) / (F.col("n") + F.col("strength"))).alias("shrunk"))


def _zone_orders(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("zone"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("hit")).join(customers, "o_custkey")


def _shrunk(spark, sf_dir):
    """Units with their zone's rate and prior strength, by moments over units with 5 rows (10 such units at least)."""
    units = _zone_orders(spark, sf_dir).groupBy("o_custkey", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    zones = units.groupBy("zone").agg((F.sum("k") / F.sum("n")).alias("p"))
    enough = units.where("n >= 5").join(zones, "zone")
    moments = enough.groupBy("zone").agg(F.var_pop(F.col("k") / F.col("n")).alias("raw"), F.avg(F.col("p") * (1 - F.col("p")) / F.col("n")).alias("noise"), F.count(F.lit(1)).alias("u"))
    fitted = F.greatest(F.lit(5.0), F.least(F.lit(2000.0), F.col("p") * (1 - F.col("p")) / (F.col("raw") - F.col("noise")) - 1))
    strength = F.when((F.col("u") >= 10) & (F.col("raw") > F.col("noise")), fitted).when(F.col("u") >= 10, 2000.0).otherwise(200.0)
    return units.join(zones.join(moments, "zone", "left").select("zone", "p", strength.alias("strength")), "zone")


@query(
    "loo_skill",
    """WITH b AS (SELECT o_orderkey, o_custkey, c_mktsegment AS zone, (o_orderstatus = 'F')::INT AS hit FROM orders JOIN customer ON c_custkey = o_custkey),
    z AS (SELECT zone, avg(hit) AS p FROM b GROUP BY zone),
    t AS (SELECT b.*, p, (sum(hit) OVER w - hit + 200 * p) / (count(*) OVER w - 1 + 200) AS q FROM b JOIN z USING (zone) WINDOW w AS (PARTITION BY o_custkey, b.zone))
    SELECT o_orderkey, round(ln(greatest(1e-4, least(1 - 1e-4, q)) / (1 - greatest(1e-4, least(1 - 1e-4, q)))) - ln(p / (1 - p)), 6) AS skill FROM t""",
)
def loo_skill(spark, sf_dir):
    rows = _zone_orders(spark, sf_dir)
    unit = Window.partitionBy("o_custkey", "zone")
    with_rate = rows.join(rows.groupBy("zone").agg(F.avg("hit").alias("p")), "zone")
    q = (F.sum("hit").over(unit) - F.col("hit") + 200 * F.col("p")) / (F.count(F.lit(1)).over(unit) - 1 + 200)
    clipped = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), q))
    return with_rate.withColumn("q", clipped).select("o_orderkey", r6(F.ln(F.col("q") / (1 - F.col("q"))) - F.ln(F.col("p") / (1 - F.col("p")))).alias("skill"))


@query(
    "linear_fit",
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
)
def linear_fit(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 5).alias("intercept"), r6(F.corr(y, x)).alias("r"), r6(F.regr_r2(y, x)).alias("r2"))


_SCORED = """s AS (SELECT l.doc_id, l.quality AS y, 1 / (1 + exp(-(ln(1 + d.n_chars) - 6))) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    p = 1 / (1 + F.exp(-(F.ln(1 + F.col("n_chars")) - 6)))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id").withColumn("p", p)


@query(
    "logloss_brier_auc",
    f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s)
    SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier,
           round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6)::DOUBLE AS auc FROM r""",
)
def logloss_brier_auc(spark, sf_dir):
    s = _scored(spark, sf_dir)
    y, p = F.col("y"), F.col("p")
    losses = s.agg(r6(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).alias("log_loss"), r6(F.avg(F.pow(p - y, F.lit(2)))).alias("brier"))
    return losses.withColumn("auc", stats.mann_whitney_auc(s, "p", "y").select(r6("auc")).scalar())


@query(
    "calibration_deciles",
    f"""WITH {_SCORED}, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s),
    b AS (SELECT s.*, len(list_filter(e, lambda x: x < p)) + 1 AS bin FROM s, q)
    SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY bin""",
)
def calibration_deciles(spark, sf_dir):
    return stats.quantile_bins(_scored(spark, sf_dir), "p", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("predicted"), r6(F.avg("y")).alias("observed"))


@query(
    "weighted_split_rates",
    """WITH g AS (SELECT l_suppkey, l_orderkey % 2 AS half, sum(l_quantity) AS n, sum(l_quantity * l_discount) AS k FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, round(sum(k) / sum(n), 6) AS rate, round(sum(k) FILTER (half = 0) / sum(n) FILTER (half = 0), 6) AS rate_0, round(sum(k) FILTER (half = 1) / sum(n) FILTER (half = 1), 6) AS rate_1 FROM g GROUP BY l_suppkey""",
)
def weighted_split_rates(spark, sf_dir):
    n, k, half = F.col("l_quantity"), F.col("l_quantity") * F.col("l_discount"), F.col("l_orderkey") % 2
    part = lambda h: F.sum(F.when(half == h, k)) / F.sum(F.when(half == h, n))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r6(F.sum(k) / F.sum(n)).alias("rate"), r6(part(0)).alias("rate_0"), r6(part(1)).alias("rate_1"))


@query(
    "game_ratio_sums",
    """WITH g AS (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY l_orderkey), t AS (SELECT sum(a) / sum(b) AS r, count(*) AS m, avg(b) AS mb FROM g)
    SELECT m::BIGINT AS n_games, round(any_value(r), 6) AS ratio, round(1e6 * sqrt(sum((a - r * b) ** 2) / (any_value(m) - 1) / any_value(m)) / any_value(mb), 4) AS se_ppm FROM g, t GROUP BY m""",
)
def game_ratio_sums(spark, sf_dir):
    games = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("a"), F.sum("l_extendedprice").alias("b"))
    # one pass: sum (a - r b)^2 = saa - 2 r sab + r^2 sbb would cancel; centred moments do not
    sums = games.agg(F.count(F.lit(1)).alias("m"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.covar_pop("a", "b").alias("cab"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    r = F.col("sa") / F.col("sb")
    spread = F.col("va") - 2 * r * F.col("cab") + r * r * F.col("vb")  # residuals have mean 0
    se = F.lit(1e6) * F.sqrt(spread / (F.col("m") - 1)) / (F.col("sb") / F.col("m"))
    return sums.select(F.col("m").alias("n_games"), r6(r).alias("ratio"), F.round(se, 4).alias("se_ppm"))


@query(
    "rank_correlation",
    """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part),
    c AS (SELECT corr(a, b) AS r, count(*) AS n FROM r)
    SELECT n::BIGINT AS n, round(r, 6) AS spearman, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM c""",
)
def rank_correlation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ranks = part
    for column, name in (("p_size", "a"), ("p_retailprice", "b")):
        counts = part.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        ranked = stats.sum_below(counts, column, "n", "below").select(column, (F.col("below") + (F.col("n") + 1) / 2).alias(name))
        ranks = ranks.join(ranked, column)
    c = ranks.agg(stats.correlation("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return c.select("n", r6("r").alias("spearman"), r6(F.tanh(F.atanh("r") - half)).alias("low"), r6(F.tanh(F.atanh("r") + half)).alias("high"))


@query(
    "wilson_interval",
    """WITH c AS (SELECT l_shipdate.year() AS y, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY ALL), p AS (SELECT *, k::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
    SELECT y::BIGINT AS year, n::BIGINT AS n, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM p""",
)
def wilson_interval(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("year", "n", r6(low).alias("low"), r6(high).alias("high"))


@query(
    "ols_context_r2",
    None,
)
def ols_context_r2(spark, sf_dir):
    from tracklane.operators.regression import ols

    li = table(spark, sf_dir, "lineitem")
    x = {"quantity": F.col("l_quantity"), "quantity_sq": F.col("l_quantity") ** 2, "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    return ols(li, F.col("l_extendedprice"), x).as_frame(spark)


@query(
    "team_centred_bins",
    """WITH t AS (SELECT o_custkey, o_totalprice - avg(o_totalprice) OVER w AS y, month(o_orderdate) - avg(month(o_orderdate)) OVER w AS x FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    q AS (SELECT quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM t), b AS (SELECT t.*, len(list_filter(e, lambda v: v < x)) + 1 AS bin FROM t, q)
    SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(x), 5) AS x, round(avg(y), 4) AS y, round(stddev_samp(y) / sqrt(count(*)), 4) AS se FROM b GROUP BY bin""",
)
def team_centred_bins(spark, sf_dir):
    own = Window.partitionBy("o_custkey")
    month = F.month("o_orderdate")
    centred = table(spark, sf_dir, "orders").select((F.col("o_totalprice") - F.avg("o_totalprice").over(own)).alias("y"), (month - F.avg(month).over(own)).alias("x"))
    return stats.quantile_bins(centred, "x", 8).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("x"), F.round(F.avg("y"), 4).alias("y"), F.round(F.stddev_samp("y") / F.sqrt(F.count(F.lit(1))), 4).alias("se"))
