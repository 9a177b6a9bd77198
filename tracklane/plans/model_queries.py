"""Sequence models, regressions and resampling."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tracklane.operators import effects, hmm, inference, learned, mixture, panel, regression, tracking
from tracklane.plans.registry import EVENTS, Registry
from tracklane.plans.track_queries import frames
from tracklane.sources import virtual
from tracklane.sources.fixtures import event_stream, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

PARAMS = hmm.Params(gamma=((0.55, 0.18, 0.27), (0.70, 0.12, 0.18)), sigma2=(9.0, 6.0), rho=0.92)


def r6(column):
    return F.round(column, 6)


def _viterbi_sql(help_state: tuple | None = None) -> str:
    (wo, wb, wh), (so, sb, sh) = PARAMS.gamma
    side = "sign(o.off_y - 25) = sign(d.ball_y - 25)"
    mu = lambda axis, hoop: f"CASE WHEN {side} THEN {so}::DOUBLE * o.off_{axis} + {sb}::DOUBLE * d.ball_{axis} + {sh}::DOUBLE * {hoop} ELSE {wo}::DOUBLE * o.off_{axis} + {wb}::DOUBLE * d.ball_{axis} + {wh}::DOUBLE * {hoop} END"
    s2 = f"CASE WHEN {side} THEN {PARAMS.sigma2[1]}::DOUBLE ELSE {PARAMS.sigma2[0]}::DOUBLE END"
    states = 5 if help_state is None else 6
    stay, move = math.log(PARAMS.rho), math.log((1 - PARAMS.rho) / (states - 1))
    helping = ""
    if help_state is not None:
        share, spread = help_state
        square = " + ".join(f"(def_{axis} - ({hoop} + {share}::DOUBLE * (ball_{axis} - {hoop}))) ** 2" for axis, hoop in (("x", "5.25"), ("y", "25.0")))
        helping = f" UNION ALL SELECT possession, step, slot, 5 AS man, -0.5 * ({square}) / {spread}::DOUBLE - ln({spread}::DOUBLE) - ln(2 * pi()) AS lb FROM vt"
    steps = [f"v0 AS (SELECT possession, slot, man, lb - ln({states}::DOUBLE) AS lp, [man] AS path FROM e WHERE step = 0)"]
    for t in range(1, virtual.STEPS):
        score = f"p.lp + CASE WHEN p.man = e.man THEN {stay}::DOUBLE ELSE {move}::DOUBLE END"
        steps.append(f"v{t} AS (SELECT e.possession, e.slot, e.man, max({score}) + any_value(lb) AS lp, list_append(arg_max(p.path, {score}), e.man) AS path FROM e JOIN v{t - 1} p ON p.possession = e.possession AND p.slot = e.slot WHERE e.step = {t} GROUP BY e.possession, e.slot, e.man)")
    return f"""WITH {virtual.SQL},
    e AS (SELECT d.possession, d.step, d.slot, o.slot AS man, -0.5 * ((d.def_x - ({mu("x", "5.25")})) ** 2 + (d.def_y - ({mu("y", "25.0")})) ** 2) / ({s2}) - ln({s2}) - ln(2 * pi()) AS lb FROM vt d JOIN vt o USING (possession, step){helping}),
    {", ".join(steps)}
    SELECT possession, slot, array_to_string(arg_max(path, lp), '') AS path FROM v{virtual.STEPS - 1} GROUP BY ALL"""


@query("matchup_viterbi", _viterbi_sql())
def matchup_viterbi(spark, sf_dir):
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "")
    return hmm.paths(hmm.chains(frames(spark, sf_dir)), PARAMS).select("possession", "slot", path.alias("path"))


@query("matchup_viterbi_help", _viterbi_sql(help_state=(0.45, 30.0)))
def matchup_viterbi_help(spark, sf_dir):
    """As matchup_viterbi, with a state of helping (5)."""
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "")
    return hmm.paths(hmm.chains(frames(spark, sf_dir)), replace(PARAMS, help=(0.45, 30.0))).select("possession", "slot", path.alias("path"))


@query("matchup_em")
def matchup_em(spark, sf_dir):
    """Fitted weights, variances and stay probability, with the log-likelihood per observation of each iteration."""
    p = hmm.fit(hmm.chains(frames(spark, sf_dir)), max_iter=8)
    rows = [(f"gamma_{side}_{name}", float(v)) for side, g in zip(("weak", "strong"), p.gamma, strict=True) for name, v in zip(("o", "b", "h"), g, strict=True)]
    rows += [(f"sigma2_{side}", float(v)) for side, v in zip(("weak", "strong"), p.sigma2, strict=True)] + [("rho", p.rho)]
    rows += [(f"loglik_{i}", float(v)) for i, v in enumerate(p.history)]
    return spark.createDataFrame(rows, "name string, value double")


@query("matchup_em_help")
def matchup_em_help(spark, sf_dir):
    """As matchup_em, one group of weights, with a state of helping."""
    p = hmm.fit(hmm.chains(frames(spark, sf_dir)), hmm.Params(stratified=False, help=(0.5, 25.0)), max_iter=6)
    rows = [(f"gamma_{name}", float(v)) for name, v in zip(("o", "b", "h"), p.gamma[0], strict=True)] + [("sigma2", p.sigma2[0]), ("rho", p.rho), ("help_share", p.help[0]), ("help_sigma2", p.help[1])]
    return spark.createDataFrame(rows + [(f"loglik_{i}", float(v)) for i, v in enumerate(p.history)], "name string, value double")


def event_codes(rows):
    """frames with an event code for each defender: bits of a made-up rule on possession, step and slot."""
    code = lambda j: (F.col("possession") + F.col("step") * 3 + j * 5) % hmm.PATTERNS
    return rows.withColumn("code", F.transform(F.sequence(F.lit(0), F.lit(4)), code))


@query("matchup_em_events")
def matchup_em_events(spark, sf_dir):
    """Fit of event-dependent switching: coefficients and the log-likelihood per observation of each iteration."""
    start = hmm.Params(beta=(-2.0,) + (0.0,) * len(hmm.COVARIATES))
    p = hmm.fit(hmm.chains(event_codes(frames(spark, sf_dir)), "code"), start, max_iter=5)
    rows = [(f"beta_{name}", v) for name, v in zip(("0", *hmm.COVARIATES), p.beta, strict=True)]
    return spark.createDataFrame(rows + [(f"loglik_{i}", float(v)) for i, v in enumerate(p.history)], "name string, value double")


@query("matchup_em_starts")
def matchup_em_starts(spark, sf_dir):
    """The same fit from three starts: chance to stay and log-likelihood per observation where each ends."""
    starts = {"even": hmm.Params(gamma=((1 / 3,) * 3,) * 2), "attacker": hmm.Params(gamma=((0.9, 0.05, 0.05),) * 2), "loose": hmm.Params(rho=0.6, sigma2=(25.0, 25.0))}
    fitted = hmm.fit_each(hmm.chains(frames(spark, sf_dir)), list(starts.values()), max_iter=6)
    out = [(name, p.rho, float(p.history[-1]), len(p.history)) for name, p in zip(starts, fitted, strict=True)]
    return spark.createDataFrame(out, "start string, rho double, loglik double, iterations int")


@query("newton_logistic")
def newton_logistic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return regression.newton_logistic(rows, F.col("quality"), {"log_chars": F.ln(1 + F.col("n_chars")), "toxic": F.col("toxic")}, c=1.0).as_frame(spark)


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    """Ratio of discount value to price, resampled by nation of the supplier (25 clusters)."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sums = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey").groupBy("s_nationkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("a"), F.sum("l_extendedprice").alias("b"))
    rows = sorted((r["s_nationkey"], r["a"], r["b"]) for r in sums.collect())  # a row for each nation
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    draws = regression.cluster_bootstrap(a, b, 1000, seed=11)
    return spark.createDataFrame([(float(a.sum() / b.sum()), *(float(q) for q in np.quantile(draws, [0.025, 0.975])), len(rows))], "ratio double, low double, high double, n_clusters int")


_PANEL = """p AS (SELECT s_nationkey AS g, year(l_shipdate) AS t, avg(l_extendedprice) AS y, avg(l_quantity) AS x, count(*)::DOUBLE AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""


def _panel(spark, sf_dir):
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey")
    return lines.groupBy(F.col("s_nationkey").alias("g"), F.year("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("x"), F.count(F.lit(1)).alias("w"))


_ERRORS = """b AS (SELECT sum(w * x * y) / sum(w * x * x) AS slope, sum(w * x * x) AS d, count(*) AS n FROM q),
    s AS (SELECT g, t, w * x * (y - slope * x) / d AS s FROM q, b),
    c1 AS (SELECT sum(v * v) AS v, count(*) AS k FROM (SELECT sum(s) AS v FROM s GROUP BY g)), c2 AS (SELECT sum(v * v) AS v, count(*) AS k FROM (SELECT sum(s) AS v FROM s GROUP BY t)), c12 AS (SELECT sum(v * v) AS v, count(*) AS k FROM (SELECT sum(s) AS v FROM s GROUP BY g, t)),
    a AS (SELECT slope, n, c1.v * c1.k / (c1.k - 1) AS v1, c2.v * c2.k / (c2.k - 1) AS v2, c12.v * c12.k / (c12.k - 1) AS v12, (n - 1)::DOUBLE / (n - {rest}) AS f FROM b, c1, c2, c12)
    SELECT 'nation' AS clusters, round(slope, 5) AS slope, round(sqrt(v1 * f), 4) AS se, n::INT AS n FROM a UNION ALL SELECT 'nation_year', round(slope, 5), round(sqrt(greatest((v1 + v2 - v12) * f, 0)), 4), n::INT FROM a"""


def _panel_errors(spark, fit):
    rows = [(name, round(float(fit.beta[0]), 5), round(float(fit.errors(*c)[0]), 4), fit.n) for name, c in (("nation", ["g"]), ("nation_year", ["g", "t"]))]
    return spark.createDataFrame(rows, "clusters string, slope double, se double, n int")


@query(
    "wls_fe_cluster",
    f"""WITH {_PANEL}, m AS (SELECT g, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM p GROUP BY g), q AS (SELECT g, t, w, x - mx AS x, y - my AS y FROM p JOIN m USING (g)),
    {_ERRORS.format(rest="(SELECT count(DISTINCT g) FROM p) - 1")}""",
)
def wls_fe_cluster(spark, sf_dir):
    """Mean price on mean quantity by nation and year, weighted by rows, with nation effects and errors clustered both ways."""
    fit = panel.fixed_effects(_panel(spark, sf_dir), F.col("y"), {"x": F.col("x")}, ["g"], F.col("w"), ["t"])
    return _panel_errors(spark, fit)


@query(
    "panel_two_effects",
    f"""WITH RECURSIVE {_PANEL}, r AS (
      SELECT 0 AS i, g, t, w, x, y FROM p UNION ALL
      SELECT i + 1, g, t, w, x - sum(w * x) OVER h / sum(w) OVER h, y - sum(w * y) OVER h / sum(w) OVER h FROM (
        SELECT i, g, t, w, x - sum(w * x) OVER k / sum(w) OVER k AS x, y - sum(w * y) OVER k / sum(w) OVER k AS y FROM r WHERE i < 60 WINDOW k AS (PARTITION BY g)) WINDOW h AS (PARTITION BY t)),
    q AS (SELECT * FROM r WHERE i = 60), {_ERRORS.format(rest="(SELECT count(DISTINCT g) FROM p) - (SELECT count(DISTINCT t) FROM p)")}""",
)
def panel_two_effects(spark, sf_dir):
    """The same with nation and year effects, taken out by alternating means."""
    fit = panel.fixed_effects(_panel(spark, sf_dir), F.col("y"), {"x": F.col("x")}, ["g", "t"], F.col("w"))
    return _panel_errors(spark, fit)


@query("wild_cluster_test")
def wild_cluster_test(spark, sf_dir):
    """p of the slope of the panel with both effects by the wild cluster bootstrap over nations, and its interval from resampled nations."""
    moments = panel.cluster_moments(_panel(spark, sf_dir), "g", F.col("y"), {"x": F.col("x")}, ["g", "t"], F.col("w"))
    slope, draws = panel.resampled(moments, 400, seed=3)
    low, high = np.quantile(draws[:, 0], [0.025, 0.975])
    return spark.createDataFrame([(float(slope[0]), float(panel.wild_p(moments)), float(low), float(high), len(moments.clusters))], "slope double, p_wild double, low double, high double, n_clusters int")


@query("mixture_rank")
def mixture_rank(spark, sf_dir):
    """Density ranks of synthetic draws from their own mixtures, in ten bins: each holds about a tenth."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            n = len(key)
            weights = np.stack([0.2 + key % 3 * 0.1, 0.8 - key % 3 * 0.1], axis=1)
            means = np.stack([np.stack([key % 7, key % 5], axis=1), np.stack([key % 11 + 3.0, key % 13], axis=1)], axis=1).astype(float)
            sigmas = np.stack([1 + key % 2 * 0.5, 2 - key % 2 * 0.5], axis=1).astype(float)
            rng = np.random.default_rng([17, int(key[0]) if n else 0])
            z = mixture.sample(weights, means, sigmas, 1, rng)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mixture.density_rank(weights, means, sigmas, z, 128, rng))], names=["o_orderkey", "rank"])

    ranks = table(spark, sf_dir, "orders").select("o_orderkey").mapInArrow(run, "o_orderkey long, rank double")
    return ranks.groupBy(F.least(F.floor(F.col("rank") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mixture_regions",
    """WITH s AS (SELECT s_suppkey AS k FROM supplier),
    c AS (SELECT k, (3 + k % 4) / 10e0 AS w, (10 + k % 17)::DOUBLE AS x, (12 + k % 23)::DOUBLE AS y, 1 + k % 3 / 2e0 AS s FROM s UNION ALL SELECT k, (7 - k % 4) / 10e0, (14 + k % 19)::DOUBLE, (15 + k % 21)::DOUBLE, (2 + k % 2)::DOUBLE FROM s),
    h AS (SELECT k, i, j, sum(w / (2 * pi() * s * s) * exp(-((i * 0.5e0 - 4.75 - x) ** 2 + (j * 0.5e0 - 4.75 - y) ** 2) / (2 * s * s))) AS p FROM c, range(130) a(i), range(120) b(j) GROUP BY k, i, j),
    r AS (SELECT k, p, sum(p) OVER (PARTITION BY k ORDER BY p DESC, i, j ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY k) AS total FROM h),
    e AS (SELECT k, (count(*) FILTER (upto < 0.8e0 * total) + 1) * 0.25e0 AS area, min(p) FILTER (upto - p < 0.8e0 * total) AS edge FROM r GROUP BY k),
    z AS (SELECT k, sum(w / (2 * pi() * s * s) * exp(-((12 + k % 13 - x) ** 2 + (14 + k % 11 - y) ** 2) / (2 * s * s))) AS own FROM c GROUP BY k),
    n AS (SELECT k, w, x, y, arg_min(a, (ax - x) ** 2 + (ay - y) ** 2) AS a FROM c, (VALUES (0, 10, 12), (1, 20, 20), (2, 30, 30)) t(a, ax, ay) GROUP BY k, w, x, y),
    g AS (SELECT k, a, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM n GROUP BY k, a HAVING sum(w) >= 0.15),
    b AS (SELECT DISTINCT k FROM g JOIN g o USING (k) WHERE (g.x - o.x) ** 2 + (g.y - o.y) ** 2 >= 25)
    SELECT k AS s_suppkey, area, own >= edge AS inside, b.k IS NOT NULL AS two_places FROM e JOIN z USING (k) LEFT JOIN b USING (k)""",
)
def mixture_regions(spark, sf_dir):
    """Area of the densest region of mixtures, whether a point is in it, and whether a mixture is at two of three anchors at once."""
    k, number = F.col("s_suppkey"), lambda c: c.cast("double")
    rows = table(spark, sf_dir, "supplier").select(
        k,
        F.array((3 + k % 4) / F.lit(10.0), (7 - k % 4) / F.lit(10.0)).alias("weights"),
        F.array(*map(number, (10 + k % 17, 12 + k % 23, 14 + k % 19, 15 + k % 21))).alias("means"),
        F.array(1 + k % 3 / F.lit(2.0), number(2 + k % 2)).alias("sigmas"),
        F.array(number(12 + k % 13), number(14 + k % 11)).alias("z"),
    )
    anchors = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 12.0), (20.0, 20.0), (30.0, 30.0))])
    return learned.regions(rows).select("s_suppkey", "area", "inside", learned.two_places(F.col("weights"), F.col("means"), anchors).alias("two_places"))


@query("hierarchical_shrinkage")
def hierarchical_shrinkage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    cells = sorted((r["c_nationkey"], r["n"], r["mean"], r["se"]) for r in inference.cell_errors(orders, ["c_nationkey"], "o_custkey", "o_totalprice").collect())  # a row for each nation
    fit = inference.gibbs_shrinkage(np.array([c[2] for c in cells]), np.array([c[3] for c in cells]), draws=500, burn_in=100, seed=5)
    return spark.createDataFrame([(int(c[0]), int(c[1]), float(c[2]), float(c[3]), float(m), float(s)) for c, m, s in zip(cells, fit["theta"], fit["sd"], strict=True)], "nation int, n long, mean double, se double, shrunk double, sd double")


@query(
    "overlap_effect",
    """WITH r AS (SELECT (l_returnflag = 'R')::INT AS t, 1 / (1 + exp(-(l_quantity - 25) / 20)) AS p, l_extendedprice AS y FROM lineitem), w AS (SELECT t * (1 - p) AS w1, (1 - t) * p AS w0, y FROM r)
    SELECT round(sum(w1 * y) / sum(w1) - sum(w0 * y) / sum(w0), 4) AS effect, round(sum(w1) ** 2 / sum(w1 * w1), 4) AS n_treated, round(sum(w0) ** 2 / sum(w0 * w0), 4) AS n_control FROM w""",
)
def overlap_effect(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = 1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 20))
    out = inference.overlap_effect(li, F.col("l_returnflag") == "R", p, F.col("l_extendedprice"))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


_TREATED = "(l_returnflag = 'R')::INT AS t, 1 / (1 + exp(-(l_quantity - 25) / 20)) AS e"


@query(
    "balance_table",
    f"""WITH r AS (SELECT {_TREATED}, l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem), x AS (SELECT t, e, unnest(['quantity', 'price', 'discount']) AS covariate, unnest([a, b, c]) AS x FROM r),
    m AS (SELECT covariate, avg(x) FILTER (t = 1) AS p1, avg(x) FILTER (t = 0) AS p0, sqrt((var_pop(x) FILTER (t = 1) + var_pop(x) FILTER (t = 0)) / 2) + 1e-9 AS s,
      sum((1 - e) * t * x) / sum((1 - e) * t) AS w1, sum(e * (1 - t) * x) / sum(e * (1 - t)) AS w0 FROM x GROUP BY covariate)
    SELECT covariate, round((p1 - p0) / s, 5) AS before, round((w1 - w0) / s, 5) AS after FROM m""",
)
def balance_table(spark, sf_dir):
    """Standardised differences of returned lines, before and after overlap weights of a given propensity."""
    p = 1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 20))
    covariates = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount")}
    out = effects.balance(table(spark, sf_dir, "lineitem"), (F.col("l_returnflag") == "R").cast("int"), p, covariates)
    return out.select("covariate", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"))


@query("doubly_robust_effect")
def doubly_robust_effect(spark, sf_dir):
    """Difference in discount that goes with returned lines, at equal quantity, price and supplier's nation; three folds and clusters by order."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    made = effects.design(lines, {"quantity": F.col("l_quantity"), "price": F.ln("l_extendedprice"), "tax": F.col("l_tax")}, ["s_nationkey"])
    fitted = effects.cross_fitted(made.rows, "returned", "l_discount", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)), 3)
    return effects.effect(fitted, "returned", "l_discount", "l_orderkey")


@query(
    "e_values",
    """WITH c AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05)::DOUBLE / count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.05)::DOUBLE / count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY ALL),
    r AS (SELECT l_linestatus, a / b AS rr, CASE WHEN a / b < 1 THEN b / a ELSE a / b END AS m FROM c) SELECT l_linestatus, round(rr, 6) AS risk_ratio, round(m + sqrt(m * (m - 1)), 6) AS e_value FROM r""",
)
def e_values(spark, sf_dir):
    hit, treated = (F.col("l_discount") > 0.05).cast("double"), F.col("l_returnflag") == "R"
    rates = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg((F.avg(F.when(treated, hit)) / F.avg(F.when(~treated, hit))).alias("rr"))
    return rates.select("l_linestatus", r6("rr").alias("risk_ratio"), r6(inference.e_value(F.col("rr"))).alias("e_value"))


@query(
    "clustered_cell_errors",
    """WITH o AS (SELECT c_nationkey, o_custkey, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT c_nationkey, o_custkey, count(*) AS m, sum(v) AS s FROM o GROUP BY ALL),
    t AS (SELECT c_nationkey, sum(m) AS n, sum(s) / sum(m) AS mean, count(*) AS k FROM g GROUP BY ALL), e AS (SELECT g.c_nationkey, any_value(n) AS n, any_value(mean) AS mean, sqrt(any_value(k)::DOUBLE / (any_value(k) - 1) * sum((s - mean * m) ** 2)) / any_value(n) AS se FROM g JOIN t USING (c_nationkey) GROUP BY ALL)
    SELECT c_nationkey, n::BIGINT AS n, round(mean, 3) AS mean, round(greatest(se, (SELECT stddev_samp(v) FROM o) / sqrt(n)), 3) AS se FROM e""",
)
def clustered_cell_errors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return inference.cell_errors(orders, ["c_nationkey"], "o_custkey", "o_totalprice").select("c_nationkey", "n", F.round("mean", 3).alias("mean"), F.round("se", 3).alias("se"))


@query(
    "resample_grid",
    f"""WITH {EVENTS}, s AS (SELECT user_id, t_ms, avg(value) AS v FROM e GROUP BY ALL), b AS (SELECT user_id, min(t_ms) AS t0, max(t_ms) AS t1 FROM s GROUP BY user_id),
    g AS (SELECT user_id, k, t0 + k * 86400000 <= t1 AS valid, least(t0 + k * 86400000, t1) AS t FROM (SELECT *, unnest(range(0, 31)) AS k FROM b)),
    a AS (SELECT g.*, s.t_ms AS ta, s.v AS va FROM g ASOF JOIN s ON g.user_id = s.user_id AND g.t >= s.t_ms), z AS (SELECT a.*, s.t_ms AS tb, s.v AS vb FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t < s.t_ms)
    SELECT user_id, k::INT AS k, t, valid, round(CASE WHEN tb IS NULL OR ta = t THEN va ELSE va + (t - ta)::DOUBLE / (tb - ta) * (vb - va) END, 6) AS value FROM z""",
)
def resample_grid(spark, sf_dir):
    points = event_stream(spark, sf_dir).groupBy("user_id", F.col("t_ms").alias("t")).agg(F.avg("value").alias("value"))
    spans = points.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return tracking.resample(points, ["user_id"], spans, 86_400_000, 30, ["value"]).select("user_id", F.col("grid_step").alias("k"), "t", "valid", r6("value").alias("value"))


@query(
    "attack_direction",
    """WITH s AS (SELECT o_orderkey // 40 AS game, o_orderkey % 2 AS team, 1 + o_orderkey % 4 AS period, (o_orderkey * 37 % 9400) / 100e0 AS x FROM orders),
    v AS (SELECT game, team, sum((CASE WHEN x < 47 THEN 1 ELSE -1 END) * (CASE WHEN period <= 2 THEN 1 ELSE -1 END)) AS score FROM s GROUP BY ALL),
    c AS (SELECT game, team, count(*) OVER w AS nt, 2 * score - sum(score) OVER w AS comb, team = min(team) OVER w AS first FROM v WINDOW w AS (PARTITION BY game)),
    p AS (SELECT DISTINCT game, period FROM s), r AS (SELECT game, team, period, count(*) AS n FROM s GROUP BY ALL)
    SELECT c.game::VARCHAR AS game_id, c.team::BIGINT AS team_id, p.period::INT AS period, CASE WHEN p.period <= 2 THEN (CASE WHEN comb = 0 THEN NOT first ELSE comb > 0 END) ELSE NOT (CASE WHEN comb = 0 THEN NOT first ELSE comb > 0 END) END AS attacks_left, coalesce(r.n, 0)::BIGINT AS n_shots
    FROM c JOIN p ON c.game = p.game LEFT JOIN r ON r.game = c.game AND r.team = c.team AND r.period = p.period WHERE nt = 2""",
)
def attack_direction(spark, sf_dir):
    k = F.col("o_orderkey")
    shots = table(spark, sf_dir, "orders").select(F.floor(k / 40).cast("string").alias("game_id"), (k % 2).alias("team_id"), (1 + k % 4).cast("int").alias("period"), ((k * 37 % 9400).cast("double") / F.lit(100.0)).alias("x"))
    return tracking.attack_direction(shots).select("game_id", "team_id", "period", "attacks_left", "n_shots")
