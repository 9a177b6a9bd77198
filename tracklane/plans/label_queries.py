"""Labels, samples, table summaries, and estimates with their bounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalars
from tracklane.operators import inference, labels, regression, stats
from tracklane.operators.interval import first_after_anchor_excluding
from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.fixtures import event_stream, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

DAY = 86_400_000


def r6(column):
    return F.round(column, 6)


_L = f"""{EVENTS}, l AS (SELECT user_id % 40 AS item, user_id % 3 AS lane, t_ms, event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS label FROM e),
    w AS (SELECT item, lane, arg_max(struct_pack(v := label), (t_ms - 1600000000000) * 10000000 + event_id).v AS label FROM l GROUP BY ALL)"""


def _lanes(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    raw = e.select((F.col("user_id") % 40).alias("item"), (F.col("user_id") % 3).alias("lane"), "t_ms", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("label"))
    return labels.last_written(raw, ["item"], "lane", ["t_ms", "event_id"], "label")


@query("label_lanes", f"WITH {_L} SELECT item, lane, label FROM w WHERE label IS NOT NULL")
def label_lanes(spark, sf_dir):
    """The label that each lane wrote last on an item; a null label withdraws."""
    return _lanes(spark, sf_dir)


@query(
    "label_consensus",
    f"""WITH {_L}, c AS (SELECT item, label, count(*) AS n FROM w WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT item, max(n) AS top FROM c GROUP BY item), u AS (SELECT c.item, label, n FROM c JOIN t ON c.item = t.item AND n = top),
    o AS (SELECT item FROM u GROUP BY item HAVING count(*) = 1) SELECT u.item, label, n::BIGINT AS votes FROM u JOIN o USING (item) WHERE n >= 2""",
)
def label_consensus(spark, sf_dir):
    return labels.consensus(_lanes(spark, sf_dir), ["item"], "label")


@query("label_disagreements", f"WITH {_L} SELECT a.item, a.lane AS lane_a, a.label AS label_a, b.lane AS lane_b, b.label AS label_b FROM w a JOIN w b ON a.item = b.item AND a.lane < b.lane AND a.label <> b.label")
def label_disagreements(spark, sf_dir):
    return labels.disagreements(_lanes(spark, sf_dir), ["item"], "lane", "label")


@query(
    "blind_against_assisted",
    """WITH r AS (SELECT o_orderkey % 4 AS b, CASE WHEN o_orderkey % 5 < 3 THEN (o_orderkey * 7) % 4 ELSE o_orderkey % 4 END AS a, (o_orderkey * 7) % 4 AS m FROM orders)
    SELECT count(*)::BIGINT AS n, round(avg((m = b)::INT), 6) AS against_blind, round(avg((m = a)::INT), 6) AS against_assisted, round(avg((a = b)::INT), 6) AS agreement, round(avg((m = a)::INT) - avg((m = b)::INT), 6) AS anchoring_gap FROM r""",
)
def blind_against_assisted(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    of = lambda c: o.select(k.alias("item"), c.alias("label"))
    out = labels.blind_against_assisted(of(k % 4), of(F.when(k % 5 < 3, k * 7 % 4).otherwise(k % 4)), of(k * 7 % 4), ["item"], "label")
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query(
    "weighted_label_accuracy",
    """WITH s AS (SELECT o_orderpriority AS s, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS a FROM orders GROUP BY ALL)
    SELECT sum(n)::BIGINT AS n, round(sum(a * n) / sum(n), 6) AS accuracy, round(sum(a * length(s)) / sum(length(s)), 6) AS weighted FROM s""",
)
def weighted_label_accuracy(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    weights = orders.select("o_orderpriority").distinct().withColumn("weight", F.length("o_orderpriority").cast("double"))
    out = labels.weighted_accuracy(orders, F.col("o_orderstatus") == "F", "o_orderpriority", weights)
    return out.select("n", r6("accuracy").alias("accuracy"), r6("weighted").alias("weighted"))


@query(
    "label_segments",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))
    SELECT l_orderkey, l_returnflag, min(l_linenumber)::BIGINT AS first, max(l_linenumber)::BIGINT AS last FROM s GROUP BY l_orderkey, l_returnflag, run""",
)
def label_segments(spark, sf_dir):
    out = labels.segments(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct(), ["l_orderkey"], "l_linenumber", "l_returnflag")
    return out.select("l_orderkey", "l_returnflag", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(
    "clip_windows",
    """WITH c AS (SELECT o_orderkey, least(greatest(floor((o_orderkey * 37 % 30000 - 2000) / 200e0), 0), 120)::BIGINT AS step FROM orders)
    SELECT o_orderkey, step, greatest(step - 10, 0)::BIGINT AS first, least(step + 15, 120)::BIGINT AS last, substr(sha1('clip|' || o_orderkey || '|' || step), 1, 10) AS item FROM c""",
)
def clip_windows(spark, sf_dir):
    k = F.col("o_orderkey")
    c = labels.clip(k * 37 % 30000, F.lit(2000), 200, 121, 10, 15)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")
    return rows.withColumn("item", labels.item_id(F.lit("clip"), k, F.col("step")))


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c})::BIGINT AS n, (count(*) - count({c}))::BIGINT AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c})::DOUBLE, 4) AS low, round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS q50, round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q75, round(max({c})::DOUBLE, 4) AS high FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def describe_numeric(spark, sf_dir):
    out = stats.described(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("name", "n", "nulls", *[F.round(c, 4).alias(c) for c in out.columns[3:]])


@query(
    "place_percentile",
    "SELECT c_custkey, round(100.0 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / nullif(count(*) OVER (PARTITION BY c_nationkey) - 1, 0), 6)::DOUBLE AS pct FROM customer",
)
def place_percentile(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(stats.place_percentile(["c_nationkey"], "c_acctbal", ["c_custkey"])).alias("pct"))


@query(
    "capped_strata",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, md5('5:' || o_orderkey) AS h FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) AS k FROM r),
    s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS i FROM c WHERE k <= 2)
    SELECT o_orderkey, o_orderpriority, CASE WHEN i <= 20 THEN 'first' ELSE 'second' END AS part FROM s WHERE i <= 50""",
)
def capped_strata(spark, sf_dir):
    """At most two rows of a customer; of each priority 20 rows and 30 others, in a seeded order."""
    h = scalars.hash_rank(F.col("o_orderkey"), seed=5)
    capped = table(spark, sf_dir, "orders").withColumn("h", h).withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("h", "o_orderkey"))).where("k <= 2")
    placed = capped.withColumn("i", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("h", "o_orderkey"))).where("i <= 50")  # a sample is the feature
    return placed.select("o_orderkey", "o_orderpriority", F.when(F.col("i") <= 20, "first").otherwise("second").alias("part"))


@query("replace_with_default", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE 'later' END AS due FROM orders")
def replace_with_default(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "now", "2-HIGH", "soon")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("later")).alias("due"))


@query("row_index", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place FROM orders")
def row_index(spark, sf_dir):
    return stats.row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "place")


@query("distinct_structs", "SELECT l_suppkey, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber))::BIGINT AS n FROM lineitem GROUP BY l_suppkey")
def distinct_structs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.struct("l_returnflag", "l_linestatus", "l_linenumber")).alias("n"))


@query("sum_all_numeric", "SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def sum_all_numeric(spark, sf_dir):
    """The sum of every floating-point column of a table, whatever their names."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(*[F.round(F.sum(c), 2).alias(c) for c, kind in li.dtypes if kind == "double" or kind.startswith("decimal")])


@query(
    "nulls_last_topk",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v, o_orderpriority FROM orders)
    SELECT o_orderkey, k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, v DESC NULLS LAST, o_orderkey)::BIGINT AS k FROM r) WHERE k <= 200""",
)
def nulls_last_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"))
    order = [F.desc("o_orderpriority"), F.desc_nulls_last("v"), F.asc("o_orderkey")]
    return rows.orderBy(*order).limit(200).select("o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("k"))


@query(
    "fill_with_mean",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS v FROM orders)
    SELECT o_orderkey, round(coalesce(v, avg(v) OVER (PARTITION BY o_orderstatus)), 3) AS v FROM r""",
)
def fill_with_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("v"))
    means = rows.groupBy("o_orderstatus").agg(F.avg("v").alias("mean"))
    return rows.join(means, "o_orderstatus", "left").select("o_orderkey", F.round(F.coalesce("v", "mean"), 3).alias("v"))


@query(
    "first_response_excluding",
    f"""WITH {EVENTS}, a AS (SELECT event_id, user_id // 5 AS team, user_id AS x, user_id + 1 AS y, t_ms FROM e WHERE event_type = 'view'), r AS (SELECT event_id, user_id // 5 AS team, user_id AS who, t_ms FROM e WHERE event_type = 'click'),
    h AS (SELECT a.event_id, r.who, r.event_id AS rid, r.t_ms - a.t_ms AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY r.t_ms - a.t_ms, r.event_id) AS k FROM a JOIN r ON r.team = a.team AND r.t_ms BETWEEN a.t_ms AND a.t_ms + {DAY // 2} AND r.who <> a.x AND r.who <> a.y)
    SELECT a.event_id AS anchor_id, h.rid AS response_id, h.who AS actor, h.d::BIGINT AS delay_ms FROM a LEFT JOIN h ON h.event_id = a.event_id AND h.k = 1""",
)
def first_response_excluding(spark, sf_dir):
    """The first response of the same group of users by neither of two given ones."""
    e = event_stream(spark, sf_dir)
    team = F.floor(F.col("user_id") / 5)
    anchors = e.where("event_type = 'view'").select(F.col("event_id").alias("anchor_id"), team.alias("key"), "t_ms", F.array(F.col("user_id"), F.col("user_id") + 1).alias("without"))
    responses = e.where("event_type = 'click'").select(F.col("event_id").alias("response_id"), team.alias("key"), "t_ms", F.col("user_id").alias("actor"))
    return first_after_anchor_excluding(anchors, responses, DAY // 2).select("anchor_id", "response_id", "actor", "delay_ms")


_OLS = """WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem), t AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM s)"""


@query(
    "omitted_variable_bounds",
    f"""{_OLS}, g AS (SELECT a.x / 10e0 AS a, b.x / 10e0 AS b FROM range(1, 4) a(x), range(1, 4) b(x))
    SELECT a AS share_treatment, b AS share_outcome, round(sign(b0) * (abs(b0) - abs(b0) / t * sqrt(n - 2) * sqrt(b * a / (1 - a))), 3) AS adjusted FROM (SELECT *, t.b AS b0 FROM t) q, g""".replace("SELECT *, t.b AS b0 FROM t", "SELECT n, t, b AS b0 FROM t"),
)
def omitted_variable_bounds(spark, sf_dir):
    fit = regression.ols(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), {"q": F.col("l_quantity")})
    rows = inference.bias_contour(float(fit.beta[1]), float(fit.se[1]), fit.n - 2, [0.1, 0.2, 0.3])
    return spark.createDataFrame([(a, b, round(v, 3)) for a, b, v in rows], "share_treatment double, share_outcome double, adjusted double")


@query("ols_fit", f"{_OLS} SELECT n::BIGINT AS n, round(b, 4) AS slope, round(r2, 8) AS r2, round(abs(b) / t, 6) AS se FROM t")
def ols_fit(spark, sf_dir):
    fit = regression.ols(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), {"q": F.col("l_quantity")})
    return spark.createDataFrame([(fit.n, round(float(fit.beta[1]), 4), round(float(fit.r2), 8), round(float(fit.se[1]), 6))], "n long, slope double, r2 double, se double")


@query("calibration_slope")
def calibration_slope(spark, sf_dir):
    """Intercept and slope of outcomes on the logit of a made-up chance."""
    li = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 1000 < 200 + 10 * F.col("l_quantity")).cast("int").alias("y"), ((200 + 10 * F.col("l_quantity")) / 1000).alias("p"))
    return regression.calibration_slope(li, F.col("y"), F.col("p")).as_frame(spark)


@query("game_bootstrap")
def game_bootstrap(spark, sf_dir):
    """Price on quantity and discount with nations resampled whole: coefficients and 95 % limits."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey")
    moments = regression.moments_by_cluster(rows, "s_nationkey", F.col("l_extendedprice"), {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")})
    import numpy as np

    beta, draws = regression.game_bootstrap(moments.orderBy("s_nationkey"), 500, 3)
    low, high = np.quantile(draws, [0.025, 0.975], axis=0)
    return spark.createDataFrame([(n, float(b), float(a), float(c)) for n, b, a, c in zip(("intercept", "quantity", "discount"), beta, low, high, strict=True)], "name string, value double, low double, high double")


@query(
    "examples_by_class",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders), h AS (SELECT o_orderkey, o_orderpriority, md5('9:' || o_orderkey) AS h FROM orders, q WHERE o_totalprice BETWEEN lo AND hi)
    SELECT o_orderpriority, arg_min(o_orderkey, h) AS o_orderkey FROM h GROUP BY ALL""",
)
def examples_by_class(spark, sf_dir):
    """One example of each class, at random among those between the quartiles."""
    orders = table(spark, sf_dir, "orders")
    low, high = stats.linear_quantiles(orders, "o_totalprice", (0.25, 0.75))
    return orders.where(F.col("o_totalprice").between(low, high)).groupBy("o_orderpriority").agg(F.min_by("o_orderkey", scalars.hash_rank(F.col("o_orderkey"), seed=9)).alias("o_orderkey"))
