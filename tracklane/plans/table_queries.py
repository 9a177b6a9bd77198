"""Set operations, joins, scalar functions and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalars
from tracklane.operators import screens, stats
from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.fixtures import event_stream, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

HOUR = 3_600_000


def r6(column):
    return F.round(column, 6)


@query(
    "diagonal_union",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier",
)
def diagonal_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "home_away_double",
    "SELECT l_orderkey AS game, l_partkey AS team, l_suppkey AS opponent, true AS home FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_partkey, false FROM lineitem",
)
def home_away_double(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), "l_partkey", "l_suppkey")
    sides = F.array(
        F.struct(F.col("l_partkey").alias("team"), F.col("l_suppkey").alias("opponent"), F.lit(True).alias("home")),
        F.struct(F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("opponent"), F.lit(False).alias("home")),
    )
    return li.select("game", F.explode(sides).alias("s")).select("game", "s.*")


@query("semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_filter(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(poor, "o_custkey", "left_semi")


@query("anti_filter", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_filter(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(large, "c_custkey", "left_anti")


@query(
    "full_outer_coalesce",
    """WITH a AS (SELECT l_suppkey % 70 AS k, count(*) AS n_a FROM lineitem GROUP BY ALL), b AS (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_suppkey > 30)
    SELECT coalesce(a.k, b.k) AS k, n_a::BIGINT AS n_a, s_acctbal FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_coalesce(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 70).alias("k")).agg(F.count(F.lit(1)).alias("n_a"))
    b = table(spark, sf_dir, "supplier").where("s_suppkey > 30").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return a.join(b, "k", "full")


@query(
    "left_join_first",
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey)
    SELECT c_custkey, first_order, n_name FROM customer LEFT JOIN f ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def left_join_first(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(first, "c_custkey", "left").join(nations, "c_nationkey").select("c_custkey", "first_order", "n_name")


@query(
    "intersect_except",
    """SELECT 'both' AS kind, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
    UNION ALL SELECT 'only_r', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def intersect_except(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    both, only = keys("R").intersect(keys("A")), keys("R").subtract(keys("A"))
    return both.select(F.lit("both").alias("kind"), "k").union(only.select(F.lit("only_r").alias("kind"), "k"))


@query("frame_equality", "SELECT true AS equal, (SELECT count(*) FROM lineitem)::BIGINT AS n")
def frame_equality(spark, sf_dir):
    from tracklane.operators.checks import frames_equal

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return frames_equal(li, li.where("l_quantity > 20").unionByName(li.where("not l_quantity > 20")))


@query(
    "topk_per_criterion",
    """(SELECT 'price' AS criterion, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 10)
    UNION ALL (SELECT 'size', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey) AS rank FROM part QUALIFY rank <= 10)""",
)
def topk_per_criterion(spark, sf_dir):
    part = table(spark, sf_dir, "part")

    def top(name, *order):
        best = part.orderBy(*order).limit(10)  # the feature is the ten best
        return best.select(F.lit(name).alias("criterion"), "p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))

    return top("price", F.desc("p_retailprice"), "p_partkey").unionByName(top("size", F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_partkey")))


@query(
    "seeded_sample",
    "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 50",
)
def seeded_sample(spark, sf_dir):
    order = Window.partitionBy("o_orderstatus").orderBy(scalars.hash_rank(F.col("o_orderkey"), seed=7), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(order)).where("k <= 50").select("o_orderkey", "o_orderstatus")  # a sample is the feature


@query(
    "csv_clock_parse",
    """WITH t AS (SELECT o_orderkey, (o_orderkey % 13)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS txt FROM orders UNION ALL SELECT -o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'x:10' WHEN 1 THEN '12' ELSE NULL END FROM orders)
    SELECT o_orderkey, CASE WHEN len(string_split(txt, ':')) = 2 THEN TRY_CAST(string_split(txt, ':')[1] AS INT) * 60 + TRY_CAST(string_split(txt, ':')[2] AS INT) END AS seconds,
           CASE WHEN length(o_orderkey::VARCHAR) >= 10 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 10, '0') END AS padded FROM t""",
)
def csv_clock_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    good = orders.select("o_orderkey", F.concat((k % 13).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("txt"))
    bad = orders.select((-k).alias("o_orderkey"), F.when(k % 3 == 0, "x:10").when(k % 3 == 1, "12").alias("txt"))
    return good.unionByName(bad).select("o_orderkey", scalars.clock_seconds(F.col("txt")).alias("seconds"), scalars.padded_id(k).alias("padded"))


@query(
    "score_split",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TIE' ELSE (o_orderkey % 99)::VARCHAR || ' - ' || (o_orderkey % 97)::VARCHAR END AS s FROM orders)
    SELECT o_orderkey, TRY_CAST(string_split(s, ' - ')[1] AS INT) AS visitor, TRY_CAST(string_split(s, ' - ')[2] AS INT) AS home, CASE WHEN s = 'TIE' THEN 0 ELSE TRY_CAST(s AS INT) END AS margin FROM t""",
)
def score_split(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, None).when(k % 5 == 1, "TIE").otherwise(F.concat((k % 99).cast("string"), F.lit(" - "), (k % 97).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("s"))
    visitor, home = scalars.score_parts(F.col("s"))
    return rows.select("o_orderkey", visitor.alias("visitor"), home.alias("home"), scalars.margin(F.col("s")).alias("margin"))


@query(
    "props_json",
    "SELECT event_id, json_extract_string(props, '$.page') AS page, length(props)::BIGINT AS n FROM events",
)
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("long").alias("n"))


@query(
    "garbage_time_share",
    """WITH g AS (SELECT o_orderkey % 30 AS team, 1 + o_orderkey % 4 AS period, o_orderkey * 7 % 720 AS clock, o_orderkey * 11 % 61 - 30 AS lead FROM orders)
    SELECT team, count(*)::BIGINT AS n, count(*) FILTER (period = 4 AND ((clock > 540 AND abs(lead) >= 25) OR (clock > 360 AND clock <= 540 AND abs(lead) >= 20) OR (clock <= 360 AND abs(lead) >= 10)))::BIGINT AS n_garbage,
           count(*) FILTER (period = 4 AND clock <= 300 AND abs(lead) <= 5)::BIGINT AS n_clutch FROM g GROUP BY team""",
)
def garbage_time_share(spark, sf_dir):
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select((k % 30).alias("team"), (1 + k % 4).alias("period"), (k * 7 % 720).alias("clock"), (k * 11 % 61 - 30).alias("lead"))
    clutch = (F.col("period") == 4) & (F.col("clock") <= 300) & (F.abs("lead") <= 5)
    return g.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count_if(scalars.garbage_time(F.col("period"), F.col("clock"), F.col("lead"))).alias("n_garbage"), F.count_if(clutch).alias("n_clutch"))


@query(
    "explode_opportunities",
    """WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS ids FROM lineitem GROUP BY l_orderkey)
    SELECT u AS supplier, count(*)::BIGINT AS n, sum(len(ids))::BIGINT AS n_on, sum((ids[1] = u)::INT)::BIGINT AS n_first FROM (SELECT ids, unnest(ids) AS u FROM a) GROUP BY u""",
)
def explode_opportunities(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"))  # a few lines in an order
    each = lists.select("ids", F.explode("ids").alias("supplier"))
    return each.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).cast("long").alias("n_on"), F.count_if(F.get("ids", F.lit(0)) == F.col("supplier")).alias("n_first"))


@query(
    "possession_estimate",
    """SELECT l_orderkey AS game, (sum(l_quantity) - 2 * count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_returnflag = 'A') + 0.44::DOUBLE * sum(l_linenumber))::DOUBLE AS possessions FROM lineitem GROUP BY ALL""",
)
def possession_estimate(spark, sf_dir):
    flag = F.col("l_returnflag")
    estimate = F.sum("l_quantity") - 2 * F.count_if(flag == "R") + F.count_if(flag == "A") + 0.44 * F.sum("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(estimate.alias("possessions"))


@query(
    "event_codes",
    f"WITH {EVENTS} SELECT user_id, t_ms // {24 * HOUR} AS day, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 8 END)::BIGINT AS code, count(*)::BIGINT AS n FROM e GROUP BY ALL",
)
def event_codes(spark, sf_dir):
    kind = F.col("event_type")
    bit = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 4).otherwise(8).cast("long")
    return event_stream(spark, sf_dir).groupBy("user_id", F.floor(F.col("t_ms") / (24 * HOUR)).alias("day")).agg(F.bit_or(bit).alias("code"), F.count(F.lit(1)).alias("n"))


@query(
    "rater_agreement",
    """WITH p AS (SELECT o_orderkey % 4 AS a, (o_orderkey % 4 + (o_orderkey % 7 = 0)::INT) % 4 AS b, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS n FROM p),
    m AS (SELECT k, sum(n) FILTER (a = k) AS na, sum(n) FILTER (b = k) AS nb FROM p, range(4) r(k) GROUP BY k)
    SELECT any_value(t.n)::BIGINT AS n, round((sum(p.n) FILTER (a = b))::DOUBLE / any_value(t.n), 6) AS agreement,
      round(((sum(p.n) FILTER (a = b))::DOUBLE / any_value(t.n) - (SELECT sum(na::DOUBLE * nb) / (SELECT n::DOUBLE * n FROM t) FROM m)) / (1 - (SELECT sum(na::DOUBLE * nb) / (SELECT n::DOUBLE * n FROM t) FROM m)), 6) AS kappa FROM p, t""",
)
def rater_agreement(spark, sf_dir):
    from tracklane.operators.checks import cohen_kappa

    k = F.col("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select((k % 4).alias("a"), ((k % 4 + (k % 7 == 0).cast("int")) % 4).alias("b"))
    return cohen_kappa(pairs, "a", "b").select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query(
    "headline_compare",
    """WITH a AS (SELECT l_suppkey, avg(l_extendedprice) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), b AS (SELECT l_suppkey, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL)
    SELECT count(*)::BIGINT AS n, round(corr(a.x, b.x), 6) AS r, round(max(abs(a.x - b.x)), 4) AS max_change FROM a JOIN b USING (l_suppkey)""",
)
def headline_compare(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    both = li.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_linenumber") <= 3, F.col("l_extendedprice"))).alias("a"), F.avg("l_extendedprice").alias("b")).where("a is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), r6(stats.correlation("a", "b")).alias("r"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 4).alias("max_change"))


@query(
    "duplicate_report",
    """WITH k AS (SELECT l_orderkey, l_suppkey, count(*) AS n, count(DISTINCT l_quantity) AS v FROM lineitem GROUP BY ALL)
    SELECT sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_keys, count(*) FILTER (n > 1)::BIGINT AS n_repeated, count(*) FILTER (v > 1)::BIGINT AS n_conflicting, max(n)::BIGINT AS most FROM k""",
)
def duplicate_report(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("low") != F.col("high")).alias("n_conflicting"), F.max("n").alias("most"))


@query(
    "argmin_first_index",
    """SELECT l_orderkey, arg_min(l_linenumber, l_discount * 1000 + l_linenumber / 100.0)::BIGINT AS first_min, arg_max(l_linenumber, l_discount * 1000 - l_linenumber / 100.0)::BIGINT AS first_max FROM lineitem GROUP BY ALL""",
)
def argmin_first_index(spark, sf_dir):
    n = F.col("l_linenumber")
    low = F.min(F.struct("l_discount", n.alias("i")))
    high = F.min(F.struct((-F.col("l_discount")).alias("d"), n.alias("i")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(low.alias("low"), high.alias("high")).select("l_orderkey", F.col("low.i").cast("long").alias("first_min"), F.col("high.i").cast("long").alias("first_max"))


@query(
    "screen_groups",
    f"""WITH {EVENTS}, s AS (SELECT *, t_ms - lag(t_ms) OVER w > {2 * HOUR} AS apart FROM e WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)),
    g AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS grp FROM s)
    SELECT user_id, grp::BIGINT AS screen_group, min(t_ms) AS t_first, count(*)::BIGINT AS n, bool_or(event_type = 'error') AS any_error, arg_min(event_type, t_ms * 100000 + event_id) AS first_type FROM g GROUP BY ALL""",
)
def screen_groups(spark, sf_dir):
    e = event_stream(spark, sf_dir).where(F.col("event_type").isin("click", "error"))
    groups = screens.group_screens(e, ["user_id"], "t_ms", "event_id", 2 * HOUR)
    first = F.min(F.struct("t_ms", "event_id", "event_type")).getField("event_type")
    return groups.groupBy("user_id", "screen_group").agg(F.min("t_ms").alias("t_first"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("any_error"), first.alias("first_type"))


@query(
    "phase_labels",
    f"""WITH {EVENTS}, v AS (SELECT * FROM e WHERE event_type = 'view'),
    f AS (SELECT v.event_id, any_value(v.user_id) AS user_id, bool_or(o.event_type = 'error' AND v.t_ms BETWEEN o.t_ms AND o.t_ms + {HOUR}) AS h, bool_or(o.event_type = 'signup' AND v.t_ms BETWEEN o.t_ms AND o.t_ms + {HOUR}) AS c,
      bool_or(o.event_type IN ('error', 'signup') AND v.t_ms > o.t_ms + {HOUR} AND v.t_ms <= o.t_ms + {3 * HOUR}) AS r, bool_or(o.event_type = 'click' AND v.t_ms >= o.t_ms - {HOUR // 2} AND v.t_ms <= o.t_ms + {HOUR}) AS s
      FROM v LEFT JOIN e o ON o.user_id = v.user_id AND o.event_type <> 'view' AND o.t_ms BETWEEN v.t_ms - {3 * HOUR} AND v.t_ms + {HOUR // 2} GROUP BY v.event_id)
    SELECT event_id, user_id, CASE WHEN h THEN 'help' WHEN c THEN 'closeout' WHEN r THEN 'recovery' WHEN s THEN 'screen' ELSE 'other' END AS phase FROM f""",
)
def phase_labels(spark, sf_dir):
    from tracklane.operators.interval import band_pairs

    e = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "t_ms")
    views = e.where(F.col("event_type") == "view").select("event_id", "user_id", F.col("t_ms").alias("t"))
    others = e.where(F.col("event_type") != "view").select("user_id", F.col("event_type").alias("kind"), F.col("t_ms").alias("r_t"))
    t, o, kind = F.col("t"), F.col("r_t"), F.col("kind")
    near = band_pairs(views, others, ["user_id"], 3 * HOUR)
    flags = near.groupBy("event_id").agg(
        F.bool_or((kind == "error") & t.between(o, o + HOUR)).alias("h"),
        F.bool_or((kind == "signup") & t.between(o, o + HOUR)).alias("c"),
        F.bool_or(kind.isin("error", "signup") & (t > o + HOUR) & (t <= o + 3 * HOUR)).alias("r"),
        F.bool_or((kind == "click") & (t >= o - HOUR // 2) & (t <= o + HOUR)).alias("s"),
    )
    label = screens.phase(F.col("h"), F.col("c"), F.col("r"), F.col("s"), F.lit(False))
    return views.join(flags, "event_id", "left").select("event_id", "user_id", label.alias("phase"))


@query(
    "touch_state",
    f"""WITH {EVENTS}, s AS (SELECT * FROM e WHERE event_type = 'purchase'), t AS (SELECT event_id AS touch, user_id, t_ms AS t0, t_ms + {4 * HOUR} AS t1 FROM e WHERE event_type = 'view'), d AS (SELECT * FROM e WHERE event_type = 'click'),
    l AS (SELECT s.event_id, arg_max({{'touch': touch, 't0': t0}}, t0 * 100000 + touch) AS b FROM s JOIN t ON s.user_id = t.user_id AND t0 <= s.t_ms AND t0 >= s.t_ms - {12 * HOUR} AND t1 >= s.t_ms - {HOUR} GROUP BY s.event_id),
    n AS (SELECT s.event_id, count(d.event_id) AS n FROM s JOIN l ON s.event_id = l.event_id LEFT JOIN d ON d.user_id = s.user_id AND d.t_ms >= b.t0 AND d.t_ms <= s.t_ms GROUP BY s.event_id)
    SELECT s.event_id, s.user_id, b.touch AS touch_id, n.n::BIGINT AS n_dribbles, round((s.t_ms - b.t0) / 1000e0, 3) AS touch_s FROM s LEFT JOIN l ON l.event_id = s.event_id LEFT JOIN n ON n.event_id = s.event_id""",
)
def touch_state(spark, sf_dir):
    from tracklane.operators.shots import touch_state as state

    e = event_stream(spark, sf_dir)
    of = lambda kind, i, t: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(i), F.col("user_id").alias("actor"), F.col("t_ms").alias(t))
    touches = of("view", "touch_id", "t_start").withColumn("t_end", F.col("t_start") + 4 * HOUR)
    out = state(of("purchase", "shot_id", "t"), touches, of("click", "dribble_id", "t_dribble"), lookback=12 * HOUR, slack=HOUR)
    return out.select(F.col("shot_id").alias("event_id"), F.col("actor").alias("user_id"), "touch_id", "n_dribbles", F.round("touch_s", 3).alias("touch_s"))
