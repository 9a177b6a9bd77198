"""Rates, thresholds and profiles by unit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import court
from tracklane.operators import gamesets, interval, islands, matchup, screens, stats
from tracklane.plans.registry import EVENTS, Registry
from tracklane.plans.track_queries import frames
from tracklane.sources import virtual
from tracklane.sources.fixtures import event_stream, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

HOUR = 3_600_000


def r6(column):
    return F.round(column, 6)


@query(
    "screen_rates",
    f"""WITH {EVENTS}, s AS (SELECT *, t_ms - lag(t_ms) OVER w > {2 * HOUR} AS apart FROM e WHERE event_type IN ('click', 'error', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)),
    g AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS grp FROM s),
    k AS (SELECT user_id, grp, bool_or(event_type = 'purchase') AS sw, bool_or(event_type = 'error') AS one, count(*) AS n FROM g GROUP BY ALL)
    SELECT user_id, count(*)::BIGINT AS n_groups, count(*) FILTER (sw)::BIGINT AS n_switch, count(*) FILTER (one AND NOT sw)::BIGINT AS n_one_sided, round(avg(n), 6) AS per_group, quantile_cont(n, 0.9)::DOUBLE AS p90 FROM k GROUP BY user_id""",
)
def screen_rates(spark, sf_dir):
    e = event_stream(spark, sf_dir).where(F.col("event_type").isin("click", "error", "purchase"))
    kind = F.col("event_type")
    groups = screens.group_screens(e, ["user_id"], "t_ms", "event_id", 2 * HOUR).groupBy("user_id", "screen_group")
    k = groups.agg(F.bool_or(kind == "purchase").alias("sw"), F.bool_or(kind == "error").alias("one"), F.count(F.lit(1)).alias("n"))
    return k.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if("sw").alias("n_switch"), F.count_if(F.col("one") & ~F.col("sw")).alias("n_one_sided"), r6(F.avg("n")).alias("per_group"), F.percentile("n", 0.9).alias("p90")
    )


@query(
    "threshold_curve",
    f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE event_type = 'view'), f AS (SELECT a.event_id, a.user_id, min(r.t_ms - a.t_ms) AS d FROM a LEFT JOIN e r ON r.user_id = a.user_id AND r.event_type = 'click' AND r.t_ms BETWEEN a.t_ms AND a.t_ms + {24 * HOUR} GROUP BY ALL),
    v AS (SELECT user_id, avg(value) AS v FROM e GROUP BY user_id), u AS (SELECT h, f.user_id, avg((coalesce(d <= h * {HOUR}, false))::INT) AS early, count(*) AS n FROM f, range(2, 25, 2) t(h) GROUP BY ALL)
    SELECT h::BIGINT AS hours, count(*)::BIGINT AS n_units, round(sum(early * n) / sum(n), 6) AS early_rate, round(corr(early, v), 5) AS r FROM u JOIN v ON u.user_id = v.user_id GROUP BY h""",
)
def threshold_curve(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    of = lambda kind, i: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(i), F.col("user_id").alias("key"), "t_ms")
    first = interval.first_after_anchor(of("view", "anchor_id"), of("click", "response_id"), 24 * HOUR)
    hours = F.explode(F.sequence(F.lit(2).cast("long"), F.lit(24).cast("long"), F.lit(2).cast("long")))
    early = F.avg(F.coalesce(F.col("delay_ms") <= F.col("hours") * HOUR, F.lit(False)).cast("double"))
    units = first.withColumn("hours", hours).groupBy("hours", F.col("key").alias("user_id")).agg(early.alias("early"), F.count(F.lit(1)).alias("n"))
    values = e.groupBy("user_id").agg(F.avg("value").alias("v"))
    return units.join(values, "user_id").groupBy("hours").agg(F.count(F.lit(1)).alias("n_units"), r6(F.sum(F.col("early") * F.col("n")) / F.sum("n")).alias("early_rate"), F.round(stats.correlation("early", "v"), 5).alias("r"))


@query(
    "cross_fitted_means",
    """WITH c AS (SELECT l_suppkey, l_orderkey % 5 AS fold, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(s) OVER (PARTITION BY l_suppkey) AS sa, sum(n) OVER (PARTITION BY l_suppkey) AS na FROM c)
    SELECT l_suppkey, fold, round((sa - s) / nullif(na - n, 0), 4) AS mean_of_others FROM w""",
)
def cross_fitted_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 5).alias("fold"), "l_extendedprice")
    return gamesets.left_out_means(li, "l_suppkey", "fold", "l_extendedprice").withColumn("mean_of_others", F.round("mean_of_others", 4))


@query(
    "primary_defender",
    f"""WITH {virtual.SQL}, h AS (SELECT possession, step, slot AS shooter, off_x AS hx, off_y AS hy FROM vt WHERE slot = handler AND step >= 3),
    d AS (SELECT vt.possession, vt.step, vt.slot, round(sqrt((def_x - hx) ** 2 + (def_y - hy) ** 2), 9) AS g FROM vt JOIN h USING (possession, step)),
    n AS (SELECT possession, step, arg_min(slot, g * 10 + slot / 1e9) AS slot FROM d GROUP BY ALL), c AS (SELECT possession, slot, count(*) AS n FROM n GROUP BY ALL)
    SELECT possession, slot::BIGINT AS defender, n::BIGINT AS n_steps FROM (SELECT *, row_number() OVER (PARTITION BY possession ORDER BY n DESC, slot) AS k FROM c) WHERE k = 1 AND n >= 3""",
)
def primary_defender(spark, sf_dir):
    """The defender who is nearest to the handler in most of the last five steps, in at least three; the first slot of ties."""
    hx, hy = matchup.at(F.col("handler"))
    gap = F.transform("def", lambda d, j: F.struct(F.round(court.distance(d["x"], d["y"], F.col("hx"), F.col("hy")), 9).alias("g"), j.cast("long").alias("slot")))
    near = frames(spark, sf_dir).where("step >= 3").withColumns({"hx": hx, "hy": hy}).select("possession", F.array_min(gap)["slot"].alias("slot"))
    best = F.min(F.struct((-F.col("n")).alias("k"), "slot"))
    return near.groupBy("possession", "slot").agg(F.count(F.lit(1)).alias("n")).groupBy("possession").agg(best.alias("b")).select("possession", F.col("b.slot").alias("defender"), (-F.col("b.k")).alias("n_steps")).where("n_steps >= 3")


@query(
    "guarded_skill",
    f"""WITH {virtual.SQL}, p AS (SELECT o_orderkey AS possession, o_totalprice / 1e5 AS skill FROM orders), g AS (SELECT possession, slot, (possession * 5 + slot) % 997 AS target FROM vt GROUP BY ALL)
    SELECT g.possession, g.slot, round(avg(p.skill * (1 + vt.step)), 6) AS skill FROM g JOIN vt ON vt.possession = g.possession AND vt.slot = g.slot JOIN p ON p.possession = g.target GROUP BY ALL""",
)
def guarded_skill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    profile = orders.select(F.col("o_orderkey").alias("target"), (F.col("o_totalprice") / F.lit(1e5)).alias("skill"))
    steps = matchup.defenders(virtual.frames(orders)).select("possession", "slot", "step").withColumn("target", (F.col("possession") * 5 + F.col("slot")) % 997)
    return steps.join(profile, "target").groupBy("possession", "slot").agg(r6(F.avg(F.col("skill") * (1 + F.col("step")))).alias("skill"))


@query(
    "breakdown_rates",
    f"""WITH {virtual.SQL}, m AS (SELECT possession, slot, step, round(sqrt((def_x - off_x) ** 2 + (def_y - off_y) ** 2), 9) > 3.2 AS p FROM vt), i AS (SELECT *, step - sum(p::INT) OVER (PARTITION BY possession, slot ORDER BY step) AS isl FROM m),
    r AS (SELECT possession, slot, min(step) AS s, max(step) + 1 AS e, count(*) AS n FROM i WHERE p GROUP BY possession, slot, isl HAVING count(*) >= 2),
    c AS (SELECT *, s > max(e) OVER (PARTITION BY possession ORDER BY s, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS apart FROM r), d AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY possession ORDER BY s, slot) AS cas FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY possession, cas ORDER BY s, slot) = 1 AS initiator FROM d)
    SELECT slot, count(*)::BIGINT AS n_runs, count(*) FILTER (initiator)::BIGINT AS n_initiated, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6)::DOUBLE AS per_100 FROM f GROUP BY slot""",
)
def breakdown_rates(spark, sf_dir):
    rows = matchup.defenders(frames(spark, sf_dir))
    ox, oy = matchup.at(F.col("slot"))
    gaps = rows.select("possession", "slot", "step", F.round(court.distance(F.col("def_x"), F.col("def_y"), ox, oy), 9).alias("v"))
    runs = islands.true_runs(gaps, ["possession", "slot"], ["step"], F.col("v") > 3.2, "v", 2)
    cascades = islands.merge_intervals(runs, ["possession"], "start_place", "end_place", "slot", 1)
    first = F.row_number().over(Window.partitionBy("possession", "cascade_id").orderBy("start_place", "slot")) == 1
    n = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return cascades.withColumn("initiator", first).groupBy("slot").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("initiator").alias("n_initiated"), r6(100.0 * F.count(F.lit(1)) / n).alias("per_100"))


@query(
    "meta_metrics",
    """WITH u AS (SELECT l_suppkey, l_orderkey % 2 AS half, avg(l_extendedprice) AS m, var_samp(l_extendedprice) / count(*) AS noise FROM lineitem GROUP BY ALL)
    SELECT round(1 - avg(noise) / var_samp(m), 6) AS discrimination, round(1 - (SELECT avg(v) FROM (SELECT var_samp(m) AS v FROM u GROUP BY l_suppkey)) / var_samp(m), 6) AS stability FROM u""",
)
def meta_metrics(spark, sf_dir):
    """Discrimination: share of the variance of unit means that is not noise. Stability: share that is not between a unit's halves."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 2).alias("half")).agg(F.avg("l_extendedprice").alias("m"), (F.var_samp("l_extendedprice") / F.count(F.lit(1))).alias("noise"))
    within = u.groupBy("l_suppkey").agg(F.var_samp("m").alias("v")).agg(F.avg("v")).scalar()
    return u.agg(r6(1 - F.avg("noise") / F.var_samp("m")).alias("discrimination"), F.var_samp("m").alias("all")).select("discrimination", r6(1 - within / F.col("all")).alias("stability"))
