"""Geometric queries on synthetic tracking frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.functions import court
from tracklane.operators import islands, matchup, stats
from tracklane.plans.registry import Registry
from tracklane.sources import virtual
from tracklane.sources.fixtures import table
from tracklane.sources.shared import spread

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def keys(spark, sf_dir):
    """Order keys, dealt: a possession and all that is made of it stays in one task."""
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def frames(spark, sf_dir, steps=None):
    return virtual.frames(keys(spark, sf_dir), steps)


def r6(column):
    return F.round(column, 6)


_G = "CASE WHEN sign({oy} - 25) = sign(ball_y - 25) THEN {s} ELSE {w} END"


def _mu(axis, oy, hoop):
    (so, sb, sh), (wo, wb, wh) = matchup.STRONG, matchup.WEAK
    strong = f"{so}::DOUBLE * o_{axis} + {sb}::DOUBLE * ball_{axis} + {sh}::DOUBLE * {hoop}"
    weak = f"{wo}::DOUBLE * o_{axis} + {wb}::DOUBLE * ball_{axis} + {wh}::DOUBLE * {hoop}"
    return _G.format(oy=oy, s=f"({strong})", w=f"({weak})")


@query(
    "min_residual_match",
    f"""WITH {virtual.SQL},
    p AS (SELECT d.possession, d.step, d.slot, o.slot AS man, d.def_x, d.def_y, d.ball_x, d.ball_y, o.off_x AS o_x, o.off_y AS o_y FROM vt d JOIN vt o USING (possession, step)),
    r AS (SELECT *, sqrt((def_x - ({_mu("x", "o_y", "5.25")})) ** 2 + (def_y - ({_mu("y", "o_y", "25.0")})) ** 2) AS residual FROM p)
    SELECT man, count(*)::BIGINT AS n, count(*) FILTER (man = slot)::BIGINT AS n_own, round(avg(residual), 5) AS mean_residual FROM (
      SELECT *, row_number() OVER (PARTITION BY possession, step, slot ORDER BY round(residual, 9), man) AS k FROM r) WHERE k = 1 GROUP BY man""",
)
def min_residual_match(spark, sf_dir):
    best = matchup.min_residual(frames(spark, sf_dir))
    return best.groupBy("man").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("man") == F.col("slot")).alias("n_own"), F.round(F.avg("residual"), 5).alias("mean_residual"))


@query(
    "rule_expectation_dev",
    f"""WITH {virtual.SQL}, o AS (SELECT *, off_x AS o_x, off_y AS o_y FROM vt),
    m AS (SELECT *, sign(o_y - 25) = sign(ball_y - 25) AS strong, def_x - ({_mu("x", "o_y", "5.25")}) AS vx, def_y - ({_mu("y", "o_y", "25.0")}) AS vy FROM o)
    SELECT possession, slot, count(*)::BIGINT AS n_steps, round(avg(sqrt(vx * vx + vy * vy)), 5) AS dev,
           round(avg((vx * (5.25 - o_x) + vy * (25.0 - o_y)) / greatest(sqrt((o_x - 5.25) ** 2 + (o_y - 25.0) ** 2), 1e-6)), 5) AS sag, round(avg(strong::INT), 6) AS share_strong
    FROM m GROUP BY ALL HAVING count(*) >= 5""",
)
def rule_expectation_dev(spark, sf_dir):
    steps = matchup.expected_deviation(frames(spark, sf_dir))
    return (
        steps.groupBy("possession", "slot")
        .agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("dev"), 5).alias("dev"), F.round(F.avg("sag"), 5).alias("sag"), r6(F.avg(F.col("strong").cast("double"))).alias("share_strong"))
        .where("n_steps >= 5")
    )


@query(
    "cone_flags",
    f"""WITH {virtual.SQL}, h AS (SELECT possession, step, off_x AS hx, off_y AS hy FROM vt WHERE slot = handler),
    c AS (SELECT vt.*, hx, hy, sqrt((def_x - hx) ** 2 + (def_y - hy) ** 2) AS dist, sqrt((hx - 5.25) ** 2 + (hy - 25.0) ** 2) AS reach FROM vt JOIN h USING (possession, step))
    SELECT possession, slot, count(*) FILTER (dist > 0 AND dist <= reach AND (def_x - hx) * (5.25 - hx) + (def_y - hy) * (25.0 - hy) >= cos(radians(20)) * dist * reach)::BIGINT AS n_cone FROM c GROUP BY ALL""",
)
def cone_flags(spark, sf_dir):
    hx, hy = matchup.at(F.col("handler"))
    inside = court.in_cone(hx, hy, F.col("def_x"), F.col("def_y"), 20.0)
    return matchup.defenders(frames(spark, sf_dir)).groupBy("possession", "slot").agg(F.count_if(inside).alias("n_cone"))


@query(
    "paint_runs",
    f"""WITH {virtual.SQL}, f AS (SELECT *, def_x >= 0 AND def_x <= 19 AND abs(def_y - 25) <= 8 AS p FROM vt),
    i AS (SELECT *, step - sum(p::INT) OVER (PARTITION BY possession, slot ORDER BY step) AS isl FROM f)
    SELECT possession, slot, min(step)::BIGINT AS start_step, count(*)::BIGINT AS length FROM i WHERE p GROUP BY possession, slot, isl HAVING count(*) >= 3""",
)
def paint_runs(spark, sf_dir):
    rows = matchup.defenders(frames(spark, sf_dir))
    runs = islands.true_runs(rows, ["possession", "slot"], ["step"], court.in_paint(F.col("def_x"), F.col("def_y")), "def_x", 3)
    return runs.select("possession", "slot", F.col("start_place").cast("long").alias("start_step"), "length")


@query(
    "help_events",
    f"""WITH {virtual.SQL}, h AS (SELECT possession, step, off_x AS hx, off_y AS hy FROM vt WHERE slot = handler),
    d AS (SELECT vt.*, hx, hy, sqrt((def_x - off_x) ** 2 + (def_y - off_y) ** 2) AS to_man, sqrt((def_x - hx) ** 2 + (def_y - hy) ** 2) AS to_h FROM vt JOIN h USING (possession, step)),
    c AS (SELECT *, (lag(to_h) OVER (PARTITION BY possession, slot ORDER BY step) - to_h) * 5 AS closing FROM d),
    f AS (SELECT *, coalesce(slot <> handler AND sqrt((hx - 5.25) ** 2 + (hy - 25.0) ** 2) <= 20 AND to_man >= 2 AND closing >= 3, false) AS p FROM c),
    i AS (SELECT *, step - sum(p::INT) OVER (PARTITION BY possession, slot ORDER BY step) AS isl FROM f)
    SELECT possession, slot, min(step)::BIGINT AS start_step, count(*)::BIGINT AS length, round(max(to_man), 6) AS max_to_man FROM i WHERE p GROUP BY possession, slot, isl HAVING count(*) >= 2""",
)
def help_events(spark, sf_dir):
    runs = matchup.geometric_help(frames(spark, sf_dir), leave=2.0)
    return runs.select("possession", "slot", F.col("start_place").cast("long").alias("start_step"), "length", r6("peak").alias("max_to_man"))


_SHOT = f"""{virtual.SQL}, sh AS (SELECT possession, off_x AS x, off_y AS y FROM vt WHERE slot = handler AND step = 7),
    g AS (SELECT *, sqrt((x - 5.25) ** 2 + (y - 25.0) ** 2) AS dist, (x <= 14 AND abs(y - 25.0) >= 22) OR sqrt((x - 5.25) ** 2 + (y - 25.0) ** 2) >= 23.75 AS three FROM sh)"""


def _shots(spark, sf_dir):
    x, y = matchup.at(F.col("handler"))
    last = frames(spark, sf_dir, [virtual.STEPS - 1])
    return last.select("possession", "def", x.alias("x"), y.alias("y")).withColumn("dist", court.distance(F.col("x"), F.col("y"), court.HOOP_X, court.HOOP_Y)).withColumn("three", court.is_three(F.col("x"), F.col("y")))


@query(
    "zone_labels",
    f"""WITH {_SHOT} SELECT CASE WHEN three AND abs(y - 25.0) >= 21 THEN 'corner3' WHEN three THEN 'above3' WHEN dist < 4 THEN 'rim' WHEN dist < 14 THEN 'paint' ELSE 'mid' END AS zone, count(*)::BIGINT AS n, round(avg(dist), 5) AS dist FROM g GROUP BY ALL""",
)
def zone_labels(spark, sf_dir):
    shots = _shots(spark, sf_dir)
    return shots.groupBy(court.zone(F.col("dist"), F.col("three"), F.col("y")).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 5).alias("dist"))


@query(
    "shot_geometry",
    f"""WITH {_SHOT}, d AS (SELECT g.*, def_x, def_y, sqrt((def_x - x) ** 2 + (def_y - y) ** 2) AS dd FROM g JOIN vt USING (possession) WHERE step = 7)
    SELECT possession, round(any_value(dist), 6) AS dist_ft, round(any_value(degrees(atan2(abs(y - 25.0), greatest(x - 5.25, 1e-3)))), 6) AS angle_deg, any_value(three) AS is_three,
      round(min(dd), 6) AS def1_ft, round(list_sort(list(dd))[2], 6) AS def2_ft,
      round(coalesce(min(dd) FILTER ((def_x - x) * (5.25 - x) + (def_y - y) * (25.0 - y) >= cos(radians(45)) * greatest(dd * greatest(dist, 1e-6), 1e-6)), 30.0), 6) AS def_front_ft
    FROM d GROUP BY possession""",
)
def shot_geometry(spark, sf_dir):
    x, y, dist = F.col("x"), F.col("y"), F.col("dist")
    gap = lambda d: court.distance(d["x"], d["y"], x, y)
    along = lambda d: (d["x"] - x) * (court.HOOP_X - x) + (d["y"] - y) * (court.HOOP_Y - y)
    front = F.filter("def", lambda d: along(d) >= F.cos(F.radians(F.lit(court.FRONT_CONE_DEGREES))) * F.greatest(gap(d) * F.greatest(dist, F.lit(1e-6)), F.lit(1e-6)))
    gaps = F.array_sort(F.transform("def", gap))
    return _shots(spark, sf_dir).select(
        "possession",
        r6("dist").alias("dist_ft"),
        r6(court.shot_angle(x, y)).alias("angle_deg"),
        F.col("three").alias("is_three"),
        r6(F.get(gaps, F.lit(0))).alias("def1_ft"),
        r6(F.get(gaps, F.lit(1))).alias("def2_ft"),
        r6(F.coalesce(F.array_min(F.transform(front, gap)), F.lit(court.NO_FRONT))).alias("def_front_ft"),
    )


@query(
    "handler_candidates",
    f"""WITH {virtual.SQL}, d AS (SELECT *, sqrt((off_x - ball_x) ** 2 + (off_y - ball_y) ** 2) AS g FROM vt),
    n AS (SELECT *, row_number() OVER (PARTITION BY possession, step ORDER BY round(g, 9), slot) AS k FROM d)
    SELECT possession, step, CASE WHEN g <= 3 THEN slot ELSE -1 END::BIGINT AS candidate FROM n WHERE k = 1""",
)
def handler_candidates(spark, sf_dir):
    near = F.array_min(F.transform("off", lambda o, j: F.struct(F.round(court.distance(o["x"], o["y"], F.col("ball_x"), F.col("ball_y")), 9).alias("g"), j.cast("long").alias("slot"))))
    return frames(spark, sf_dir).withColumn("near", near).select("possession", "step", F.when(F.col("near.g") <= 3, F.col("near.slot")).otherwise(-1).cast("long").alias("candidate"))


@query(
    "closeouts",
    f"""WITH {virtual.SQL}, c AS (SELECT *, sqrt((def_x - off_x) ** 2 + (def_y - off_y) ** 2) AS dd FROM vt WHERE slot = (handler + 1) % 5),
    f AS (SELECT possession, any_value(slot) AS slot, max(dd) FILTER (step = 2) AS d0, min(step) FILTER (dd <= 3) AS closed, arg_min(dd, step) FILTER (dd <= 3) AS dd FROM c WHERE step BETWEEN 2 AND 7 GROUP BY possession)
    SELECT possession, slot, (closed - 2)::BIGINT AS steps, round(d0, 6) AS dist_at_catch, round((d0 - dd) * 5 / greatest(closed - 2, 1), 6) AS closing_speed
    FROM f WHERE d0 > 3.5 AND (d0 - dd) * 5 / greatest(closed - 2, 1) >= 0.5""",
)
def closeouts(spark, sf_dir):
    """The receiver is the slot after the handler's, caught at step 2; far, near and speed limits fit the synthetic frames."""
    own = matchup.defenders(frames(spark, sf_dir)).where((F.col("slot") == (F.col("handler") + 1) % 5) & F.col("step").between(2, 7))
    ox, oy = matchup.at(F.col("slot"))
    gap = own.withColumn("dd", court.distance(F.col("def_x"), F.col("def_y"), ox, oy))
    first = F.min(F.when(F.col("dd") <= 3, F.struct("step", "dd")))
    found = gap.groupBy("possession", "slot").agg(F.max(F.when(F.col("step") == 2, F.col("dd"))).alias("d0"), first.alias("near")).where("near is not null and d0 > 3.5")
    steps = F.col("near.step") - 2
    speed = (F.col("d0") - F.col("near.dd")) * 5 / F.greatest(steps, F.lit(1))
    return found.withColumn("speed", speed).where("speed >= 0.5").select("possession", "slot", steps.alias("steps"), r6("d0").alias("dist_at_catch"), r6("speed").alias("closing_speed"))


@query(
    "breakdown_runs",
    f"""WITH {virtual.SQL}, m AS (SELECT possession, slot, step, round(sqrt((def_x - off_x) ** 2 + (def_y - off_y) ** 2), 9) AS v FROM vt),
    h AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN min(v) OVER w END AS held FROM m WINDOW w AS (PARTITION BY possession, slot ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    s AS (SELECT possession, max(held) AS sustained FROM h GROUP BY possession), t AS (SELECT round(quantile_cont(sustained, 0.8), 9) AS th FROM s),
    f AS (SELECT m.*, v > th AS p FROM m, t), i AS (SELECT *, step - sum(p::INT) OVER (PARTITION BY possession, slot ORDER BY step) AS isl FROM f)
    SELECT possession, slot, min(step)::BIGINT AS start_step, count(*)::BIGINT AS length, round(max(v), 6) AS peak FROM i WHERE p GROUP BY possession, slot, isl HAVING count(*) >= 3""",
)
def breakdown_runs(spark, sf_dir):
    apart = F.zip_with("def", "off", lambda d, o: F.round(court.distance(d["x"], d["y"], o["x"], o["y"]), 9))
    gaps = frames(spark, sf_dir).select("possession", "step", F.posexplode(apart).alias("slot", "v")).withColumn("slot", F.col("slot").cast("long"))  # made twice: staged ones would have to be dealt again
    sustained = islands.sustained_max(gaps, ["possession", "slot"], ["step"], "v", 3).groupBy("possession").agg(F.max("sustained").alias("sustained"))
    threshold = round(stats.linear_quantiles(sustained, "sustained", [0.8])[0], 9)
    runs = islands.true_runs(gaps.withColumn("above", F.col("v") > threshold), ["possession", "slot"], ["step"], F.col("above"), "v", 3)
    return runs.select("possession", "slot", F.col("start_place").cast("long").alias("start_step"), "length", r6("peak").alias("peak"))
