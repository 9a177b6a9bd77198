"""Rates, splits, cards and the shot-quality model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import court, scalars
from tracklane.operators import hmm, learned, matchup, shot_quality, stats
from tracklane.plans.registry import EVENTS, Registry
from tracklane.plans.track_queries import frames
from tracklane.sources import virtual
from tracklane.sources.fixtures import event_stream, table
from tracklane.sources.shared import spread, staged

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

HOUR = 3_600_000


def r6(column):
    return F.round(column, 6)


@query(
    "velocities",
    f"""WITH {virtual.SQL} SELECT possession, slot, step, round(CASE WHEN step = 0 THEN (lead(def_x) OVER w - def_x) * 5 WHEN step = {virtual.STEPS - 1} THEN (def_x - lag(def_x) OVER w) * 5 ELSE (lead(def_x) OVER w - lag(def_x) OVER w) * 2.5 END, 6)::DOUBLE AS vx
    FROM vt WINDOW w AS (PARTITION BY possession, slot ORDER BY step)""",
)
def velocities(spark, sf_dir):
    rows = matchup.defenders(frames(spark, sf_dir))
    w = Window.partitionBy("possession", "slot").orderBy("step")
    before, after = F.lag("def_x").over(w), F.lead("def_x").over(w)
    central = (F.coalesce(after, F.col("def_x")) - F.coalesce(before, F.col("def_x"))) * matchup.HZ / F.when(before.isNull() | after.isNull(), 1).otherwise(2)
    return rows.select("possession", "slot", "step", r6(central).alias("vx"))


@query(
    "drive_flags",
    f"""WITH {virtual.SQL}, h AS (SELECT possession, step, sqrt((off_x - 5.25) ** 2 + (off_y - 25.0) ** 2) AS d FROM vt WHERE slot = handler),
    g AS (SELECT *, d - lead(d, 5) OVER (PARTITION BY possession ORDER BY step) AS gain FROM h)
    SELECT possession, coalesce(bool_or(round(gain, 6) >= 1.5), false) AS drive, round(max(gain), 6) AS best_gain FROM g GROUP BY ALL""",
)
def drive_flags(spark, sf_dir):
    hx, hy = matchup.at(F.col("handler"))
    h = frames(spark, sf_dir).select("possession", "step", court.distance(hx, hy, court.HOOP_X, court.HOOP_Y).alias("d"))
    gain = F.col("d") - F.lead("d", 5).over(Window.partitionBy("possession").orderBy("step"))
    per = h.withColumn("gain", gain).groupBy("possession")
    return per.agg(F.coalesce(F.bool_or(F.round("gain", 6) >= 1.5), F.lit(False)).alias("drive"), r6(F.max("gain")).alias("best_gain"))


_LOC = "CASE WHEN ((off_x <= 14 AND abs(off_y - 25) >= 22) OR sqrt((off_x - 5.25) ** 2 + (off_y - 25.0) ** 2) >= 23.75) THEN (CASE WHEN abs(off_y - 25) >= 21 THEN 'corner' ELSE 'above' END) ELSE 'inside' END"
_SIDE = "CASE WHEN abs(ball_y - 25) < 4 THEN 'middle' WHEN sign(off_y - 25) = sign(ball_y - 25) THEN 'strong' ELSE 'weak' END"


@query(
    "help_rates_cube",
    f"""WITH {virtual.SQL}, x AS (SELECT {_LOC} AS loc, {_SIDE} AS side, round(sqrt((def_x - off_x) ** 2 + (def_y - off_y) ** 2), 9) >= 3.0 AS helped FROM vt WHERE slot <> handler)
    SELECT loc, side, count(*)::BIGINT AS steps, count(*) FILTER (helped)::BIGINT AS helps, round(1000.0 * count(*) FILTER (helped) / count(*), 6)::DOUBLE AS rate FROM x GROUP BY CUBE (loc, side)""",
)
def help_rates_cube(spark, sf_dir):
    rows = matchup.defenders(frames(spark, sf_dir)).where("slot <> handler")
    ox, oy = matchup.at(F.col("slot"))
    loc = F.when(court.is_three(ox, oy), F.when(F.abs(oy - court.HOOP_Y) >= 21, "corner").otherwise("above")).otherwise("inside")
    side = F.when(F.abs(F.col("ball_y") - court.HOOP_Y) < 4, "middle").when(court.same_side(oy, F.col("ball_y")), "strong").otherwise("weak")
    helped = F.round(court.distance(F.col("def_x"), F.col("def_y"), ox, oy), 9) >= 3.0
    cube = rows.select(loc.alias("loc"), side.alias("side"), helped.alias("helped")).cube("loc", "side")
    return cube.agg(F.count(F.lit(1)).alias("steps"), F.count_if("helped").alias("helps"), r6(F.lit(1000.0) * F.count_if("helped") / F.count(F.lit(1))).alias("rate"))


@query(
    "stability_curve",
    """WITH r AS (SELECT rep, l_suppkey, l_orderkey % 2 AS half, l_extendedprice AS v, row_number() OVER (PARTITION BY rep, l_suppkey, l_orderkey % 2 ORDER BY md5(rep || ':' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem, range(4) t(rep)),
    s AS (SELECT n, rep, l_suppkey, half, avg(v) AS m, count(*) AS c FROM r, (VALUES (10), (40)) x(n) WHERE k <= n GROUP BY ALL),
    w AS (SELECT n, rep, l_suppkey, max(m) FILTER (half = 0 AND c = n) AS a, max(m) FILTER (half = 1 AND c = n) AS b FROM s GROUP BY ALL)
    SELECT n::BIGINT AS n, rep::BIGINT AS rep, count(*)::BIGINT AS n_units, round(corr(a, b), 6) AS r FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
)
def stability_curve(spark, sf_dir):
    """Split-half correlation when each unit gives n sampled rows to either half; samples are nested and by hash."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_orderkey") % 2).alias("half"))
    dealt = spread(li, "l_suppkey", "half", rows=200_000)  # before rows are repeated: a unit's half is ranked where it is
    reps = dealt.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    order = Window.partitionBy("rep", "l_suppkey", "half").orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("rep", "l_orderkey", "l_linenumber")]).cast("binary")), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ranked = reps.withColumn("k", F.row_number().over(order)).where("k <= 40")  # the sample sizes are the feature
    sized = ranked.withColumn("n", F.explode(F.array(F.lit(10).cast("long"), F.lit(40).cast("long")))).where("k <= n")
    wide = sized.groupBy("n", "rep", "l_suppkey").agg(*[f.alias(name) for h, name in ((0, "a"), (1, "b")) for f, name in ((F.when(F.count_if(F.col("half") == h) == F.first("n"), F.avg(F.when(F.col("half") == h, F.col("l_extendedprice")))), name),)])
    return wide.where("a is not null and b is not null").groupBy("n", "rep").agg(F.count(F.lit(1)).alias("n_units"), r6(stats.correlation("a", "b")).alias("r"))


@query(
    "game_split",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders), p AS (SELECT *, k <= round_even(0.8 * n, 0) AS pool FROM o),
    v AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('3:' || o_orderkey), o_orderkey) AS j, count(*) OVER (PARTITION BY pool) AS m FROM p)
    SELECT o_orderkey, CASE WHEN NOT pool THEN 'test' WHEN j <= round_even(0.1 * m, 0) THEN 'val' ELSE 'train' END AS split FROM v""",
)
def game_split(spark, sf_dir):
    """First 0.8 by date are the pool, the rest test; a tenth of the pool, by hash, is validation. Ranks come from sums over days."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderdate")
    days = orders.groupBy(F.unix_date("day").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    before = stats.sum_below(days, "d", "c", "before").select("d", "before")
    inside = F.row_number().over(Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey"))
    n = days.agg(F.sum("c")).scalar()
    placed = orders.withColumn("d", F.unix_date("day")).join(before, "d").withColumn("pool", F.col("before") + inside <= F.rint(0.8 * n))
    h = scalars.hash_rank(F.col("o_orderkey"), seed=3)
    hashed = placed.withColumn("h", h).withColumn("cell", F.conv(F.substring("h", 1, 3), 16, 10).cast("long"))
    cells = hashed.where("pool").groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    ahead = stats.sum_below(cells, "cell", "c", "ahead").select("cell", "ahead")
    size = cells.agg(F.sum("c")).scalar()
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("pool", "cell").orderBy("h", "o_orderkey"))
    split = F.when(~F.col("pool"), "test").when(rank <= F.rint(0.1 * size), "val").otherwise("train")
    return hashed.join(F.broadcast(ahead), "cell", "left").select("o_orderkey", split.alias("split"))  # 4096 cells


@query(
    "supplier_cards",
    """WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS rate, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL), e AS (SELECT *, n < 500 AS few FROM s),
    r AS (SELECT *, 100 * (rank() OVER (PARTITION BY few ORDER BY rate) + (count(*) OVER (PARTITION BY few, rate) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY few) - 1, 0) AS p FROM e)
    SELECT l_suppkey, n::BIGINT AS n, round(rate, 6) AS rate, CASE WHEN NOT few THEN round(p, 4)::DOUBLE END AS percentile, CASE WHEN few THEN 'fewer than 500 lines' END AS left_out FROM r""",
)
def supplier_cards(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("rate"))
    few = F.col("n") < 500
    ranked = stats.average_ranks(staged(s.withColumn("few", few)), ["few"], "rate")
    return ranked.select("l_suppkey", "n", r6("rate").alias("rate"), F.when(~few, F.round("rank_pct", 4)).alias("percentile"), F.when(few, "fewer than 500 lines").alias("left_out"))


@query(
    "response_timing",
    f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE event_type = 'view'), f AS (SELECT a.event_id, a.user_id, min(r.t_ms - a.t_ms) AS d FROM a LEFT JOIN e r ON r.user_id = a.user_id AND r.event_type = 'click' AND r.t_ms BETWEEN a.t_ms AND a.t_ms + {12 * HOUR} GROUP BY ALL)
    SELECT user_id, count(*)::BIGINT AS n, count(d)::BIGINT AS n_any, count(*) FILTER (d <= {3 * HOUR})::BIGINT AS n_early, round(avg(d), 3)::DOUBLE AS mean_delay_ms, median(d)::DOUBLE AS median_ms FROM f GROUP BY user_id""",
)
def response_timing(spark, sf_dir):
    from tracklane.operators.interval import first_after_anchor

    e = event_stream(spark, sf_dir)
    of = lambda kind, i: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(i), F.col("user_id").alias("key"), "t_ms")
    first = first_after_anchor(of("view", "anchor_id"), of("click", "response_id"), 12 * HOUR)
    delays = staged(first.select(F.col("key").alias("user_id"), "delay_ms"))
    medians = stats.group_quantiles(delays, ["user_id"], "delay_ms", {"median_ms": 0.5})
    counted = delays.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("delay_ms").alias("n_any"),
        F.count_if(F.col("delay_ms") <= 3 * HOUR).alias("n_early"),
        F.round(F.avg("delay_ms"), 3).alias("mean_delay_ms"),
    )
    return counted.join(medians, "user_id", "left").withColumn("median_ms", F.col("median_ms").cast("double"))


def _shot_table(spark, sf_dir):
    """Synthetic shots with all features of the model; made is a fixed function of the key and the distance."""
    x, y = matchup.at(F.col("handler"))
    last = frames(spark, sf_dir, [virtual.STEPS - 1]).select("possession", "def", x.alias("x"), y.alias("y"))
    dist, three = court.distance(F.col("x"), F.col("y"), court.HOOP_X, court.HOOP_Y), court.is_three(F.col("x"), F.col("y"))
    gap = F.array_min(F.transform("def", lambda d: court.distance(d["x"], d["y"], F.col("x"), F.col("y"))))
    k = F.col("possession")
    shots = last.select("possession", (k % 60).alias("shooter_id"), dist.alias("dist_ft"), three.alias("is_three"), court.shot_angle(F.col("x"), F.col("y")).alias("angle_deg"), gap.alias("def1_ft"), "x", "y", "def")
    return shots.select(
        "*",
        court.zone(F.col("dist_ft"), F.col("is_three"), F.col("y")).alias("zone"),
        (F.col("def1_ft") + k % 3).alias("def_front_ft"),
        F.when(k % 9 == 0, None).otherwise(k % 7).alias("n_dribbles"),
        (k % 7 == 0).alias("catch_and_shoot"),
        (k % 8 == 0).alias("is_transition"),
        F.lit("rim").alias("release_method"),
        ((k * 7919 % 1000) < 700 - 12 * F.col("dist_ft") + k % 60).cast("int").alias("made"),
    )


@query("shot_quality_model")
def shot_quality_model(spark, sf_dir):
    """Coefficients of the full model, and its mean prediction against the observed rate."""
    shots = shot_quality.trusted(_shot_table(spark, sf_dir)).persist()
    try:
        model = shot_quality.fit(shots)
        means = model.predict(shots, leave_one_out=True).agg(F.avg("xfg").alias("p"), F.avg("made").alias("y")).first()
    finally:
        shots.unpersist()
    rows = [*model.coefficients.items(), ("mean_predicted", means["p"]), ("mean_observed", means["y"])]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "name string, value double")


@query("shot_points_difference")
def shot_points_difference(spark, sf_dir):
    """Expected points against a scenario with every defender two feet farther away, by zone."""
    shots = _shot_table(spark, sf_dir)
    model = shot_quality.fit(shots, "M1_geometry_defense")
    far = {"def1_ft": F.col("def1_ft") + 2, "def_front_ft": F.col("def_front_ft") + 2}
    out = shot_quality.points_difference(shots, model, {"far": far})
    return out.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg("xfg_real").alias("xfg"), F.avg("dep_far").alias("dep_far"))


@query("learned_points")
def learned_points(spark, sf_dir):
    """Expected points against defenders drawn from mixtures (where they are, and two feet nearer to the hoop), by zone: each alone, and all of them."""
    shots = staged(_shot_table(spark, sf_dir))  # features are taken from plain columns, for the fit and for the draws
    model = shot_quality.fit(shots, "M1_geometry_defense")
    flat = lambda one: F.flatten(F.transform("def", one))
    place = F.array(F.lit(0.0), F.lit(0.0))
    mixed = shots.select(
        "*", F.col("x").alias("shot_x"), F.col("y").alias("shot_y"), flat(lambda d: F.array(d["x"], d["y"])).alias("defenders"), flat(lambda d: F.array(d["x"], d["y"], d["x"] - 2, d["y"])).alias("means"),
        flat(lambda d: F.array(F.lit(0.6), F.lit(0.4))).alias("weights"), flat(lambda d: F.transform(place, lambda v: v + 1.5)).alias("sigmas"),
    )
    out = learned.learned_points(mixed, model, ["possession", "zone"])
    each = F.aggregate("dep", F.lit(0.0), lambda t, v: t + v) / F.size("dep")
    return out.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg("xfg_real").alias("xfg"), F.avg(each).alias("dep_each"), F.avg("dep_team").alias("dep_team"))


_RULE = "sqrt((def_x - (0.6::DOUBLE * o_x + 0.2::DOUBLE * ball_x + 0.2::DOUBLE * 5.25)) ** 2 + (def_y - (0.6::DOUBLE * o_y + 0.2::DOUBLE * ball_y + 0.2::DOUBLE * 25.0)) ** 2)"


@query(
    "rule_baseline",
    f"""WITH {virtual.SQL}, c AS (SELECT d.possession, d.step, d.slot, list(({_RULE.replace("o_x", "o.off_x").replace("o_y", "o.off_y").replace("def_", "d.def_").replace("ball_", "d.ball_")}) ** 2 ORDER BY o.slot) AS c FROM vt d JOIN vt o USING (possession, step) GROUP BY ALL),
    f AS (SELECT possession, step, list(c ORDER BY slot) AS m FROM c GROUP BY ALL),
    w AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    t AS (SELECT possession, step, min(m[1][a + 1] + m[2][b + 1] + m[3][c + 1] + m[4][d + 1] + m[5][e + 1]) AS total FROM f, w GROUP BY ALL)
    SELECT step, count(*)::BIGINT AS n, round(avg(total), 5) AS mean_total FROM t GROUP BY step""",
)
def rule_baseline(spark, sf_dir):
    """By step, the least total squared distance of defenders to expected positions over all assignments."""
    import numpy as np
    import pyarrow as pa

    from tracklane.operators.baselines import _costs
    from tracklane.operators.mixture import best_assignment

    def run(batches):
        for raw in batches:
            if raw.num_rows:
                batch, cost = _costs(raw, (0.6, 0.2, 0.2))
                _, step = np.nonzero(batch.valid)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(best_assignment(cost[batch.valid])[0])], names=["step", "total"])

    steps = hmm.chains(frames(spark, sf_dir)).mapInArrow(run, "step long, total double")
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 5).alias("mean_total"))
