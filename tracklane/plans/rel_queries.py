"""Relational queries: as-of, interval and band joins, islands, on the events and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.operators import asof, interval, islands, screens
from tracklane.operators.stats import linear_quantiles
from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.fixtures import event_stream, table
from tracklane.sources.shared import staged

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

HOUR = 3_600_000
DAY = 24 * HOUR


def _typed(spark, sf_dir, kind, id_name="id", t_name="t"):
    return event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("event_id").alias(id_name), "user_id", F.col("t_ms").alias(t_name), "value")


@query(
    "first_response_in_window",
    f"""
    WITH {EVENTS},
    a AS (SELECT * FROM e WHERE event_type = 'error'),
    r AS (SELECT * FROM e WHERE event_type = 'purchase'),
    m AS (
      SELECT a.event_id AS anchor_id, arg_min(r.event_id, (r.t_ms - a.t_ms) * 1000000000 + r.event_id) AS response_id,
             min(r.t_ms - a.t_ms) AS delay_ms
      FROM a JOIN r ON a.user_id = r.user_id AND r.t_ms >= a.t_ms AND r.t_ms <= a.t_ms + {DAY}
      GROUP BY a.event_id)
    SELECT a.event_id AS anchor_id, a.user_id AS key, m.response_id, m.delay_ms
    FROM a LEFT JOIN m ON a.event_id = m.anchor_id
    """,
)
def first_response_in_window(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    anchors = e.where(F.col("event_type") == "error").select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("key"), "t_ms")
    responses = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("response_id"), F.col("user_id").alias("key"), "t_ms")
    return interval.first_after_anchor(anchors, responses, horizon_ms=DAY).select("anchor_id", "key", "response_id", "delay_ms")


_NEAREST = """
    WITH {events},
    l AS (SELECT * FROM e WHERE event_type = 'click'),
    r AS (SELECT * FROM e WHERE event_type = 'purchase'),
    m AS (
      SELECT l.event_id, arg_min({{'id': r.event_id, 't': r.t_ms}}, (abs(r.t_ms - l.t_ms)::HUGEINT * 10000000000000 + r.t_ms) * 10000000000 + r.event_id) AS b
      FROM l JOIN r ON l.user_id = r.user_id {where} GROUP BY l.event_id)
    SELECT l.event_id AS id, l.user_id, l.t_ms AS t, b.id AS r_id, b.t AS r_t FROM l LEFT JOIN m ON l.event_id = m.event_id
"""


@query("asof_nearest_tol", _NEAREST.format(events=EVENTS, where=f"AND abs(r.t_ms - l.t_ms) <= {6 * HOUR}"))
def asof_nearest_tol(spark, sf_dir):
    return asof.nearest_within(_typed(spark, sf_dir, "click").drop("value"), _typed(spark, sf_dir, "purchase"), ["user_id"], 6 * HOUR).select("id", "user_id", "t", "r_id", "r_t")


@query("asof_nearest_by_group", _NEAREST.format(events=EVENTS, where=""))
def asof_nearest_by_group(spark, sf_dir):
    return asof.nearest_by_group(_typed(spark, sf_dir, "click").drop("value"), _typed(spark, sf_dir, "purchase"), ["user_id"])


_INSIDE = """
    WITH {events},
    p AS (SELECT event_id AS point_id, user_id, t_ms AS t FROM e WHERE event_type = 'view'),
    i AS (SELECT event_id AS interval_id, user_id, t_ms AS t_start, t_ms + {width} AS t_end FROM e WHERE event_type = 'signup'),
    c AS (SELECT p.point_id, i.interval_id, row_number() OVER (PARTITION BY p.point_id ORDER BY {order}) AS k
          FROM p JOIN i ON p.user_id = i.user_id AND p.t BETWEEN i.t_start - {lead} AND i.t_end)
    SELECT p.point_id, p.user_id, p.t, c.interval_id FROM p LEFT JOIN c ON p.point_id = c.point_id AND c.k = 1
"""


def _inside(spark, sf_dir, prefer_inside):
    points = _typed(spark, sf_dir, "view", "point_id").drop("value")
    intervals = _typed(spark, sf_dir, "signup", "interval_id", "t_start").drop("value").withColumn("t_end", F.col("t_start") + 12 * HOUR)
    return interval.point_in_interval(points, intervals, ["user_id"], lead_ms=HOUR, cell_ms=6 * HOUR, prefer_inside=prefer_inside).select("point_id", "user_id", "t", "interval_id")


@query("point_in_interval_first", _INSIDE.format(events=EVENTS, width=12 * HOUR, lead=HOUR, order="i.interval_id"))
def point_in_interval_first(spark, sf_dir):
    return _inside(spark, sf_dir, False)


@query("point_in_interval_prefer_inside", _INSIDE.format(events=EVENTS, width=12 * HOUR, lead=HOUR, order="(p.t < i.t_start)::INT, i.t_start, i.interval_id"))
def point_in_interval_prefer_inside(spark, sf_dir):
    return _inside(spark, sf_dir, True)


@query(
    "band_join_median",
    f"""
    WITH {EVENTS},
    a AS (SELECT * FROM e WHERE event_type = 'purchase'), b AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT a.event_id AS id, round(median(b.value), 6) AS median_value, count(*)::BIGINT AS n
    FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t_ms - b.t_ms) <= {12 * HOUR} GROUP BY a.event_id
    """,
)
def band_join_median(spark, sf_dir):
    left = _typed(spark, sf_dir, "purchase").select("id", "user_id", "t")
    right = _typed(spark, sf_dir, "view", "r_id", "r_t")
    return interval.band_pairs(left, right, ["user_id"], 12 * HOUR).groupBy("id").agg(F.round(F.median("value"), 6).alias("median_value"), F.count(F.lit(1)).alias("n"))


@query(
    "pair_overlap_distinct",
    f"""
    WITH {EVENTS},
    a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'view'),
    m AS (SELECT DISTINCT a.event_id, a.user_id FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t_ms - b.t_ms) <= {HOUR}),
    n AS (SELECT user_id, count(*) AS n_a FROM a GROUP BY user_id), k AS (SELECT user_id, count(*) AS n_both FROM m GROUP BY user_id)
    SELECT n.user_id, n_a::BIGINT AS n_a, coalesce(n_both, 0)::BIGINT AS n_both FROM n LEFT JOIN k ON n.user_id = k.user_id
    """,
)
def pair_overlap_distinct(spark, sf_dir):
    a, b = _typed(spark, sf_dir, "click").select("id", "user_id", "t"), _typed(spark, sf_dir, "view", "r_id", "r_t")
    both = interval.band_pairs(a, b, ["user_id"], HOUR).select("id", "user_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_both"))
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_a")).join(both, "user_id", "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))


@query(
    "entity_dedup_keep_first",
    """
    SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1
    """,
)
def entity_dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("f")  # combined before the shuffle
    return rows.groupBy("l_orderkey", "l_suppkey").agg(first).select("l_orderkey", "l_suppkey", "f.l_partkey", "f.l_linenumber", "f.l_quantity")


_SEGMENTS = f"""
    {EVENTS},
    d AS (SELECT *, t_ms - lag(t_ms) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)),
    g AS (SELECT *, dt IS NULL OR dt > {6 * HOUR} AS gap FROM d),
    s AS (SELECT *, (sum(gap::INT) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment_id FROM g)
"""


def _segments(spark, sf_dir):
    e = event_stream(spark, sf_dir).select("event_id", "user_id", "t_ms")
    return islands.gap_segments(e, ["user_id"], "t_ms", "event_id", 6 * HOUR)


@query("frame_index_segments", f"WITH {_SEGMENTS} SELECT event_id, user_id, t_ms, dt, gap, segment_id FROM s")
def frame_index_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("event_id", "user_id", "t_ms", "dt", "gap", "segment_id")


@query(
    "segment_lengths_report",
    f"""WITH {_SEGMENTS}, l AS (SELECT user_id, segment_id, count(*) AS n, max(t_ms) - min(t_ms) AS ms FROM s GROUP BY ALL)
    SELECT count(*)::BIGINT AS n_segments, sum(n)::BIGINT AS n_rows, median(ms)::DOUBLE AS median_ms, max(ms) AS max_ms, max(n)::BIGINT AS longest FROM l""",
)
def segment_lengths_report(spark, sf_dir):
    lengths = _segments(spark, sf_dir).groupBy("user_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("ms"))
    held = staged(lengths)
    median = F.lit(linear_quantiles(held, "ms", [0.5], stage=False)[0]).cast("double")
    return held.agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_rows"), median.alias("median_ms"), F.max("ms").alias("max_ms"), F.max("n").alias("longest"))


@query(
    "clock_freeze_lead",
    f"""WITH {EVENTS}
    SELECT event_id, user_id, first_value(value) OVER w AS first_in_key, max((event_type = 'error')::INT) OVER w::BOOLEAN AS seen_error,
           abs(value - lag(value) OVER w) < 1.0 AS frozen
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def clock_freeze_lead(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("t_ms", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return event_stream(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.first_value("value").over(so_far).alias("first_in_key"),
        F.max(F.col("event_type") == "error").over(so_far).alias("seen_error"),
        (F.abs(F.col("value") - F.lag("value").over(order)) < 1.0).alias("frozen"),
    )


@query(
    "forward_fill_prior_value",
    f"""WITH {EVENTS},
    f AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM e)
    SELECT event_id, user_id, coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY t_ms, event_id), 0.0)::DOUBLE AS prior_value FROM f""",
)
def forward_fill_prior_value(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("t_ms", "event_id")
    filled = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return event_stream(spark, sf_dir).withColumn("v", filled).select("event_id", "user_id", F.coalesce(F.lag("v").over(order), F.lit(0.0)).alias("prior_value"))


_RUNS = f"""
    {EVENTS},
    c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS ch,
                 row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS k FROM e),
    r AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE ch::INT END) OVER (PARTITION BY user_id ORDER BY k) AS run_id FROM c),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_id) AS run_length FROM r),
    s AS (SELECT *, last_value(CASE WHEN run_length >= 2 OR run_id = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stable FROM n)
"""


def _stable(spark, sf_dir):
    return islands.stable_labels(event_stream(spark, sf_dir), ["user_id"], ["t_ms", "event_id"], "event_type", min_hold=2)


@query("stable_path", f"WITH {_RUNS} SELECT event_id, user_id, event_type, run_id::BIGINT AS run_id, run_length::BIGINT AS run_length, stable FROM s")
def stable_path(spark, sf_dir):
    return _stable(spark, sf_dir).select("event_id", "user_id", "event_type", "run_id", "run_length", "stable")


@query(
    "switch_events",
    f"""WITH {_RUNS}, w AS (SELECT *, lag(stable) OVER (PARTITION BY user_id ORDER BY k) AS from_label FROM s WHERE stable <> 'view')
    SELECT event_id, user_id, t_ms, from_label, stable AS to_label FROM w WHERE from_label <> stable""",
)
def switch_events(spark, sf_dir):
    man = _stable(spark, sf_dir).where(F.col("stable") != "view")  # one label takes no part, as help states do
    return islands.changes(man, ["user_id"], ["t_ms", "event_id"], "stable").select("event_id", "user_id", "t_ms", "from_label", F.col("stable").alias("to_label"))


@query(
    "sticky_label",
    f"""WITH {EVENTS},
    l AS (SELECT *, CASE WHEN value >= 20 THEN event_type END AS cand, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS k FROM e),
    c AS (SELECT *, cand IS DISTINCT FROM lag(cand) OVER (PARTITION BY user_id ORDER BY k) AS ch FROM l),
    r AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE ch::INT END) OVER (PARTITION BY user_id ORDER BY k) AS run_id FROM c),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_id) AS len FROM r)
    SELECT event_id, user_id, last_value(CASE WHEN cand IS NOT NULL AND len >= 2 THEN cand END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holder FROM n""",
)
def sticky_label(spark, sf_dir):
    cand = event_stream(spark, sf_dir).withColumn("cand", F.when(F.col("value") >= 20, F.col("event_type")))
    return islands.stable_labels(cand, ["user_id"], ["t_ms", "event_id"], "cand", 2, first_holds=False).select("event_id", "user_id", F.col("stable").alias("holder"))


_TRUE = f"""
    {EVENTS},
    o AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(value > 40, false) AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)),
    i AS (SELECT *, place - sum(f::INT) OVER (PARTITION BY user_id ORDER BY place) AS isl FROM o),
    r AS (SELECT user_id, min(place)::BIGINT AS start_place, max(place)::BIGINT + 1 AS end_place, count(*)::BIGINT AS length, max(value) AS peak FROM i WHERE f GROUP BY user_id, isl HAVING count(*) >= 2)
"""


def _true_runs(spark, sf_dir):
    return islands.true_runs(event_stream(spark, sf_dir), ["user_id"], ["t_ms", "event_id"], F.col("value") > 40, "value", 2)


@query("true_runs", f"WITH {_TRUE} SELECT * FROM r")
def true_runs(spark, sf_dir):
    return _true_runs(spark, sf_dir).select("user_id", F.col("start_place").cast("long"), F.col("end_place").cast("long"), "length", "peak")


@query(
    "merge_cascades",
    f"""WITH {_TRUE},
    m AS (SELECT *, start_place > max(end_place) OVER (PARTITION BY user_id ORDER BY start_place, end_place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 AS apart FROM r),
    c AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_place, end_place) AS cascade_id FROM m)
    SELECT user_id, cascade_id::BIGINT AS cascade_id, min(start_place) AS start_place, max(end_place) AS end_place, count(*)::BIGINT AS n_runs, max(peak) AS peak FROM c GROUP BY ALL""",
)
def merge_cascades(spark, sf_dir):
    merged = islands.merge_intervals(_true_runs(spark, sf_dir), ["user_id"], "start_place", "end_place", "end_place", 3)
    return merged.groupBy("user_id", "cascade_id").agg(
        F.min("start_place").cast("long").alias("start_place"), F.max("end_place").cast("long").alias("end_place"), F.count(F.lit(1)).alias("n_runs"), F.max("peak").alias("peak")
    )


@query(
    "sustained_max",
    f"""WITH {EVENTS},
    h AS (SELECT user_id, CASE WHEN count(value) OVER w = 3 THEN min(value) OVER w END AS held FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT user_id, max(held) AS sustained FROM h GROUP BY user_id""",
)
def sustained_max(spark, sf_dir):
    return islands.sustained_max(event_stream(spark, sf_dir), ["user_id"], ["t_ms", "event_id"], "value", 3)


_SPANS = f"e.event_id AS interval_id, e.user_id // 20 AS team, e.user_id AS actor, e.t_ms AS t_start, e.t_ms + CASE WHEN e.event_id % 97 = 0 THEN {20 * DAY} ELSE (e.event_id * 7919 % 100) ** 2 * 1000 END AS t_end FROM e WHERE e.event_type = 'click'"


@query(
    "covering_interval_sets",
    f"""WITH {EVENTS}, i AS (SELECT {_SPANS}), p AS (SELECT event_id AS point_id, user_id // 20 AS team, t_ms AS t FROM e WHERE event_type = 'view')
    SELECT p.point_id, i.actor, string_agg(i.interval_id::VARCHAR, ',' ORDER BY i.interval_id) AS intervals, count(*)::BIGINT AS n, min(t_start)::BIGINT AS first_start, max(t_end)::BIGINT AS last_end
    FROM p JOIN i ON p.team = i.team AND t BETWEEN t_start AND t_end GROUP BY ALL""",
)
def covering_interval_sets(spark, sf_dir):
    """For each view and user of its team, all click intervals that hold it: of seconds, minutes, hours and, some, of twenty days."""
    e = event_stream(spark, sf_dir)
    team = F.floor(F.col("user_id") / 20).alias("team")
    length = F.when(F.col("event_id") % 97 == 0, F.lit(20 * DAY)).otherwise(F.pow(F.col("event_id") * 7919 % 100, F.lit(2)).cast("long") * 1000)
    spans = e.where("event_type = 'click'").select(F.col("event_id").alias("interval_id"), team, F.col("user_id").alias("actor"), F.col("t_ms").alias("t_start"), (F.col("t_ms") + length).alias("t_end"))
    points = e.where("event_type = 'view'").select(F.col("event_id").alias("point_id"), team, F.col("t_ms").alias("t"))
    sets = interval.covering_sets(points, spans, ["team"], "actor", 60_000)
    return sets.select("point_id", "actor", F.array_join(F.col("intervals").cast("array<string>"), ",").alias("intervals"), F.size("intervals").cast("long").alias("n"), "first_start", "last_end")


@query(
    "screen_response_chain",
    f"""WITH {EVENTS}, p AS (SELECT user_id // 20 AS game, event_id AS possession, t_ms AS t_start, t_ms + {6 * HOUR} AS t_end FROM e WHERE event_type = 'view'),
    s AS (SELECT user_id // 20 AS game, event_id // 40 AS screen_group, event_id AS screen_id, t_ms AS t_contact, user_id AS a, user_id + 1 AS b, value > 60 AS switched FROM e WHERE event_type = 'error'),
    j AS (SELECT s.*, p.possession, row_number() OVER (PARTITION BY screen_id ORDER BY (t_contact < t_start)::INT, t_start, possession) AS k FROM s JOIN p ON p.game = s.game AND t_contact BETWEEN t_start - {HOUR} AND t_end),
    g AS (SELECT *, row_number() OVER (PARTITION BY game, screen_group ORDER BY t_contact, screen_id) AS f, bool_or(coalesce(switched, false)) OVER (PARTITION BY game, screen_group) AS sw, count(*) OVER (PARTITION BY game, screen_group) AS n FROM j WHERE k = 1),
    h AS (SELECT p.possession, e.event_id AS help_id, e.user_id AS def_id, e.t_ms AS t FROM p JOIN e ON e.event_type = 'purchase' AND e.user_id // 20 = p.game AND e.t_ms BETWEEN p.t_start AND p.t_end),
    r AS (SELECT g.game, g.screen_group, h.def_id, h.t - g.t_contact AS d, row_number() OVER (PARTITION BY g.game, g.screen_group ORDER BY h.t, h.help_id) AS k FROM g JOIN h ON h.possession = g.possession AND h.t BETWEEN g.t_contact AND g.t_contact + {3 * HOUR} AND h.def_id NOT IN (g.a, g.b) WHERE g.f = 1)
    SELECT g.game, g.screen_group, g.possession, g.t_contact, g.sw AS switched, g.n::BIGINT AS n_screens, r.d::BIGINT AS help_delay_ms, r.def_id AS helper, r.def_id IS NOT NULL AS helped FROM g LEFT JOIN r ON r.game = g.game AND r.screen_group = g.screen_group AND r.k = 1 WHERE g.f = 1""",
)
def screen_response_chain(spark, sf_dir):
    """Screens to possessions to the first help by a third man."""
    e = event_stream(spark, sf_dir)
    game = F.floor(F.col("user_id") / 20).alias("game")
    possessions = e.where("event_type = 'view'").select(game, F.col("event_id").alias("possession"), F.col("t_ms").alias("t_start"), (F.col("t_ms") + 6 * HOUR).alias("t_end"))
    calls = e.where("event_type = 'error'").select(game, F.floor(F.col("event_id") / 40).alias("screen_group"), F.col("event_id").alias("screen_id"), F.col("t_ms").alias("t_contact"), F.col("user_id").alias("screened_def"), (F.col("user_id") + 1).alias("screener_def"), (F.col("value") > 60).alias("switched"))
    acts = e.where("event_type = 'purchase'").select(game, F.col("event_id").alias("point_id"), F.col("user_id").alias("def_id"), F.col("t_ms").alias("t"))
    met = interval.covering(acts, possessions.withColumnRenamed("possession", "interval_id"), ["game"], HOUR)
    helps = met.join(acts.select("point_id", "def_id"), "point_id").select(F.col("interval_id").alias("possession"), F.col("point_id").alias("help_id"), "def_id", "t")
    out = screens.screen_responses(calls, possessions, helps, HOUR, 3 * HOUR, HOUR)
    return out.select("game", "screen_group", "possession", "t_contact", "switched", "n_screens", "help_delay_ms", "helper", "helped")
