"""Streams replayed from the event files; results equal the batch form over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.fixtures import table
from tracklane.sources.shared import new_folder
from tracklane.streaming import events, holding

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


#: Delay of watermarks, and time within which a response counts, in milliseconds.
LATE, HORIZON = 3_600_000, 43_200_000


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return events.event_source(spark, path, table(spark, sf_dir, "events").schema, files_per_trigger=1000)


@query(
    "stream_daily_rates",
    "SELECT epoch_us(time_bucket(INTERVAL 1 day, ts)) // 1000 AS t_start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
)
def stream_daily_rates(spark, sf_dir):
    out = events.replayed(events.rates(_stream(spark, sf_dir), "1 day"), new_folder(spark, "streams"))
    return out.select(F.unix_millis("t_start").alias("t_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query(
    "stream_sessions",
    """WITH d AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap < INTERVAL 6 hour THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
    SELECT user_id, epoch_us(min(ts)) // 1000 AS t_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    out = events.replayed(events.segments(_stream(spark, sf_dir), "user_id", "6 hours"), new_folder(spark, "streams"))
    return out.select("user_id", F.unix_millis("t_start").alias("t_start"), "n", F.round("total", 4).alias("total"))


@query(
    "stream_first_response",
    f"""WITH {EVENTS}, mark AS (SELECT least(max(t_ms) FILTER (event_type = 'view'), max(t_ms) FILTER (event_type = 'click')) - {LATE} - {HORIZON} AS t FROM e),
    a AS (SELECT event_id, user_id // 5 AS team, user_id AS x, user_id + 1 AS y, t_ms FROM e WHERE event_type = 'view' AND t_ms <= (SELECT t FROM mark)), r AS (SELECT event_id, user_id // 5 AS team, user_id AS who, t_ms FROM e WHERE event_type = 'click'),
    h AS (SELECT a.event_id, r.who, r.event_id AS rid, r.t_ms - a.t_ms AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY r.t_ms - a.t_ms, r.event_id) AS k FROM a JOIN r ON r.team = a.team AND r.t_ms BETWEEN a.t_ms AND a.t_ms + {HORIZON} AND r.who <> a.x AND r.who <> a.y)
    SELECT a.event_id AS anchor_id, h.rid AS response_id, h.who AS actor, h.d::BIGINT AS delay_ms FROM a LEFT JOIN h ON h.event_id = a.event_id AND h.k = 1""",
)
def stream_first_response(spark, sf_dir):
    """As first_response_excluding, of the anchors whose horizon the watermark has passed."""
    e, team = _stream(spark, sf_dir), F.floor(F.col("user_id") / 5)
    anchors = e.where("event_type = 'view'").select(F.col("event_id").alias("anchor_id"), team.alias("key"), F.col("ts").alias("a_ts"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("without"))
    responses = e.where("event_type = 'click'").select(F.col("event_id").alias("response_id"), team.alias("r_key"), F.col("user_id").alias("actor"), F.col("ts").alias("r_ts"))
    out = events.finished(events.first_responses(anchors, responses, f"{HORIZON // 1000} SECONDS", f"{LATE // 1000} seconds"), new_folder(spark, "streams"))
    return out.select("anchor_id", "response_id", "actor", (F.unix_millis("r_ts") - F.unix_millis("a_ts")).alias("delay_ms"))


def _held_sql(label: str, accepted: str, settled: str, held: str) -> str:
    """Held labels of rows up to the watermark whose runs are settled by then."""
    return f"""WITH {EVENTS}, l AS (SELECT *, {label} AS label FROM e WHERE t_ms <= (SELECT max(t_ms) - {LATE} FROM e)),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS k FROM l),
    c AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY k) AS run FROM (SELECT *, CASE WHEN k > 1 AND label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY k) THEN 1 ELSE 0 END AS ch FROM o)),
    n AS (SELECT user_id, run, any_value(label) AS label, count(*) AS n FROM c GROUP BY user_id, run),
    x AS (SELECT *, lead(label) OVER w AS next_label, lead(n) OVER w AS next_n, max(run) OVER (PARTITION BY user_id) AS last_run FROM n WINDOW w AS (PARTITION BY user_id ORDER BY run)),
    j AS (SELECT *, {accepted} AS accepted, {settled} AS settled FROM x),
    h AS (SELECT user_id, run, settled, last_value(CASE WHEN accepted THEN label END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run) AS held FROM j)
    SELECT c.event_id, c.user_id, c.label, {held} AS held FROM c JOIN h USING (user_id, run) WHERE h.settled"""


@query("stream_stable_path", _held_sql("event_type", "label IS NOT NULL AND (n >= 2 OR run = 0)", "n >= 2 OR run = 0 OR run < last_run OR label IS NULL", "held"))
def stream_stable_path(spark, sf_dir):
    """As stable_path, of the rows settled when the watermark stops."""
    with holding.state_on_disk(spark):
        return events.finished(holding.stable_path(_stream(spark, sf_dir), "user_id", "event_type", 2, f"{LATE // 1000} seconds"), new_folder(spark, "streams"))


_HOLDER = "CASE WHEN value >= 20 THEN event_type ELSE '-1' END"


@query(
    "stream_sticky_handler",
    _held_sql(
        _HOLDER,
        "n >= 2 OR (label <> '-1' AND coalesce(next_label = '-1' AND next_n >= 2, false))",
        "n >= 2 OR (run < last_run AND NOT (run + 1 = last_run AND label <> '-1' AND next_label = '-1' AND next_n < 2))",
        "coalesce(held, '-1')",
    ),
)
def stream_sticky_handler(spark, sf_dir):
    """Holders with a hold of two rows, a touch right before two rows of nobody counted, of the rows settled when the watermark stops."""
    stream = _stream(spark, sf_dir).withColumn("holder", F.expr(_HOLDER))
    with holding.state_on_disk(spark):
        return events.finished(holding.sticky_handler(stream, "user_id", "holder", 2, f"{LATE // 1000} seconds"), new_folder(spark, "streams"))
