"""The jobs as queries: each runs twice into a new folder and gives the whole output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import response_log, review_sample
from tracklane.plans.registry import EVENTS, Registry
from tracklane.sources.shared import new_folder

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _response_sql(conf: dict) -> str:
    horizon, late = conf["horizon_seconds"] * 1000, conf["late_seconds"] * 1000
    return f"""WITH {EVENTS}, mark AS (SELECT max(t_ms) - {late + horizon} AS t FROM e),
    a AS (SELECT event_id, user_id // 5 AS key, user_id AS x, user_id + 1 AS y, t_ms FROM e WHERE event_type = 'view' AND t_ms <= (SELECT t FROM mark)),
    r AS (SELECT event_id, user_id // 5 AS key, user_id AS who, t_ms FROM e WHERE event_type = 'click'),
    h AS (SELECT a.event_id, r.who, r.event_id AS rid, r.t_ms - a.t_ms AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY r.t_ms, r.event_id) AS k
          FROM a JOIN r ON r.key = a.key AND r.t_ms BETWEEN a.t_ms AND a.t_ms + {horizon} AND r.who <> a.x AND r.who <> a.y)
    SELECT a.event_id AS anchor_id, a.key::BIGINT AS key, a.t_ms::BIGINT AS at_ms, h.rid AS response_id, h.who AS actor, h.d::BIGINT AS delay_ms, strftime(make_timestamp(a.t_ms * 1000), '%Y-%m-%d') AS day
    FROM a LEFT JOIN h ON h.event_id = a.event_id AND h.k = 1"""


@query("job1_response_log", _response_sql(response_log.settings()))
def job1_response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file and leaves the log as it is."""
    out, conf = new_folder(spark, "response_log"), response_log.settings()
    response_log.run(spark, f"{sf_dir}/events.parquet", out, conf)
    return response_log.run(spark, f"{sf_dir}/events.parquet", out, conf)


def _sample_sql(conf: dict) -> str:
    """One step for each category; which one a step serves is looked up by the sizes of the pools."""
    met = " UNION ALL ".join(f"SELECT doc_id, grp, '{name}' AS category FROM d WHERE {c['where']}" for name, c in conf["categories"].items())
    takes = ", ".join(f"('{name}', {c['take']})" for name, c in conf["categories"].items())
    steps, all_picks = [], "SELECT NULL::BIGINT AS doc_id, NULL::VARCHAR AS grp, NULL::VARCHAR AS category, 0 AS place WHERE false"
    for i in range(1, len(conf["categories"]) + 1):
        steps.append(f"""
    p{i} AS MATERIALIZED (
      SELECT doc_id, grp, category, row_number() OVER (ORDER BY draw, doc_id) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY draw, doc_id) AS nth
            FROM c WHERE pos = {i} AND doc_id NOT IN (SELECT doc_id FROM ({all_picks}))) f
      WHERE nth + (SELECT count(*) FROM ({all_picks}) u WHERE u.grp IS NOT DISTINCT FROM f.grp) <= {conf["per_group"]}
      QUALIFY place <= (SELECT take FROM ord WHERE pos = {i}))""")
        all_picks += f" UNION ALL SELECT doc_id, grp, category, place FROM p{i}"
    return f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, lang, source, n_chars, {conf["group"]} AS grp, quality, toxic FROM documents LEFT JOIN l USING (doc_id) WHERE doc_id IS NOT NULL),
    met AS (SELECT category, doc_id, min(grp) AS grp FROM ({met}) GROUP BY ALL),
    pools AS (SELECT category, count(*) AS pool FROM met GROUP BY category),
    ord AS (SELECT category, pool, take, row_number() OVER (ORDER BY pool, category) AS pos FROM pools JOIN (VALUES {takes}) t(category, take) USING (category)),
    c AS (SELECT met.*, pos, md5('{conf["seed"]}:' || category || ':' || doc_id) AS draw FROM met JOIN ord USING (category)),{",".join(steps)},
    picks AS ({all_picks})
    SELECT p.doc_id, x.source, x.lang, x.n_chars, x.text, p.place::INTEGER AS place, pool::BIGINT AS pool, pool::DOUBLE / count(*) OVER (PARTITION BY category) AS weight, category
    FROM picks p JOIN ord USING (category) JOIN documents x ON x.doc_id = p.doc_id"""


@query("job2_review_sample", _sample_sql(review_sample.settings()))
def job2_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the sample by the same rows."""
    out, conf = new_folder(spark, "review_sample"), review_sample.settings()
    for _ in range(2):
        found = review_sample.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, conf)
    return found
