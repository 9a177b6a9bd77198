"""Query op2 and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.llm.common import table
from tracklane.llm.mixing import fair_queue


def op2_mix_sources(spark, sf_dir):
    queue = fair_queue(table(spark, sf_dir, "documents"))
    taken = F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + F.when(x["virtual_start"] < 1, x["served"]).otherwise(0))  # the schedule's cut
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "virtual_finish").orderBy("virtual_finish", "doc_id", "size").drop("virtual_finish")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS h
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, source IS NULL, source)),
targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - source_size - start)))::BIGINT AS taken
FROM queued
"""
