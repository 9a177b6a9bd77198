"""Query op9 and its SQL."""

from __future__ import annotations

from tracklane.llm.common import table
from tracklane.llm.quality import judged, measure

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_quality_rules(spark, sf_dir):
    return judged(measure(table(spark, sf_dir, "documents"))).select(*COLUMNS)


def quality_rules_low_limit(spark, sf_dir):
    """As op9, with lines in more than two documents of their host removed, so that small tables have rejections too."""
    return judged(measure(table(spark, sf_dir, "documents")), min_docs=2).select(*COLUMNS)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS win
  FROM (SELECT rid, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
repeats AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM repeats) GROUP BY rid),
line AS (
  SELECT rid, source, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(regexp_replace(regexp_replace(lower(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS norm
  FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY rid),
frequent AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT rid) AS line_docs FROM line GROUP BY source, norm) WHERE line_docs > 20),
lost AS (
  SELECT l.rid, sum(l.n) AS removed_words FROM line l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.rid),
base AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)),
tested AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 5 AND n_words - removed_words >= n_words * 0.5::DOUBLE AS kept
FROM tested
"""
LOW_LIMIT_SQL = SQL.replace("line_docs > 20", "line_docs > 2")
