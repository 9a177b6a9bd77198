"""Query op8 and its SQL, which compares all pairs of vectors."""

from __future__ import annotations

from tracklane.llm.common import table
from tracklane.llm.embeddup import near_vectors


def op8_embedding_neardup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN component c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
