"""Query op12 and its SQL, which compares every vector with every centroid in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklane.llm.centroids import CLUSTERS, DIMENSIONS, LARGEST, ROUNDS, SCALE, SEED, clusters
from tracklane.llm.common import table


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def sql() -> str:
    """All rounds, one common table expression for the assignment and one for the centroids of each."""
    apart = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, q, best.n AS cluster, best.d AS distance
  FROM (SELECT v.rid, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min({{'d': {apart}, 'n': c.n}}) AS best FROM v, c{r} c GROUP BY v.rid))""")
        if r < ROUNDS:
            rounds.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.q, c.q) AS q
  FROM c{r} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
    FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster) m ON m.cluster = c.n)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND {SCALE} * x::DOUBLE >= -{LARGEST} AND {SCALE} * x::DOUBLE < {LARGEST})) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS n, q
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {CLUSTERS})),{",".join(rounds)}
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance,
       sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.n = a.cluster
"""
