"""Query op7 and its SQL."""

from __future__ import annotations

from tracklane.llm.common import table
from tracklane.llm.licenses import STEPS, known_digests, scan


def op7_license_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')".replace("'\n'", "chr(10)")
    return f"trim({out}, ' ')"


def sql() -> str:
    values = ", ".join(f"('{d}', '{spdx}')" for d, spdx in sorted(known_digests().items()))
    return rf"""
WITH known(digest, license) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
line AS (
  SELECT rid, sha256({_canonical("l")}) AS digest
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
found AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM line JOIN known USING (digest) GROUP BY rid),
whole AS (SELECT rid, doc_id, sha256({_canonical("t")}) AS canonical_sha256 FROM d)
SELECT doc_id, canonical_sha256, license, coalesce(n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN found USING (rid)
"""
