"""Licence scans by canonical digests, in DataFrame operations.

A text is brought into canonical form: lower case, copyright lines out,
equivalent spellings made one, punctuation and white space to single blanks.
The digest of the whole form is joined with the digests of known licence texts
and notices, a table of fixed size. Each line is looked up by its digest too,
so notices within longer texts are found. One pass, without a shuffle.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: Applied in this order to lower-case text; the patterns mean the same to Java, RE2 and Python's regex.
STEPS = (
    (r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©)?[ \t]*([0-9<\[{]|by )[^\n]*", "\n"),
    (r"(^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*", "\n"),
    (r"licenc", "licens"),
    (r"sub-licens", "sublicens"),
    (r"organis", "organiz"),
    (r"acknowledgem", "acknowledgm"),
    (r"non-?infring", "noninfring"),
    (r"https?://(www\.)?", ""),
    (r"&", " and "),
    (r"[^\p{L}\p{N}]+", " "),
)

def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def canonical_text(text: str) -> str:
    out = text.lower()
    for pattern, new in STEPS:
        out = regex.sub(pattern, new, out)
    return out.strip(" ")


@lru_cache(maxsize=1)
def known_digests() -> dict[str, str]:
    """SPDX identifier by sha256 of the canonical form."""
    return {d: spdx for spdx, d in DIGESTS} | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): spdx for spdx, t in reversed([*TEXTS, *NOTICES])}


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, canonical_sha256, license (of the whole text, or null), n_notices, notices (licences of lines, sorted, comma-joined).

    Null text counts as empty; a text whose canonical form is empty has no
    licence. Rows that repeat are scanned each on its own.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(known_digests().items()), "canonical_sha256 string, license string")
    names = F.create_map(*[F.lit(x) for pair in sorted(known_digests().items()) for x in pair])
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    found = F.filter(F.transform(lines, lambda x: F.element_at(names, F.sha2(canonical(x).cast("binary"), 256))), lambda x: x.isNotNull())
    scanned = docs.select("doc_id", F.sha2(canonical(text).cast("binary"), 256).alias("canonical_sha256"), found.alias("found"))
    return scanned.join(F.broadcast(known), "canonical_sha256", "left").select(  # a row for each known form
        "doc_id", "canonical_sha256", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.sort_array(F.array_distinct("found")), ",").alias("notices")
    )
