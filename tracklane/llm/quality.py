"""Quality rules: base counts of a text, and cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, digits to 0, white space to single blanks)
and hashed. Per host (the `source` column), the documents that hold a line are
counted; lines above the host's limit are removed, and documents that lose too
many of their words are rejected. The texts themselves are read once and never
shuffled: what moves is a hash and a count per line. Counting is pre-aggregated
before its shuffle; the join back is with the lines above the limit only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import SPACE, WORD, staged

#: A line is too frequent on a host if it is in more than this number of its documents, however large the host.
LINE_MIN_DOCS = 20
#: A document is depleted if fewer words are left than either of these asks for.
LEAST_WORDS = 5
#: Parts that the rows of one line are dealt to when they meet the frequent lines.
SALTS = 16
LEAST_SHARE = 0.5

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more; sorts (hash, place) pairs."""

    def marked(pairs: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))

    def span(places: Column) -> Column:
        steps = F.transform(places, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(pairs, marked), span)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 5-word window found twice or more in the array, first windows included."""
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    windows = let(
        hashed,
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return let(windows, lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0).cast("long")).otherwise(_covered(w)))


def with_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_hash(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), SPACE, " ")
    return F.xxhash64(F.regexp_replace(plain, "[0-9]", "0"))


def measure(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Base counts of each row, its host and its hashed lines, staged: one row per row of docs, with a row id.

    Null text counts as empty; a null host is a host of its own. Rows count each
    as a document of its own, whatever their ids: null and repeated ones too.
    Other columns of docs are not touched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), with_word)
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        F.col("source").isNull().alias("no_host"),
        counted.alias("counted"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), F.size(F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(0))).alias("n"))).alias("lines"),
        *([F.col("text")] if with_text else []),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = rows.select("*", "counted.*").drop("counted").withColumn("base_failed", failed).withColumn("row_id", F.monotonically_increasing_id())
    return staged(measured, "measured")


def frequent_lines(measured: DataFrame, min_docs: int = LINE_MIN_DOCS) -> DataFrame:
    """(no_host, host, h) of lines in more than min_docs documents of their host."""
    distinct = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    counts = measured.select("no_host", "host", F.explode(distinct).alias("h")).groupBy("no_host", "host", "h").agg(F.count(F.lit(1)).alias("line_docs"))
    return counts.where(F.col("line_docs") > min_docs).select("no_host", "host", "h")


def judged(measured: DataFrame, min_docs: int = LINE_MIN_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """measured with removed_words and kept; kept is false where base_failed, else false for depleted documents."""
    each = measured.select("row_id", "no_host", "host", F.explode("lines").alias("line")).select("row_id", "no_host", "host", "line.h", "line.n", F.pmod("row_id", F.lit(SALTS)).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lost = each.join(frequent_lines(measured, min_docs).select("*", salts), ["no_host", "host", "h", "salt"]).groupBy("row_id").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        measured.join(lost, "row_id", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (left >= least_words) & (left >= F.col("n_words") * least_share))
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and text of the documents kept, with too frequent lines taken out."""
    rows = judged(measure(docs, with_text=True), **limits).where("kept")
    held = F.coalesce("removed", F.array().cast("array<bigint>"))
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(with_word(x) & F.array_contains(held, line_hash(x)))), "\n")
    return rows.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(text).alias("text"))
