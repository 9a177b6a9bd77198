"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order. A document's
virtual finish time is the cumulative tokens of its source divided by the
source's target; when a queue ends it starts again, until `max_repeats`, and
each pass through a document is an entry of its own with its own time. Time 1
is where the total budget is spent, since the targets add up to it: all entries
that finish by then are taken whole, and of those in service, one of each
source, the words served until then. The schedule is all entries that have
started by time 1, range-sorted by virtual finish time: it ends at the budget.

A source of any size is spread over hash buckets (see common.running_sum). What
is shuffled are identifiers, sizes and hashes, and what the caller carries:
mixed_documents carries whole rows, once to the buckets and once to the range
sort. One row per source meets in one task, to rank the sources and to share
out the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.llm.common import buckets_for, hash_bucket, running_sum, staged, word_count

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words per source, from one row per source (no_source, source_key, source_size).

    Weights repeat over the sources in code-point order, null last. Targets are
    in proportion to weight, but stop at max_repeats times the source's size;
    the excess is shared again by weight. With the sources in order of cap to
    weight, the water level is the largest of (budget - caps before) / (weights
    from here on), which is reached at the first source that is not full.
    """
    rank = F.row_number().over(Window.orderBy("no_source", "source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    all_rows = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(all_rows))
        .select("no_source", "source_key", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def fair_queue(
    docs: DataFrame,
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    share: float = BUDGET_SHARE,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, virtual_finish (of its first pass), taken, entries, then `carry`.

    entries: pass, virtual_start, virtual_finish and words served of each pass through the document; taken is their sum.

    The order in a queue is that of md5 of doc_id, then doc_id, then size, so
    reruns agree; equal rows may stand for one another. Null text has size 0 and
    takes nothing, as does a source without words (its virtual_finish is null).
    A null doc_id counts as empty text in the hash. An empty table gives an
    empty result. Other columns of docs are not touched.
    """
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16)
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.col("source").isNull().alias("no_source"),
        digest.alias("h"),
        word_count(F.col("text")).alias("size"),
        F.struct(*carry).alias("payload") if carry else F.lit(None).cast("int").alias("payload"),
    )
    sizes = staged(rows.drop("payload"), "sizes")
    buckets = buckets_for(sizes.count())
    group = ["no_source", "source_key"]
    per_source = targets(sizes.groupBy(*group).agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    queued = running_sum((rows if carry else sizes).withColumn("bucket", hash_bucket(F.col("h"), buckets)), group, "bucket", ["h", "doc_id", "size"], "size", "through")
    start = F.col("through") - F.col("size")

    def entry(e: int) -> Column:
        began, ends = start + F.col("source_size") * e, F.col("through") + F.col("source_size") * e
        served = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - began))
        time = F.nullif(F.col("target"), F.lit(0.0))
        return F.struct(F.lit(e).alias("pass"), (began / time).alias("virtual_start"), (ends / time).alias("virtual_finish"), served.alias("served"))

    entries = F.array(*[entry(e) for e in range(max_repeats)])
    return (
        queued.join(per_source, group)
        .withColumn("entries", entries)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.col("entries")[0]["virtual_finish"].alias("virtual_finish"),
            F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["served"]).alias("taken"),
            "entries",
            *([F.col("payload")] if carry else []),
        )
    )


def schedule(docs: DataFrame, carry: Sequence[str] = (), **options) -> DataFrame:
    """The entries of the mix in the order of virtual finish time, cut at the total budget.

    One row for each document and pass that has started by then: fair_queue's
    columns but for `entries`, and pass, virtual_start, virtual_finish, served.
    """
    queue = fair_queue(docs, carry, **options)
    rows = queue.drop("virtual_finish").withColumn("entry", F.explode("entries")).drop("entries").select("*", "entry.*").drop("entry")
    return rows.where((F.col("virtual_start") < 1) & (F.col("served") > 0)).orderBy("virtual_finish", "doc_id", "size", "pass")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs as often as the mix takes them, in mixing order, with docs' columns.

    A document is given whole, at the time of each pass of which at least half
    of its words are served. Documents without words are dropped; null ids and
    repeated rows are given like others.
    """
    return schedule(docs, carry=docs.columns, **options).where(2 * F.col("served") >= F.col("size")).select("payload.*")
