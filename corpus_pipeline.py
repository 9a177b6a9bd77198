"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a
DataFrame; all but the last return the columns of documents. Between stages the
result is written as Parquet and read again, so no stage repeats another's work
and a lost executor costs only the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import mixing, neardup, packing, secrets, toxicity
from tracklane.llm.common import staged, table
from tracklane.llm.q_packing import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model learns from the labels of folds 0 and 2.

    Every row is judged by its own text, with repeated and null ids too; null
    and empty texts score like a text without words. Without labels all stay.
    """
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, score_col="__toxic_score", predicted_col="__toxic")
    return scored.where("`__toxic` = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id (a null one is greater than all others).

    Each row is judged by its own text, whatever its id: of rows that repeat an
    id, those whose texts resemble nothing else all stay. Rows without words stay.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id")
    if odd.isEmpty():
        gone = neardup.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    top = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    marked = rows.join(odd.withColumnRenamed("doc_id", "__odd"), F.col("doc_id").eqNullSafe(F.col("__odd")), "left")
    own = F.when(F.col("doc_id").isNull() | F.col("__odd").isNotNull(), F.lit(top) + 1 + F.col("__row")).otherwise(F.col("doc_id"))
    keyed = staged(marked.select("doc_id", "__row", own.alias("__key"), "text"), "keyed")
    judged = neardup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = judged.select(F.col("doc_id").alias("__key"), "component_id").join(keyed.drop("text"), "__key").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets replaced in their texts; null texts and ids stay null."""
    return secrets.redact(docs, vocabulary=tokenizer_path(), ranked=secrets.corpus_words(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in mixing order; null sources are one source, texts without words go."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces of all documents, ids included, with their places in sequences; a null id stays null."""
    return packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=True, idle_seconds=1.0, cached_words=100_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", hide_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A fitted model, a tokenizer and a packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
