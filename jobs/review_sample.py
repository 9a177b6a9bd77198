"""Draws the texts that people are to check against the labels (batch).

Categories of documents are conditions on the document and its labels; a
document can meet more than one, but is drawn for one only. Scarce categories
are served first, and no source gives more than its share, so the sample is not
one source's. Each row has the size of its category's pool and the weight with
which it counts when rates over the pools are estimated from the answers.

    python -m jobs.review_sample --documents PATH --labels PATH --out DIR [--config FILE] [--master local[8]]

Output: DIR, Parquet by category. The draw is by hashes of a seed and the
document's id, so a rerun gives the same rows; it replaces what is there.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import config
from tracklane.operators.sampling import disjoint_strata
from tracklane.session import build_session

log = logging.getLogger("jobs.review_sample")

CONFIG = Path(__file__).with_suffix(".json")
SETTINGS = {"seed": int, "group": str, "per_group": int, "categories": dict}
#: Fields of a document that conditions may name.
FIELDS = ("doc_id", "lang", "source", "n_chars")


def settings(path: str | Path = CONFIG) -> dict:
    held = config.load(path, SETTINGS)
    for name, c in held["categories"].items():
        if set(c) != {"where", "take"} or not isinstance(c["where"], str) or not isinstance(c["take"], int) or c["take"] < 0:
            raise ValueError(f"category {name} must have a condition `where` and a number `take`")
    if held["group"] not in FIELDS:
        raise ValueError(f"group must be one of {FIELDS}")
    return held


def candidates(documents: DataFrame, labels: DataFrame, conf: dict) -> DataFrame:
    """category, key and grp of each category that a document meets; a condition that is null is not met.

    Documents that repeat a label row count once, with the greatest of each label.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = documents.select(*FIELDS).where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    met = F.array_compact(F.array(*[F.when(F.expr(c["where"]), F.lit(name)) for name, c in sorted(conf["categories"].items())]))
    return rows.select(F.explode(met).alias("category"), F.col("doc_id").alias("key"), F.col(conf["group"]).alias("grp"))


def sample(documents: DataFrame, labels: DataFrame, conf: dict) -> DataFrame:
    """Rows of the sample: place in the category, document, pool and weight. Of documents that repeat an id the least row is shown."""
    takes = {name: c["take"] for name, c in conf["categories"].items()}
    picks = disjoint_strata(candidates(documents, labels, conf), takes, conf["per_group"], conf["seed"])
    taken = picks.groupBy("category").agg(F.count(F.lit(1)).alias("taken"))
    weighted = picks.join(F.broadcast(taken), "category").withColumn("weight", F.col("pool") / F.col("taken"))
    shown = documents.join(F.broadcast(picks.select(F.col("key").alias("doc_id"))), "doc_id", "left_semi")
    one = shown.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("d"))
    return weighted.join(one, F.col("key") == F.col("doc_id")).select("doc_id", "d.source", "d.lang", "d.n_chars", "d.text", "place", "pool", "weight", "category")


def run(spark: SparkSession, documents_path: str, labels_path: str, out: str, conf: dict) -> DataFrame:
    """Writes the sample below out and returns it read back."""
    documents, labels = spark.read.parquet(documents_path), spark.read.parquet(labels_path)
    found = sample(documents, labels, conf)
    found.repartition("category").write.mode("overwrite").partitionBy("category").parquet(out)
    back = spark.read.schema(found.schema).parquet(out)
    counts = {r.category: r for r in back.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.first("pool").alias("pool")).collect()}
    log.info("read %s documents of %s and %s labels of %s", documents.count(), documents_path, labels.count(), labels_path)
    for name, c in sorted(conf["categories"].items()):
        r = counts.get(name)
        log.info("%s: %s of %s asked for, from a pool of %s, written to %s", name, r.n if r else 0, c["take"], r.pool if r else 0, out)
    return back


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--documents", required=True)
    parser.add_argument("--labels", required=True)
    parser.add_argument("--out", required=True, help="folder of the sample, replaced by each run")
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--master")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = build_session("review_sample", given.master)
    try:
        run(spark, given.documents, given.labels, given.out, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
