"""Query op6; a fitted model is beyond SQL, so tests hold it against labels it has not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.llm.common import fold, table
from tracklane.llm.toxicity import score, train, training_labels


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
