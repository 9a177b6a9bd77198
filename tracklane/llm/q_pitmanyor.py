"""Query op5; sampling is beyond SQL, so tests hold its counts and base scores against plain Python, and its probabilities against their sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.llm.common import fold, table
from tracklane.llm.pitmanyor import Model, score, training_rows


def op5_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, Model(training_rows(docs)))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
