"""Query op10; tests hold it against languages of documents it has not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.llm.common import fold, table
from tracklane.llm.langid import identify, train, training_rows


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = train(training_rows(docs.select("doc_id", "text", "lang")))
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
