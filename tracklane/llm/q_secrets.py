"""Query op1; its guess cost is beyond SQL, so tests hold it against plain pattern scans and brute force."""

from __future__ import annotations

from tracklane.llm.common import table
from tracklane.llm.q_packing import tokenizer_path
from tracklane.llm.secrets import corpus_words, scan


def op1_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, tokenizer_path(), corpus_words(docs))
