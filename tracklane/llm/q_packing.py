"""Query op3; SQL has no tokenizer, so tests hold it against direct tokenisation."""

from __future__ import annotations

from tracklane.llm.common import table
from tracklane.llm.packing import pack, pieces


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_pack_sequences(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
