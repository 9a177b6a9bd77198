import random
import zlib

import numpy as np
import pytest

from tracklane.llm import packing
from tracklane.llm.q_packing import tokenizer_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(5)
    alphabet = list("abcXYZ.,!?'\"<|>-_0189 \t\n\r\x0b\x0c\x1c\x85éÉßıİΣσς́̈ﬁ—中文कि😀  ") + ["<|endoftext|>", "'s", "'LL ", "İ", "don't", "ΟΔΟΣ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    encoder = packing.WordEncoder(tokenizer_path())
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_keeps_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.WordEncoder(tokenizer_path())
    for text in ["one two three four", "five six seven", "one two, eight. nine TEN", "one one one", "a b c d e f g h i j"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in chosen)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)


def check(rows, texts, tokenizer, capacity):
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id is None, doc_id or 0, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(expected)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    end = {}
    for s, offset, length in places:
        assert offset == end.get(s, 0)
        end[s] = offset + length
    assert all(v <= capacity for v in end.values())
    return len(end)


def test_pack_round_trip(make_docs, edges, tokenizer):
    docs = make_docs(edges)
    rows = packing.pack(packing.pieces(docs, tokenizer_path(), 64), 64).collect()
    n = check(rows, [(e[0], e[1]) for e in edges], tokenizer, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 1


def test_sequences_hold_the_ids(make_docs, tokenizer):
    texts = [(i, f"document number {i} " * (i % 9)) for i in range(40)]
    packed = packing.pack(packing.pieces(make_docs(texts), tokenizer_path(), 32, with_ids=True), 32)
    rows = packed.collect()
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(packed).collect()}
    for r in rows:
        assert np.array_equal(whole[r.sequence_id][r.offset : r.offset + r.length], np.frombuffer(bytes(r.ids), "<u4"))


def test_empty(make_docs):
    assert packing.pack(packing.pieces(make_docs([]), tokenizer_path())).count() == 0
