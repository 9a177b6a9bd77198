import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracklane.llm import pitmanyor

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(n=200):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))).title()) for i in range(n)]


@pytest.mark.parametrize("head", [pitmanyor.HEAD_WORDS, 20])
def test_counts_and_base_score(make_docs, edges, monkeypatch, head):
    monkeypatch.setattr(pitmanyor, "HEAD_WORDS", head)
    rows = [(i, t) for i, t, *_ in edges if i is not None] + [(100 + i, t) for i, t in corpus()]
    docs = make_docs(rows, extra=False)
    out = pitmanyor.score(docs, pitmanyor.Model(pitmanyor.training_rows(docs))).collect()
    tokens = {k: WORD.findall((t or "").translate(LOWER)) + [None] for k, t in rows}
    counts = Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in tokens[k])
    total, kinds = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for r in out:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), abs=1e-6)
        assert r.score < 0
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.2 * sum(r.n_tokens for r in held)


def test_probabilities_add_up_to_one(make_docs):
    model = pitmanyor.Model(make_docs(corpus(60), extra=False))
    _, words, _, logs = model.head()
    assert len(words) == model.vocabulary
    assert np.allclose((10.0**logs).sum(axis=0) + model.unknown(), 1, atol=1e-5)


def test_seating_follows_the_chinese_restaurant():
    n = 4000
    c = np.full(n, 12)
    t = pitmanyor.seat(c, np.full(n, 0.8), 0.5, np.arange(n, dtype=np.uint64), np.zeros(n, np.int64), 0)
    mean = 1.0
    rng = np.random.default_rng(0)
    plain = []
    for _ in range(n):
        k = 1
        for i in range(1, 12):
            k += rng.random() < 0.8 / (0.8 + i - 0.5 * k)
        plain.append(k)
    assert abs(t.mean() - np.mean(plain)) < 0.1 and (t >= mean).all() and (t <= 12).all()
    large = pitmanyor.seat(np.array([0, 1, 100_000]), np.full(3, 0.8), 0.5, np.arange(3, dtype=np.uint64), np.zeros(3, np.int64), 0)
    assert large[0] == 0 and large[1] == 1 and 1 < large[2] < 5000


def test_no_training_documents(make_docs):
    docs = make_docs([(1, "a b"), (2, None)], extra=False)
    out = {r.doc_id: r for r in pitmanyor.score(docs, pitmanyor.Model(docs.where("false"))).collect()}
    assert (out[1].n_tokens, out[1].n_known, out[2].n_tokens) == (3, 0, 1)


def test_every_word_is_a_context_of_its_own(make_docs):
    """Fifty equally frequent words, each always followed by its own word: more contexts than any fixed few, each of which must tell its follower from others."""
    rows = [(i, " ".join(f"lead{(i + k) % 50} follow{(i + k) % 50}" for k in range(50))) for i in range(20)]
    model = pitmanyor.Model(make_docs(rows, extra=False))
    fit = [(100 + i, f"lead{i} follow{i}") for i in range(50)]
    off = [(200 + i, f"lead{i} follow{(i + 7) % 50}") for i in range(50)]
    out = {r.doc_id: r.score for r in pitmanyor.score(make_docs(fit + off, extra=False), model).collect()}
    assert all(out[100 + i] > out[200 + i] + 1 for i in range(50))


def test_unknown_contexts_and_words_back_off_to_the_parent(make_docs):
    model = pitmanyor.Model(make_docs(corpus(40), extra=False))
    r = pitmanyor.score(make_docs([(1, "never1 never2 never3")], extra=False), model).collect()[0]
    inner = np.mean([model.new_word(k) for k in range(pitmanyor.BURN_IN + 1, pitmanyor.BURN_IN + pitmanyor.SAMPLES + 1)])
    other = pitmanyor.score(make_docs([(1, "never1 never2")], extra=False), model).collect()[0]
    assert r.n_known == 1 and r.score - other.score == pytest.approx(math.log10(inner))
