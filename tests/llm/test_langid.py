import random

import numpy as np

from tracklane.llm import langid


def texts(n):
    rng = random.Random(6)
    parts = {"en": ["th", "ing", "and", "er", "wh"], "de": ["sch", "ein", "ung", "zu", "ä"], "ja": ["の", "は", "する", "語", "日"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))), "s", lang) for i, lang in enumerate(rng.choices(list(parts), k=n))]


def test_held_out_accuracy(make_docs, edges):
    rows = texts(600)
    docs = make_docs(rows, extra=False)
    prototypes = langid.train(langid.training_rows(docs))
    assert set(prototypes) == {"en", "de", "ja"}
    out = {r.doc_id: r for r in langid.identify(docs, prototypes).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, _, lang in rows]) > 0.98
    blank = langid.identify(make_docs([*edges, (77, "123 --- !")], extra=False), prototypes).collect()
    assert {r.doc_id for r in blank if r.lang_pred == "und"} == {1, 2, 3, 77}
    assert all(0 <= r.score <= 1 for r in [*out.values(), *blank])


def test_bundle_is_the_sum_of_bound_letters():
    rng = np.random.default_rng(20240229)
    letters = rng.integers(0, 2, (langid.SYMBOLS, langid.DIMENSIONS), dtype=np.int8) * 2 - 1
    vectors, n = langid.bundles(["abca", "", "A-b"])
    gram = lambda a, b, c: np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert np.array_equal(vectors[0], gram(1, 2, 3) + gram(2, 3, 1))
    assert not vectors[1].any() and n.tolist() == [4, 0, 2]
    assert np.array_equal(vectors[2], gram(1, 0, 2))


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "text")], extra=False)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, {}).collect()] == [("und", 0.0)]
    assert langid.train(make_docs([], extra=False)) == {}
