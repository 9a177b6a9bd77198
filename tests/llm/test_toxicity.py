import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracklane.llm import boosting, toxicity


@pytest.fixture(scope="module")
def corpus():
    """Toxic texts hold words of one stem with many endings; clean ones never do."""
    rng = random.Random(8)
    words = ["".join(rng.choice(["an", "the", "er", "in", "or", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    endings = ["ing", "ed", "s", "ly", "er", "ow", "ish", "an", "um", "ak"]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text[rng.randrange(len(text))] = rng.choice(["vrotkel", "smurag"]) + rng.choice(endings)
        rows.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, corpus, edges):
    rows, labels = corpus
    label_rows = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    chosen = toxicity.training_labels(label_rows)
    assert not held & {r.doc_id for r in chosen.collect()}
    docs = make_docs(rows + [(10_000 + k, t) for k, (_, t, *_) in enumerate(edges)])
    model = toxicity.train(docs.drop("score"), chosen)
    out = {r.doc_id: r for r in toxicity.score(docs.drop("score"), model).collect()}
    truth = dict(labels)
    found = [out[i].predicted for i in held if truth[i]]
    wrong = [out[i].predicted for i in held if not truth[i]]
    assert np.mean(found) > 0.9 and np.mean(wrong) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in out.values())
    assert not any(out[10_000 + k].predicted for k in range(len(edges)))


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs([(1, "a"), (2, None)], extra=False)
    assert toxicity.train(docs, none) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score(make_docs([], extra=False), None).count() == 0


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 8, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    at, value = boosting.isotonic(x, y)
    fitted = np.interp(x, at, value)
    assert (np.diff(value) >= -1e-12).all()
    levels = np.unique(x)
    means = np.array([y[x == v].mean() for v in levels])
    weights = np.array([(x == v).sum() for v in levels])
    best = [max(min(np.average(means[i : j + 1], weights=weights[i : j + 1]) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))]
    assert np.allclose(fitted, [best[int(np.searchsorted(levels, v))] for v in x])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.Trees.fit(x[:600], y[:600])
    assert ((trees.margin(x[600:]) > 0) == y[600:]).mean() > 0.95


def test_a_common_opening_makes_no_copies():
    """Toxic texts that all begin with the same words still teach the lexicon; real copies count once."""
    rng = random.Random(5)
    other = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    texts = [f"you are a {other()} vrotkel {other()}" for _ in range(30)] + [f"you are a {other()}" for _ in range(90)]
    toxic = np.array([1.0] * 30 + [0.0] * 90)
    lexicon = toxicity.Model(toxicity.fit(pa.array(texts), toxic)).lexicon
    own = toxicity.terms(toxicity.Words(pa.array(["vrotkel"])))[0]
    assert lexicon.look_up(own)[0] > toxicity.LEAST_WEIGHT
    _, at = np.unique(toxicity.copies(shingle_sets([texts[0], texts[1], texts[0], texts[0] + " end", "", ""])), return_index=True)
    assert at.tolist() == [0, 1, 4, 5]


def shingle_sets(texts):
    values, at = toxicity.shingles(toxicity.Words(pa.array(texts)))
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def test_a_huge_text_does_not_end_the_sample(spark, make_docs, corpus):
    """Texts above their share are passed over; the rest are learned from, rows that repeat an id once."""
    rows, labels = corpus
    first = min((i for i, _ in rows), key=lambda i: i)
    docs = make_docs([(i, t * 2000 if i == first else t) for i, t in rows[:300]] * 2, extra=False)
    chosen = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    limit = sum(len(t) for _, t in rows[:300])
    model = toxicity.train(docs, chosen, fit_bytes=limit)
    assert model is not None
    found = {r.doc_id: r.predicted for r in toxicity.score(make_docs(rows[300:], extra=False), model).collect()}
    truth = dict(labels)
    assert np.mean([found[i] for i in found if truth[i]]) > 0.7 and np.mean([found[i] for i in found if not truth[i]]) < 0.05
