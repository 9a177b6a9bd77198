from collections import defaultdict

import pytest

from tracklane.llm import mixing


def spread(sizes, weights=(5, 2, 1), share=1.5):
    """Water filling by repeated sharing: the plain form of the targets."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= unit * weight[s]}
        if not full:
            for s in open_:
                target[s] = unit * weight[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_taken(make_docs):
    rows = [(i, "w " * (1 + i % 17), None if i % 7 == 0 else f"s{i % 5}") for i in range(400)]
    got = mixing.fair_queue(make_docs(rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = spread(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in expected)


def test_edges_and_reruns(make_docs, edges):
    docs = make_docs(edges)
    one, two = (sorted(map(str, mixing.fair_queue(docs).collect())) for _ in range(2))
    assert one == two and len(one) == len(edges)
    assert all(r.taken == 0 for r in mixing.fair_queue(docs).collect() if r["size"] == 0)
    assert mixing.fair_queue(make_docs([])).count() == 0
    assert mixing.fair_queue(make_docs([(1, ""), (2, None)])).where("taken > 0").count() == 0


def test_mixed_documents_keep_columns_and_order(make_docs):
    docs = make_docs([(i, "a b c d", f"s{i % 3}") for i in range(60)])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    per_id = out.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in per_id) <= 2 and 80 <= out.count() <= 100


def test_each_pass_has_its_own_time(make_docs):
    docs = make_docs([(i, "a b c d", f"s{i % 3}") for i in range(300)])
    entries = mixing.schedule(docs).collect()
    times = [r.virtual_finish for r in entries]
    assert times == sorted(times) and all(r.virtual_start < 1 for r in entries)
    total, budget = sum(r.served for r in entries), 1.5 * 1200
    assert abs(total - budget) <= 3 and sum(r.served for r in entries if r.virtual_finish > 1) < 3 * 4
    order = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    again = {i for i in order if order.count(i) > 1}
    side_by_side = sum(a == b for a, b in zip(order, order[1:]))
    assert len(again) > 100 and side_by_side == 0
