import random
import re

from tracklane.llm import neardup
from tracklane.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return [(doc_id, len(s[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]


def compare(make_docs, rows):
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(make_docs(rows)).collect())))
    assert got == sorted(map(str, ((a, b, c, a == c) for a, b, c in plain(rows))))


def test_families_against_all_pairs(make_docs):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for family in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(2, 120))]
        for _ in range(rng.randint(1, 14)):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0.0, 0.02, 0.05, 0.09]) else w for w in text]
            rows.append((len(rows) * 3 % 1009, " ".join(own).title() if rng.random() < 0.5 else "  ".join(own)))
    compare(make_docs, rows)


def test_blocks_lose_no_link(make_docs, monkeypatch):
    rng = random.Random(12)
    text = [f"w{rng.randint(0, 900)}" for _ in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.04 else f"v{rng.randint(0, 900)}" for w in text)) for i in range(60)]
    monkeypatch.setattr(neardup, "ENTRY_BLOCK", 8)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 8)
    compare(make_docs, rows)


def test_edges(make_docs, edges):
    compare(make_docs, [e for e in edges if e[0] is not None])
    out = neardup.near_duplicates(make_docs(edges)).where("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in out] == [(None, True)]
    assert neardup.near_duplicates(make_docs([])).count() == 0


def test_signatures_meet_at_any_distance_below_twice_the_chunks(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    one = rng.integers(0, 256, (200, neardup.SIGNATURE), dtype=np.uint8)
    two = one.copy()
    for row in two:
        places = rng.choice(neardup.SIGNATURE, 2 * neardup.CHUNKS - 1, replace=False)
        row[places] += 1
    entries = []
    for m in (one, two):
        df = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(m)], "rep long, signature binary")
        entries.append({(r.rep, r.entry) for r in neardup.index_entries(df).collect()})
    assert {i for i, _ in entries[0] & entries[1]} == set(range(200))
    assert pa.__version__


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 400) if i % 50 != 49] + [(7, 7), (300, 10)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    root = lambda i: i // 50 * 50 if i // 50 not in (0, 6) else 0
    assert got == {i: root(i) for i in range(0, 400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
