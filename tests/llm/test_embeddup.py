import numpy as np
import pytest

from tracklane.llm import embeddup


def plain(rows):
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v) or i is None else np.array(v, float) for i, v in rows]
    n = len(rows)
    linked = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.95 for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            u = queue.pop()
            for v in range(n):
                if linked[u][v] and v not in seen:
                    seen.add(v)
                    queue.append(v)
        out.append((rows[i][0], int(sum(linked[i])), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddup, "CLUSTER_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(15):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows) * 7 % 1009, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.2])).astype(np.float32).tolist()))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[0][1]), (2002, [2 * v for v in rows[0][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + rows[1][1][1:]), (3005, rows[0][1][:8]), (3006, rows[0][1][:8]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, root int, rep int")
    got = sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddup.near_vectors(df).collect())))
    assert got == sorted(map(str, ((a, b, c, a == c) for a, b, c in plain(rows))))


def test_empty(spark):
    assert embeddup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passes_grow_with_the_classes():
    for n in (1, 10, 50_000, 5_000_000, 50_000_000):
        bits, passes = embeddup.plan(n)
        assert passes >= embeddup.PASSES and (1 - 0.899**bits) ** passes < 1.05e-4


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_recall_of_pairs_at_the_threshold(spark, n):
    """Pairs at cosine 0.95 to 0.96 among vectors that are far from all others."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n // 2):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = rng.uniform(0.951, 0.96)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    out = embeddup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert np.mean([r.n_links >= 1 for r in out]) >= 0.99


def test_windows_cross_partitions(spark):
    """One sorted run over many small partitions: every row meets its next WINDOW neighbours."""
    rows = [(0, k, k, bytes(32)) for k in range(400)]
    entries = spark.createDataFrame(rows, "part long, key long, rep long, sketch binary").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = embeddup.window_links(entries, 0).cache()
        assert found.where("task is not null").select("task").distinct().count() > 4
        inner = embeddup.components(found.where("a is not null").select("a", "b")).select("root").distinct().count()
        both = embeddup.components(found.where("a is not null").select("a", "b").union(embeddup.border_links(found))).select("root").distinct().count()
        assert inner > 4 and both == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_dense_run_is_compared_whole(spark):
    """More vectors within one cone than a window holds."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(300)]
    out = embeddup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component_id for r in out} == {0} and {r.n_links for r in out} == {299}
