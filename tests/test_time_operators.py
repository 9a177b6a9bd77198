"""As-of, interval and island operators against plain loops, with nulls, ties, repeats and empty inputs."""

import random

from pyspark.sql import functions as F

from tracklane.operators import asof, interval, islands, stats

KEYED = "id long, k long, t long"


def rows(n, seed, keys=4, span=60):
    rng = random.Random(seed)
    out = [(i, rng.choice([None, *range(keys)]) if rng.random() < 0.1 else rng.randrange(keys), rng.randrange(span)) for i in range(n)]
    return out + [(n, 0, None)]


def nearest(left, right, tolerance=None):
    out = {}
    for i, k, t in left:
        near = [(abs(rt - t), rt, ri) for ri, rk, rt in right if k is not None and k == rk and t is not None and rt is not None and (tolerance is None or abs(rt - t) <= tolerance)]
        out[i] = min(near)[1:] if near else (None, None)
    return out


def test_nearest_within(spark):
    left, right = rows(80, 1), rows(60, 2)
    got = asof.nearest_within(spark.createDataFrame(left, KEYED), spark.createDataFrame(right, KEYED), ["k"], 5).collect()
    expected = nearest(left, right, 5)
    assert len(got) == len(left) and all((r.r_t, r.r_id) == expected[r.id] for r in got)


def test_nearest_sample(spark):
    left, right = rows(80, 5), [r for r in rows(60, 6) if r[1] is not None and r[2] is not None]
    samples = spark.createDataFrame(right, KEYED).groupBy("k").agg(F.collect_list(F.struct("t", "id")).alias("samples"))
    met = spark.createDataFrame(left, KEYED).join(samples, "k", "left").select("id", asof.nearest_sample(F.col("samples"), F.col("t"), 5).alias("near"))
    got, expected = met.select("id", F.col("near.t").alias("r_t"), F.col("near.id").alias("r_id")).collect(), nearest(left, right, 5)
    assert len(got) == len(left) and all((r.r_t, r.r_id) == expected[r.id] for r in got)


def test_nearest_by_group(spark):
    left, right = [r for r in rows(80, 3) if r[1] is not None], [r for r in rows(20, 4) if r[1] is not None and r[2] is not None]
    got = asof.nearest_by_group(spark.createDataFrame(left, KEYED), spark.createDataFrame(right, KEYED), ["k"]).collect()
    expected = nearest(left, right)
    assert all((r.r_t, r.r_id) == expected[r.id] for r in got) and len(got) == len(left) - 1  # the row without a time
    assert asof.nearest_by_group(spark.createDataFrame([], KEYED), spark.createDataFrame(right, KEYED), ["k"]).count() == 0


def test_first_after_anchor(spark):
    a = spark.createDataFrame(rows(50, 5), "anchor_id long, key long, t_ms long")
    r = rows(50, 6)
    got = interval.first_after_anchor(a, spark.createDataFrame(r, "response_id long, key long, t_ms long"), 7).collect()
    for x in got:
        hits = [(t - x.a_ms, i) for i, k, t in r if k is not None and k == x.key and None not in (t, x.a_ms) and 0 <= t - x.a_ms <= 7]
        assert (x.delay_ms, x.response_id) == (min(hits) if hits else (None, None))


def test_point_in_interval(spark):
    p = [r for r in rows(60, 7)]
    i = [(n, k, t, None if t is None else t + n % 9) for n, k, t in rows(30, 8)]
    points = spark.createDataFrame([(a, b, c) for a, b, c in p], "point_id long, k long, t long")
    intervals = spark.createDataFrame(i, "interval_id long, k long, t_start long, t_end long")
    for inside in (False, True):
        got = interval.point_in_interval(points, intervals, ["k"], 2, 5, inside).collect()
        assert len(got) == len(p)
        for r in got:
            hits = [((r.t < s, s, n) if inside else (n,)) for n, k, s, e in i if k is not None and k == r.k and None not in (s, r.t) and s - 2 <= r.t <= e]
            assert r.interval_id == (min(hits)[-1] if hits else None)


def test_stable_labels_and_runs(spark):
    rng = random.Random(9)
    seq = [(i, i // 40, i % 40, rng.choice(["a", "a", "b", "c", None])) for i in range(160)]
    df = spark.createDataFrame(seq, "id long, k long, t long, label string")
    got = {r.id: r.stable for r in islands.stable_labels(df, ["k"], ["t"], "label", 2).collect()}
    for k in range(4):
        own = [s for s in seq if s[1] == k]
        current, i = None, 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][3] == own[i][3]:
                j += 1
            if own[i][3] is not None and (j - i >= 2 or i == 0):
                current = own[i][3]
            assert all(got[x[0]] == current for x in own[i:j])
            i = j


def test_true_runs_sustained_and_merge(spark):
    rng = random.Random(10)
    seq = [(k, t, rng.random()) for k in range(5) for t in range(30)]
    df = spark.createDataFrame(seq, "k long, t long, v double")
    runs = {(r.k, r.start_place, r.end_place) for r in islands.true_runs(df, ["k"], ["t"], F.col("v") > 0.4, "v", 2).collect()}
    held = {r.k: r.sustained for r in islands.sustained_max(df, ["k"], ["t"], "v", 3).collect()}
    for k in range(5):
        v = [x for kk, _, x in seq if kk == k]
        expected, i = set(), 0
        while i < 30:
            j = i
            while j < 30 and v[j] > 0.4:
                j += 1
            if j - i >= 2:
                expected.add((k, i, j))
            i = j + 1
        assert {r for r in runs if r[0] == k} == expected
        assert held[k] == max(min(v[i : i + 3]) for i in range(28))
    merged = islands.merge_intervals(spark.createDataFrame([(1, 0, 4), (1, 2, 3), (1, 6, 7), (1, 10, 12), (2, 0, 1)], "k long, s long, e long"), ["k"], "s", "e", "e", 2)
    assert sorted((r.k, r.s, r.cascade_id) for r in merged.collect()) == [(1, 0, 0), (1, 2, 0), (1, 6, 0), (1, 10, 1), (2, 0, 0)]


def test_order_statistics(spark):
    rng = random.Random(11)
    data = [(rng.choice("ab"), rng.choice([None, *range(6)])) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, v int")
    for r in stats.nearest_rank(df, ["k"], "v", 0.7).collect():
        own = sorted(v for k, v in data if k == r.k and v is not None)
        assert r.quantile == own[round(0.7 * (len(own) - 1))]
    for r in stats.mode_stable(df, ["k"], "v").collect():
        own = [v for k, v in data if k == r.k]
        assert r.mode == min(set(own), key=lambda v: (-own.count(v), v is not None, v if v is not None else 0)) and r.n == own.count(r.mode)
    scores = [(rng.randrange(8), rng.randrange(2)) for _ in range(80)]
    auc = stats.mann_whitney_auc(spark.createDataFrame(scores, "s int, y int"), "s", "y").first()
    pairs = [(a > b) + (a == b) / 2 for a, ya in scores if ya for b, yb in scores if not yb]
    assert abs(auc.auc - sum(pairs) / len(pairs)) < 1e-12
    assert stats.mann_whitney_auc(spark.createDataFrame([(1, 1)], "s int, y int"), "s", "y").first().auc is None


def test_covering_intervals(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), i, t, t + rng.choice([-5, 0, 3, 40, 900, 70_000])) for i, t in enumerate(rng.randint(-5_000, 5_000) for _ in range(120))]
    spans += [("a", 900, -10**9, 10**9), ("a", 901, -10**15, 10**15), ("b", 902, None, 5), (None, 903, 0, 10)]
    points = [(rng.choice("ab"), i, rng.randint(-6_000, 80_000)) for i in range(150)] + [("a", 500, None), (None, 501, 5), ("c", 502, 5)]
    a = spark.createDataFrame(points, "k string, point_id long, t long").withColumn("t_start", F.lit(0))
    b = spark.createDataFrame(spans, "k string, interval_id long, t_start long, t_end long").withColumn("who", F.col("interval_id") % 3)
    expected = {(p, i) for k, p, t in points for g, i, s, e in spans if k is not None and k == g and None not in (t, s) and s <= t <= e}
    got = [(r.point_id, r.interval_id) for r in interval.covering(a, b, ["k"], 10).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    sets = {(r.point_id, r.who): r.intervals for r in interval.covering_sets(a, b, ["k"], "who", 10).collect()}
    assert sets == {(p, w): sorted(i for q, i in expected if q == p and i % 3 == w) for p, w in {(p, i % 3) for p, i in expected}}
    assert interval.covering(a, b.where("false"), ["k"], 10).count() == 0


def test_a_long_interval_is_not_repeated(spark):
    """One interval over all cells stands in two cells of its own width."""
    b = spark.createDataFrame([("a", 1, 0, 10**12)] + [("a", i, i, i + 1) for i in range(2, 50)], "k string, interval_id long, t_start long, t_end long")
    a = spark.createDataFrame([("a", i, 10**12 // 300 * i) for i in range(300)], "k string, point_id long, t long")
    plan = interval.covering(a, b, ["k"], 10)
    assert plan.where("interval_id = 1").count() == 300
