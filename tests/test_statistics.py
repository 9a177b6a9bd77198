"""Quantiles and ranks over cells, and phases of defenders."""

import random

import numpy as np
import pytest

from tracklane.operators import defence, stats


@pytest.fixture
def small_leaf(monkeypatch):
    monkeypatch.setattr(stats, "LEAF", 40)
    monkeypatch.setattr(stats, "CELLS", 8)


def values(seed, n=1500):
    """A hot key with most rows, a key of ties, a null key, nulls and outliers."""
    rng = random.Random(seed)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(n)] + [("ties", float(rng.randrange(3))) for _ in range(200)] + [(None, rng.random()) for _ in range(70)]
    rows += [("one", 5.0), ("none", None), ("hot", None), ("hot", 1e12), ("hot", -1e12)]
    rng.shuffle(rows)
    return rows


def test_quantiles_of_keys(spark, small_leaf):
    rows = values(1)
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = {r.k: r for r in stats.group_quantiles(df, ["k"], "v", shares).collect()}
    near = {r.k: r.quantile for r in stats.nearest_rank(df, ["k"], "v", 0.63).collect()}
    assert set(got) == set(near) == {"hot", "ties", None, "one"}
    for k, r in got.items():
        own = sorted(v for x, v in rows if x == k and v is not None)
        assert near[k] == own[round(0.63 * (len(own) - 1))]
        for name, q in shares.items():
            assert r[name] == pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-12)


def test_quantiles_of_a_column(spark, small_leaf):
    rows = values(2)
    df = spark.createDataFrame(rows, "k string, v double")
    own = [v for _, v in rows if v is not None]
    assert stats.linear_quantiles(df, "v", (0, 0.2, 0.5, 0.999, 1)) == pytest.approx(list(np.quantile(own, (0, 0.2, 0.5, 0.999, 1))), rel=1e-12)
    assert stats.linear_quantiles(df.where("k = 'none'"), "v", (0.5,)) == [None]
    row = stats.described(df, ["v"]).first()
    assert (row.n, row.nulls) == (len(own), 2) and row.q50 == pytest.approx(np.median(own))


def test_quantiles_of_a_column_of_equal_values(spark, small_leaf):
    """Nearly all values are equal, so cells by shares of the rows never part them from the rest."""
    own = [0.0] * 3000 + [0.25, 1.5, 7.0, -3.0, 1e300, -1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in own], "v double")
    assert stats.linear_quantiles(df, "v", (0, 0.5, 0.99, 1)) == [-1e300, 0.0, 0.0, float("inf")]
    spread = [2.0**k for k in range(-60, 60)] * 2
    df = spark.createDataFrame([(v,) for v in spread], "v double")
    assert stats.linear_quantiles(df, "v", (0, 0.3, 1)) == pytest.approx(list(np.quantile(spread, (0, 0.3, 1))), rel=1e-12)


def test_average_ranks(spark, small_leaf):
    rows = values(3)
    df = spark.createDataFrame(rows, "k string, v double")
    for r in stats.average_ranks(df, ["k"], "v").collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        if r.v is None:
            assert r["rank"] is None and r.rank_pct is None
            continue
        rank = sum(v < r.v for v in own) + (sum(v == r.v for v in own) + 1) / 2
        assert r["rank"] == rank
        assert r.rank_pct is None if len(own) == 1 else r.rank_pct == pytest.approx(100 * (rank - 1) / (len(own) - 1))


@pytest.mark.parametrize(("variant", "expected"), [
    ("A", {(2, 0): "pre_screen", (2, 1400): "pre_screen", (2, 1600): "screen", (2, 3000): "screen", (2, 3200): "other", (0, 3200): "help", (0, 5400): "recovery", (0, 5800): "other", (1, 1200): "closeout", (1, 2000): "recovery", (1, 3600): "other"}),
    ("B", {(2, 800): "pre_screen", (2, 1000): "screen", (2, 4000): "screen", (2, 4200): "other", (0, 3600): "help", (0, 5800): "recovery", (1, 800): "pre_screen", (1, 4400): "recovery", (1, 4600): "other"}),
])
def test_phases(spark, variant, expected):
    steps = spark.createDataFrame([(p, j, t) for p in (1, 2) for j in range(5) for t in range(0, 6000, 200)], "possession long, slot long, t long")
    spans = "possession long, slot long, t_start long, t_end long"
    helps, closing = spark.createDataFrame([(1, 0, 3000, 3600), (1, 4, None, 10)], spans), spark.createDataFrame([(1, 1, 1000, 1400)], spans)
    contacts = spark.createDataFrame([(1, 2000), (1, None)], "possession long, t_contact long")
    rows = defence.phases(steps, helps, closing, contacts, defence.VARIANTS[variant]).collect()
    found = {(r.possession, r.slot, r.t): r.phase for r in rows}
    assert {k: found[(1, *k)] for k in expected} == expected
    assert {p for k, p in found.items() if k[0] == 2} == {"other"} and len(found) == len(rows) == 300


def test_phase_shares_and_their_differences(spark):
    rows = spark.createDataFrame([(1, "help"), (1, "other"), (2, "help"), (2, "help")], "d long, phase string")
    got = {r.d: (r.n, r.help, r.help_diff, r.other_diff) for r in defence.phase_shares(rows, ["d"]).collect()}
    assert got == {1: (2, 0.5, -0.25, 0.25), 2: (2, 1.0, 0.25, -0.25)}
    assert defence.phase_shares(rows.where("d > 5"), ["d"]).count() == 0
