"""Scores of mixtures: areas against closed forms, two places by enumeration, points against moved defenders."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tracklane.operators import learned, mixture
from tracklane.operators.shot_quality import MODELS, ShotModel, design


def test_areas_of_gaussians(spark):
    area = lambda s, level: 2 * np.pi * s * s * np.log(1 / (1 - level))
    rows = spark.createDataFrame(
        [
            (1, [1.0, 0.0], [20.0, 25.0, 0.0, 0.0], [3.0, 1.0], [20.0, 25.0]),
            (2, [0.5, 0.5], [10.0, 10.0, 40.0, 40.0], [2.0, 2.0], [25.0, 25.0]),
            (3, [1.0, 0.0], [20.0, 25.0, 0.0, 0.0], [3.0, 1.0], [20.0 + float(3 * np.sqrt(2 * np.log(5))) + 0.3, 25.0]),
            (4, None, [1.0, 1.0, 1.0, 1.0], [1.0, 1.0], [1.0, 1.0]),
        ],
        "k int, weights array<double>, means array<double>, sigmas array<double>, z array<double>",
    )
    got = {r.k: (r.area, r.inside) for r in learned.regions(rows).collect()}
    assert set(got) == {1, 2, 3} and got[1][1] and not got[2][1] and not got[3][1]
    assert abs(got[1][0] / area(3, 0.8) - 1) < 0.02 and abs(got[2][0] / (2 * area(2, 0.8)) - 1) < 0.02
    wide = learned.regions(rows.where("k = 1"), level=0.95).first().area
    assert abs(wide / area(3, 0.95) - 1) < 0.02 and learned.regions(rows.where("false")).count() == 0


def test_region_holds_its_share_of_draws():
    w, m, s = np.array([[0.3, 0.7]]), np.array([[[15.0, 20.0], [25.0, 28.0]]]), np.array([[2.0, 3.0]])
    grid = np.stack(np.meshgrid(np.arange(-4.75, 60, 0.5), np.arange(-4.75, 55, 0.5), indexing="ij"), axis=-1).reshape(-1, 2)
    _, edge = learned.densest(w, m, s, 0.8, grid, 0.5)
    points = mixture.sample(w[0], m[0], s[0], 20_000, np.random.default_rng(3))
    assert abs((mixture.log_density(w[0], m[0], s[0], points) >= edge[0]).mean() - 0.8) < 0.01


def test_two_places_by_enumeration(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        w = rng.dirichlet(np.ones(4))
        rows.append((k, w.tolist(), rng.uniform(0, 20, 8).tolist(), rng.uniform(0, 20, (3, 2)).tolist()))

    def expected(w, m, anchors):
        m, anchors = np.array(m).reshape(-1, 2), np.array(anchors)
        own = [min(range(3), key=lambda j: ((anchors[j] - p) ** 2).sum()) for p in m]
        places = []
        for j in range(3):
            mine = [i for i in range(4) if own[i] == j]
            if sum(w[i] for i in mine) >= 0.15:
                places.append(sum(w[i] * m[i] for i in mine) / sum(w[i] for i in mine))
        return any(np.hypot(*(a - b)) >= 5 for a, b in itertools.combinations(places, 2))

    df = spark.createDataFrame(rows, "k int, w array<double>, m array<double>, a array<array<double>>")
    anchors = F.transform("a", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    got = {r.k: r.two for r in df.select("k", learned.two_places(F.col("w"), F.col("m"), anchors).alias("two")).collect()}
    assert got == {k: expected(w, m, a) for k, w, m, a in rows} and len(set(got.values())) == 2
    none = spark.createDataFrame([(None, [1.0], []), ([1.0], [1.0, 1.0], [])], "w array<double>, m array<double>, a array<array<double>>")
    assert all(not r.two for r in none.select(learned.two_places(F.col("w"), F.col("m"), anchors).alias("two")).collect())


def test_defence_of_a_shot():
    men = np.array([[20.0, 25.0], [14.0, 25.0], [15.25, 35.0]])
    near, front = learned.shot_defence(np.array([15.25, 25.0]), men)
    assert near == 1.25 and front == 1.25
    near, front = learned.shot_defence(np.array([15.25, 25.0]), men[[0, 2]])
    assert near == 4.75 and front == 30.0


def test_points_against_mixtures(spark):
    groups = MODELS["M1_geometry_defense"]
    model = ShotModel(groups, {"intercept": -0.3} | {name: 0.05 * (i + 1) * (-1) ** i for i, name in enumerate(design(groups))}, [])
    rng = np.random.default_rng(4)
    rows, sites = [], {}
    for k in range(150):
        shot, men, there = rng.uniform((8, 10), (30, 40)), rng.uniform((5, 5), (35, 45), (5, 2)), rng.uniform((5, 5), (35, 45), (5, 2))
        sites[k] = shot, men, there
        away = np.stack([there, there + 100], axis=1)  # the second component has no weight
        rows.append((k, "mid", float(np.hypot(*(shot - (5.25, 25)))), 30.0, k % 3 == 0, *map(float, shot), men.ravel().tolist(), [1.0, 0.0] * 5, away.ravel().tolist(), [1e-9, 5.0] * 5))
    columns = "k int, zone string, dist_ft double, angle_deg double, is_three boolean, shot_x double, shot_y double, defenders array<double>, weights array<double>, means array<double>, sigmas array<double>"
    shots = spark.createDataFrame([*rows, (-1, *rows[0][1:7], None, *rows[0][8:])], columns)
    got = {r.k: r for r in learned.learned_points(shots, model, ["k"], draws=3).collect()}
    assert set(got) == set(range(150))

    moved = []
    for k, (shot, men, there) in sites.items():
        for name, at in [("real", men), *((str(d), np.where((np.arange(5) == d)[:, None], there, men)) for d in range(5)), ("team", there)]:
            near, front = learned.shot_defence(shot, at)
            moved.append((k, name, float(near), float(front)))
    plain = shots.drop("defenders", "weights", "means", "sigmas").join(spark.createDataFrame(moved, "k int, who string, def1_ft double, def_front_ft double"), "k")
    xfg = {(r.k, r.who): r.xfg * (3 if r.is_three else 2) for r in model.predict(plain).collect()}
    for k, r in got.items():
        assert np.isclose(r.xfg_real * (3 if k % 3 == 0 else 2), xfg[k, "real"])
        assert np.allclose(r.dep, [xfg[k, "real"] - xfg[k, str(d)] for d in range(5)], atol=1e-6) and np.isclose(r.dep_team, xfg[k, "real"] - xfg[k, "team"], atol=1e-6)

    spread = shots.withColumn("sigmas", F.transform("sigmas", lambda s: s * 0 + 2.0))
    first, second = ({r.k: (r.dep, r.dep_team) for r in learned.learned_points(df, model, ["k"]).collect()} for df in (spread, spread.repartition(7)))
    assert first == second


def test_draws_are_those_of_their_component():
    """A draw is the mean and sigma of the component that u picks, one by one; mixtures are broadcast against leading and inner axes of draws."""
    rng = np.random.default_rng(12)
    w, m, s = rng.dirichlet(np.ones(3), (6, 4)), rng.uniform(0, 40, (6, 4, 3, 2)), rng.uniform(1, 2, (6, 4, 3))
    u, normal = mixture.noise(50, (6, 4), rng)
    got = mixture.placed(w, m, s, u, normal)
    inner = mixture.placed(w[:, None], m[:, None], s[:, None], np.moveaxis(u, 0, 1), np.moveaxis(normal, 0, 1))
    assert got.shape == (50, 6, 4, 2) and np.array_equal(np.moveaxis(inner, 1, 0), got)
    for t, i, j in itertools.product(range(50), range(6), range(4)):
        c = int(np.searchsorted(np.cumsum(w[i, j])[:-1], u[t, i, j]))
        assert np.array_equal(got[t, i, j], m[i, j, c] + s[i, j, c] * normal[t, i, j])
    given = np.empty((50, 6, 4)), np.empty((50, 6, 4, 2))
    mixture.noise(50, (6, 4), np.random.default_rng(5), *given)
    assert all(np.array_equal(a, b) for a, b in zip(given, mixture.noise(50, (6, 4), np.random.default_rng(5)), strict=True))


def test_losses_regions_and_entropy_of_slots():
    rng = np.random.default_rng(8)
    w, m, s = rng.dirichlet(np.ones(3), (4, 3)), rng.uniform(0, 10, (4, 3, 3, 2)), rng.uniform(1, 2, (4, 3, 3))
    z = rng.uniform(0, 10, (4, 3, 2))
    one = lambda b, slot, p: -np.log(sum(w[b, slot, c] / (2 * np.pi * s[b, slot, c] ** 2) * np.exp(-((z[b, p] - m[b, slot, c]) ** 2).sum() / (2 * s[b, slot, c] ** 2)) for c in range(3)))
    own = [np.mean([one(b, k, k) for k in range(3)]) for b in range(4)]
    best = [min(np.mean([one(b, slot, p) for p, slot in enumerate(order)]) for order in itertools.permutations(range(3))) for b in range(4)]
    assert np.allclose(mixture.slot_loss(w, m, s, z), own) and np.allclose(mixture.set_loss(w, m, s, z), best)

    single = np.array([1.0]), np.array([[2.0, 3.0]]), np.array([1.5])
    levels = np.array([0.5, 0.8, 0.95])
    top = -np.log(2 * np.pi * 1.5**2)  # a Gaussian's density at the edge of the region of share p is (1 - p) of its top
    assert np.allclose(mixture.region_thresholds(*single, levels, 20_000, rng), top + np.log(1 - levels), atol=0.06)
    assert abs(mixture.entropy(*single, 20_000, rng) - (1 - top)) < 0.03
