"""Sequence models, fits and resampling against enumeration, closed forms and known parameters."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import hmm, inference, mixture, regression


def brute(log_b, log_a):
    t, k = log_b.shape
    scores = {}
    for path in itertools.product(range(k), repeat=t):
        scores[path] = -math.log(k) + sum(log_b[i, s] for i, s in enumerate(path)) + sum(log_a[a, b] for a, b in zip(path, path[1:]))
    total = math.log(sum(math.exp(v) for v in scores.values()))
    post = np.zeros((t, k))
    stay = 0.0
    for path, v in scores.items():
        p = math.exp(v - total)
        stay += p * sum(a == b for a, b in zip(path, path[1:]))
        for i, s in enumerate(path):
            post[i, s] += p
    return post, total, stay, max(scores, key=scores.get)


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    log_b, log_a = rng.normal(size=(6, 5, 3)), hmm.transitions(0.8, 3)
    post, total, stay = hmm.forward_backward(log_b, log_a)
    path = hmm.viterbi(log_b, log_a)
    for c in range(6):
        p, t, s, best = brute(log_b[c], log_a)
        assert np.allclose(post[c], p) and np.isclose(total[c], t) and np.isclose(stay[c], s) and tuple(path[c]) == best


def simulate(spark, n=60, t=30, seed=2):
    rng = np.random.default_rng(seed)
    g, sigma, rho = np.array([0.6, 0.15, 0.25]), 1.0, 0.95
    rows = []
    for i in range(n):
        off = rng.uniform([10, 5], [40, 45], (5, 2))
        man = rng.permutation(5)
        for s in range(t - i % 4):
            off = off + rng.normal(0, 0.4, (5, 2))
            ball = off[i % 5] + rng.normal(0, 0.5, 2)
            for d in range(5):
                if rng.random() > rho:
                    man[d] = rng.integers(5)
            men = g[0] * off[man] + g[1] * ball + g[2] * hmm.HOOP + rng.normal(0, sigma, (5, 2))
            xy = lambda a: [(float(x), float(y)) for x, y in a]
            rows.append((i, s, i % 5, float(ball[0]), float(ball[1]), xy(off), xy(men)))
    point = "array<struct<x: double, y: double>>"
    return spark.createDataFrame(rows, f"possession long, step long, handler long, ball_x double, ball_y double, off {point}, def {point}")


def test_em_recovers_parameters(spark):
    p = hmm.fit(hmm.chains(simulate(spark)), max_iter=15)
    for g, s2 in zip(p.gamma, p.sigma2, strict=True):
        assert np.allclose(g, [0.6, 0.15, 0.25], atol=0.05) and abs(s2 - 1) < 0.15
    assert 0.9 < p.rho < 0.98
    assert all(b >= a - 1e-9 for a, b in zip(p.history, p.history[1:]))


def test_decode_covers_valid_steps(spark):
    frames = simulate(spark, n=5, t=8)
    out = hmm.decode(hmm.chains(frames), hmm.Params())
    assert out.count() == 5 * frames.count() and out.where("man between 0 and 4 and p_max between 0.19 and 1.000001").count() == out.count()
    assert hmm.decode(hmm.chains(frames.where("false")), hmm.Params()).count() == 0


def test_regressions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(1.0, None, 2.0)], "a double, b double, y double")
    fit = regression.ols(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")})
    design = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rss = ((y - design @ beta) ** 2).sum()
    assert fit.n == 400 and np.allclose(fit.beta, beta) and np.isclose(fit.r2, 1 - rss / ((y - y.mean()) ** 2).sum())
    assert np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / 397))
    label = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    ld = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, label, strict=True)], "a double, b double, y double")
    logit = regression.newton_logistic(ld, F.col("y"), {"a": F.col("a"), "b": F.col("b")}, c=2.0)
    p = 1 / (1 + np.exp(-(design @ logit.beta)))
    assert np.allclose(2.0 * design.T @ (p - label) + [0, *logit.beta[1:]], 0, atol=1e-6)


def test_two_way_clusters_that_coincide_are_one():
    rng = np.random.default_rng(3)
    x, g = np.column_stack([np.ones(60), rng.normal(size=60)]), np.repeat(np.arange(12), 5)
    y = x @ [1.0, 2.0] + rng.normal(size=12)[g] + rng.normal(size=60)
    one, two = regression.clustered_wls(y, x, np.ones(60), [g]), regression.clustered_wls(y, x, np.ones(60), [g, g])
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    draws = regression.cluster_bootstrap(y, np.ones(60), 500, 1)
    assert abs(draws.mean() - y.mean()) < 0.2 and np.array_equal(draws, regression.cluster_bootstrap(y, np.ones(60), 500, 1))


def test_mixture():
    rng = np.random.default_rng(5)
    w, m, s = np.array([0.3, 0.7]), np.array([[0.0, 0.0], [4.0, 1.0]]), np.array([1.0, 2.0])
    z = np.array([1.0, -1.0])
    direct = sum(a * np.exp(-((z - c) ** 2).sum() / (2 * d * d)) / (2 * np.pi * d * d) for a, c, d in zip(w, m, s, strict=True))
    assert np.isclose(mixture.log_density(w, m, s, z), np.log(direct)) and np.allclose(mixture.mean(w, m), [2.8, 0.7])
    assert np.allclose(mixture.mode(w, m, s), [0, 0])
    many = mixture.sample(w, m, s, 3000, rng)
    assert np.allclose(many.mean(axis=0), [2.8, 0.7], atol=0.2)
    wide = lambda a: np.broadcast_to(a, (1500, *a.shape))
    ranks = mixture.density_rank(wide(w), wide(m), wide(s), many[:1500], 200, rng)
    assert abs(ranks.mean() - 0.5) < 0.03 and abs(mixture.coverage(ranks, np.array([0.8]))[0] - 0.8) < 0.04
    cost = rng.random((4, 3, 3))
    total, order = mixture.best_assignment(cost)
    for c, t, o in zip(cost, total, order, strict=True):
        assert np.isclose(t, min(sum(c[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3)))) and np.isclose(t, c[range(3), o].sum())


def test_inference(spark):
    rng = np.random.default_rng(6)
    truth = rng.normal(10, 2, 30)
    se = np.full(30, 1.0)
    fit = inference.gibbs_shrinkage(truth + rng.normal(0, 1, 30), se, draws=1500, burn_in=300)
    assert abs(fit["mu"].mean() - 10) < 1 and 1 < fit["tau"].mean() < 3.2 and (fit["sd"] < 1.05).all()
    assert inference.robustness_value(0, 100) == 0 and 0 < inference.robustness_value(3, 100) < 1
    assert np.isclose(inference.steiger_z(0.5, 0.5, 0.3, 50), 0)
    x = np.arange(12.0)
    assert inference.permutation_p(x, x, 200, 1) < 0.01
    assert inference.greedy_matches([("a", 1, 3), ("a", 1, 5)], [("a", 1, 4), ("b", 1, 3), ("a", 2, 3)], 2) == [(0, 0)]
    assert inference.precision_recall(4, 2, 2) == (1.0, 0.5, pytest.approx(2 / 3))
    schema = "possession long, kind string, player long, step long"
    a, b = spark.createDataFrame([(1, "help", 2, 4), (1, "help", 2, 9), (2, "switch", 1, 1)], schema), spark.createDataFrame([(1, "help", 2, 5), (3, "help", 1, 1)], schema)
    assert {(r.kind, r.n_truth, r.n_found, r.n_matched) for r in inference.evaluate_events(a, b, ["possession"], 2).collect()} == {("help", 2, 2, 1), ("switch", 1, 0, 0)}
    treated = spark.createDataFrame([(1, 0.5, 3.0), (1, 0.5, 5.0), (0, 0.5, 1.0)], "t int, p double, y double")
    assert inference.overlap_effect(treated, F.col("t"), F.col("p"), F.col("y")).first().effect == 3.0
    assert np.isclose(inference.standardised_difference(treated, F.col("t"), F.col("y")).first().smd, 3 / math.sqrt(0.5))


def test_event_dependent_switching():
    rng = np.random.default_rng(7)
    log_b, code = rng.normal(size=(5, 5, 3)), rng.integers(0, hmm.PATTERNS, (5, 5))
    stay = hmm.stay_by_pattern(np.array([-2.0, 1.0, 0.5, 0.3, -0.2]))
    post, total, stayed = hmm.event_forward_backward(log_b, code, stay)
    path = hmm.event_viterbi(log_b, code, stay)
    for c in range(5):
        scores = {}
        for p in itertools.product(range(3), repeat=5):
            scores[p] = -math.log(3) + sum(log_b[c, i, s] for i, s in enumerate(p)) + sum(math.log(stay[code[c, i + 1]] if a == b else (1 - stay[code[c, i + 1]]) / 2) for i, (a, b) in enumerate(zip(p, p[1:])))
        whole = math.log(sum(map(math.exp, scores.values())))
        assert np.isclose(whole, total[c]) and tuple(path[c]) == max(scores, key=scores.get)
        for i in range(1, 5):
            assert np.isclose(stayed[c, i], sum(math.exp(v - whole) for p, v in scores.items() if p[i] == p[i - 1]))
        assert np.allclose(post[c].sum(axis=1), 1)
    one = hmm.event_forward_backward(log_b, np.zeros_like(code), np.full(hmm.PATTERNS, 0.8))
    assert np.allclose(one[0], hmm.forward_backward(log_b, hmm.transitions(0.8, 3))[0])
    beta = np.array([-3.0, 1.2, 0.8, 0.4, -0.5])
    steps = np.full(hmm.PATTERNS, 1e4)
    switch = 1 / (1 + np.exp(-hmm.pattern_design() @ beta))
    assert np.allclose(hmm.fit_switching(steps * (1 - switch), steps, np.zeros(5)), beta, atol=1e-4)
    fixed = hmm.fit_switching(steps * (1 - switch), steps, np.zeros(5), np.array([True, False, True, True, True]))
    assert fixed[1] == 0


def test_shot_model_recovers_and_round_trips(spark):
    from tracklane.operators import shot_quality as sq

    rng = np.random.default_rng(8)
    zones = rng.choice(sq.ZONES, 4000)
    dist = np.where(np.isin(zones, ["corner3", "above3"]), 24.0, rng.uniform(1, 18, 4000))
    near = rng.uniform(0.5, 12, 4000)
    eta = 0.8 - 0.06 * dist + 0.5 * np.log(near + 0.5)
    made = rng.random(4000) < 1 / (1 + np.exp(-eta))
    rows = [(int(i % 40), str(z), bool(m), float(d), 10.0, bool("3" in z), float(n), float(n) + 1, None if i % 5 == 0 else int(i % 6), i % 3 == 0, i % 4 == 0) for i, (z, m, d, n) in enumerate(zip(zones, made, dist, near, strict=True))]
    df = spark.createDataFrame(rows, "shooter_id long, zone string, made boolean, dist_ft double, angle_deg double, is_three boolean, def1_ft double, def_front_ft double, n_dribbles int, catch_and_shoot boolean, is_transition boolean").persist()
    model = sq.fit(df, "M1_geometry_defense")
    p = model.predict(df).agg(F.avg("xfg"), F.corr("xfg", F.lit(0) + F.col("made").cast("int"))).first()
    assert abs(p[0] - made.mean()) < 1e-3 and p[1] > 0.2
    full = sq.fit(df)
    again = sq.ShotModel.from_json(full.to_json(), full.counts)
    a, b = full.predict(df).agg(F.sum("xfg")).first()[0], again.predict(df).agg(F.sum("xfg")).first()[0]
    assert np.isclose(a, b) and full.predict(df.withColumn("dist_ft", F.lit(None).cast("double"))).where("xfg is not null").count() == 0
    table, counts = sq.shooter_prior(df)
    loo = sq.with_skill(df, table, counts, True).where("shooter_id = 3 and zone = 'rim'").first()
    own = [r for r in rows if r[0] == 3 and r[1] == "rim"]
    z = {r.zone: r for r in table.collect()}["rim"]
    n, m = len(own) - 1, sum(r[2] for r in own) - loo.made
    shrunk = (m + z.strength * z.p) / (n + z.strength)
    assert np.isclose(loo.skill, math.log(shrunk / (1 - shrunk)) - math.log(z.p / (1 - z.p)))


def test_fit_leaves_the_callers_cache(spark):
    """Several fits of the same chains read what the caller has persisted."""
    from tracklane.plans.track_queries import frames

    held = hmm.chains(frames(spark, "/root/testdata/sf0.001")).persist()
    hmm.fit(held, max_iter=1)
    assert held.is_cached and held.storageLevel.useMemory
    held.unpersist()


def test_sums_of_chunks(spark):
    """An E step's sums, taken a few hundred possessions at a time, are those of the definitions over all, with helpers and codes too."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    steps = [np.hstack([rng.uniform(0, 50, (t, 22)), rng.integers(0, 16, (t, 5))]).tolist() for t in rng.integers(1, 7, hmm.CHUNK + 40)]
    raw = pa.RecordBatch.from_arrays([pa.array(range(len(steps))), pa.array(steps, pa.list_(pa.list_(pa.float64())))], names=["possession", "steps"])
    p = hmm.Params(gamma=((0.5, 0.3, 0.2), (0.7, 0.1, 0.2)), sigma2=(9.0, 60.0), help=(0.4, 90.0), beta=(-2.0, 0.3, 0.1, -0.2, 0.5))
    got = hmm.expected_sums(spark.createDataFrame(list(enumerate(steps)), "possession long, steps array<array<double>>").coalesce(1), p)
    whole = hmm.Batch.of(raw)
    n, t = whole.valid.shape
    code = whole.code.reshape(n * 5, t)
    post, loglik, stayed = hmm.smooth(whole.log_density(p), p.stay()[code])
    weight = post.reshape(n, 5, t, 6) * whole.valid[:, None, :, None]
    expected = {"loglik": loglik.sum(), "n": whole.valid.sum() * 5, "help_weight": weight[..., 5].sum()}
    bodies = lambda d, k: (whole.off[:, :, k] - hmm.HOOP, whole.ball - hmm.HOOP, whole.men[:, :, d] - hmm.HOOP)
    side, moments, helps = whole.side(), np.zeros((2, 3, 3)), np.zeros((2, 2))
    for d in range(5):
        for k in range(5):
            dots = np.array([[(a * b).sum(axis=-1) for a in bodies(d, k)] for b in bodies(d, k)])
            for s in (0, 1):
                moments[s] += (dots * (weight[:, d, :, k] * (side[:, :, k] == s))).sum(axis=(2, 3))
        helps += (np.array([[(a * b).sum(axis=-1) for a in bodies(d, 0)[1:]] for b in bodies(d, 0)[1:]]) * weight[:, d, :, 5]).sum(axis=(2, 3))
    moves = np.repeat(whole.valid, 5, axis=0)
    moves[:, 0] = False
    expected |= {"side": moments, "help": helps, "weight": [(weight[..., :5] * (side == s)[:, None]).sum() for s in (0, 1)]}
    expected |= {"stayed": np.bincount(code[moves], stayed[moves], 16), "steps": np.bincount(code[moves], minlength=16)}
    assert got.keys() == expected.keys() and all(np.allclose(got[name], v, rtol=1e-10) for name, v in expected.items())


def test_left_over_attackers(spark):
    """Against all 120 assignments; sums of a possession's errors are those of its rows, whatever its length, and give the same scores."""
    from tracklane.operators import baselines
    from tracklane.plans.track_queries import frames

    rng = np.random.default_rng(21)
    cost = np.square(rng.normal(size=(3, 7, 5, 5, 2)) * 9).sum(axis=-1)
    got = baselines.left_over(cost)
    assert got.shape == (3, 7, 5)
    for at in itertools.product(range(3), range(7), range(5)):
        *place, hidden = at
        total = lambda way: sum(math.sqrt(cost[(*place, d, way[d])]) for d in range(5) if d != hidden)  # noqa: E731, B023
        assert min(itertools.permutations(range(5)), key=total)[hidden] == got[at]

    rows = hmm.chains(frames(spark, "/root/testdata/sf0.001").where("possession % 3 > 0 OR step < possession % 7 + 1"))
    each, sums = baselines.left_over_errors(rows), baselines.left_over_sums(rows)
    own = {r.possession: (r.n, r.square) for r in each.groupBy("possession").agg(F.count("square").alias("n"), F.sum("square").alias("square")).collect()}
    found = {r.possession: (r.n, r.square) for r in sums.collect()}
    assert own.keys() == found.keys() and len({n for n, _ in own.values()}) > 3
    assert all(own[k][0] == n and math.isclose(own[k][1], square, rel_tol=1e-12) for k, (n, square) in found.items())
    sigma = baselines.fitted_sigma(sums)
    assert math.isclose(sigma, baselines.fitted_sigma(each), rel_tol=1e-12)
    assert np.allclose([*baselines.scores(sums, sigma).first()], [*baselines.scores(each, sigma).first()], rtol=1e-12)
    assert baselines.fitted_sigma(sums.where("false")) == 0.0 and baselines.scores(sums.where("false"), 1.0).first().n == 0


def test_fits_from_several_starts_share_their_passes(spark, monkeypatch):
    """Each fit is the one it is alone, also where they end after different numbers of iterations; chains are read once an iteration."""
    rows = hmm.chains(simulate(spark)).persist()
    starts = [hmm.Params(), hmm.Params(gamma=((0.9, 0.05, 0.05),) * 2), hmm.Params(rho=0.6, sigma2=(25.0, 25.0), help=(0.5, 20.0))]
    alone = [hmm.fit(rows, start, max_iter=9, tol=1e-3) for start in starts]
    passes, step = [], hmm.expected_sums_each
    monkeypatch.setattr(hmm, "expected_sums_each", lambda held, params: passes.append(len(params)) or step(held, params))
    together = hmm.fit_each(rows, starts, max_iter=9, tol=1e-3)
    rows.unpersist()
    lengths = [len(p.history) for p in together]
    assert len(set(lengths)) > 1 and len(passes) == max(lengths) and sum(passes) == sum(lengths)
    for a, b in zip(alone, together, strict=True):
        assert np.allclose(a.history, b.history, rtol=1e-12) and np.allclose(np.array(a.gamma), np.array(b.gamma), rtol=1e-9) and math.isclose(a.rho, b.rho, rel_tol=1e-9)
