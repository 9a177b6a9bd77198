"""A synthetic game from raw JSON to possessions; play-by-play CSV; release checks; streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import checks, screens, shots, tracking
from tracklane.sources import games

HOME, AWAY = 10, 20


def players(team):
    return [{"lastname": f"L{team + i}", "firstname": "F", "playerid": team + i, "jersey": str(i), "position": "G"} for i in range(5)]


def moment(i, clock, ball, shift=0.0):
    rows = [[-1, -1, *ball]]
    for team, x in ((HOME, 28.0), (AWAY, 26.0)):
        rows += [[team, team + k, x + shift + k, 10.0 + 5 * k, 0.0] for k in range(5)]
    return [1, 1_000_000 + 40 * i, clock, 20.0, None, rows]


def game_json(path):
    """Ball from the backcourt to the left hoop; shot at frame 450. Events overlap by five frames."""
    frames = []
    for i in range(500):
        x = 70 - 0.1 * i if i < 300 else 40 - 0.1 * (i - 300)
        ball = [x, 25.0, 4.0]
        if i >= 440:
            k = i - 440
            ball = [max(26 - 2.2 * k, 5.25), 25.0, min(8.0 + 0.5 * k, 10.0)]
        elif i >= 300:
            ball = [28.0, 10.0, 4.0]  # in the hands of player 10
        frames.append(moment(i, 720 - 0.04 * i, ball))
    side = lambda team, name: {"name": name, "teamid": team, "abbreviation": name[:3], "players": players(team)}
    event = lambda i, m: {"eventId": str(i), "home": side(HOME, "Home"), "visitor": side(AWAY, "Away"), "moments": m}
    game = {"gameid": "21500001", "gamedate": "2015-10-27", "events": [event(1, frames[:255]), event(2, []), event(3, frames[250:])]}
    path.write_text(json.dumps(game))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("games") / "g.json"
    game_json(path)
    return games.read_games(spark, str(path))


def test_raw_json(raw):
    frames = games.game_frames(raw)
    assert frames.count() == 505 * 11 and {r.game_id for r in frames.select("game_id").distinct().collect()} == {"0021500001"}
    events = {r.event_id: r for r in games.game_events(raw).collect()}
    assert events[2].n_moments == 0 and events[2].unix_start is None and events[3].unix_end == 1_000_000 + 40 * 499
    assert games.game_roster(raw).count() == 10
    report = games.validate_frames(frames).first()
    assert report.n_faults == 0 and report.n_times == 500 and report.least_entities == 11


def test_possession_from_frames(spark, raw):
    frames = games.game_frames(raw)
    entities = tracking.dedup_entities(frames)
    assert entities.count() == 500 * 11
    index = tracking.frame_index(entities)
    assert index.count() == 500 and {r.segment_id for r in index.select("segment_id").distinct().collect()} == {0}
    report = tracking.dedup_report(frames, entities, index).first()
    assert abs(report.duplicate_share - 5 / 505) < 1e-9 and report.n_segments == 1
    shot_rows = spark.createDataFrame([("0021500001", t, 1, x) for t, x in ((HOME, 6.0), (HOME, 8.0), (AWAY, 90.0))], "game_id string, team_id long, period int, x double")
    direction = tracking.attack_direction(shot_rows)
    assert {(r.team_id, r.attacks_left) for r in direction.collect()} == {(HOME, True), (AWAY, False)}
    pbp = spark.createDataFrame(
        [("0021500001", 1, 1, 702, 2, HOME, None), ("0021500001", 2, 1, 300, 5, HOME, 3), ("0021500001", 3, 1, 701, 8, HOME, None)],
        "game_id string, event_num int, period int, pctime_sec int, msg_type int, p1_team_id long, score_margin int",
    )
    hosts = spark.createDataFrame([("0021500001", HOME)], "game_id string, home_team_id long")
    out = {r.event_num: r for r in tracking.segment_possessions(entities, index, pbp, direction, hosts).collect()}
    assert set(out) == {1, 2}
    p = out[1]
    assert p.reject is None and p.offense_team_id == HOME and p.attacks_left and p.method == "rim" and p.shooter_id == HOME
    assert p.t_cross == 1_000_000 + 40 * 231 and p.t_terminal == 1_000_000 + 40 * 439 and p.t_end == p.t_terminal + 500
    assert list(p.offense_ids) == [HOME + i for i in range(5)] and not p.cropped and not p.is_transition
    assert out[2].reject == "terminal_not_located:turnover"


def second_chance_frames():
    """Team HOME (5 men at x 20) attacks left; the ball is in front of midcourt throughout, in a hand at frames 60-69, 100-109 and 130-199, above the rim at 50-54."""
    rows = []
    for i in range(200):
        held = 60 <= i < 70 or 100 <= i < 110 or i >= 130
        ball = (5.25, 25.0, 10.0) if 50 <= i < 55 else (20.0, 10.0, 4.0) if held else (40.0, 2.0, 4.0)
        at = [(-1, -1, *ball)] + [(t, t + j, 20.0 - t / 10, 10.0 + 8 * j, 0.0) for t in (HOME, AWAY) for j in range(5)]
        rows += [("g", 1, 1, i, 40 * i, 700 - 0.04 * i, None, *r) for r in at]
    return rows


def test_second_chances(spark):
    entities = spark.createDataFrame(second_chance_frames(), "game_id string, event_id int, period int, moment_idx int, unix_ms long, game_clock double, shot_clock double, team_id long, player_id long, x double, y double, z double")
    index = tracking.frame_index(entities)
    direction = spark.createDataFrame([("g", HOME, 1, True), ("g", AWAY, 1, False)], "game_id string, team_id long, period int, attacks_left boolean")
    hosts = spark.createDataFrame([("g", AWAY)], "game_id string, home_team_id long")

    def run(rebounds, second_chances=True):
        # A reading of 698 is the second around frame 37, 697 that around 62, 695 that around 112 (from 100 on), 692 that around 187.
        events = [(2 + i, 4, reading, team) for i, (reading, team) in enumerate(rebounds)] + [(9, 5, 692, HOME)]
        pbp = spark.createDataFrame([("g", n, 1, s, kind, team, None) for n, kind, s, team in events], "game_id string, event_num int, period int, pctime_sec int, msg_type int, p1_team_id long, score_margin int")
        (row,) = tracking.segment_possessions(entities, index, pbp, direction, hosts, second_chances).collect()
        return row

    none = "no_crossing:always_frontcourt:turnover"
    assert run([]).reject == none and run([(697, HOME)], False).reject == none
    assert run([(697, AWAY)]).reject == none and run([(697, None)]).reject == none and run([(None, HOME)]).reject == none
    first = run([(697, HOME)])
    assert first.reject is None and first.is_second_chance and first.t_cross == 40 * 60 and not first.is_transition and first.n_frames == 140
    last = run([(697, HOME), (695, HOME), (695, AWAY)])
    assert last.t_cross == 40 * 100 and last.prev_event_num is None and last.margin_offense == 0


def test_control_waits_for_the_ball_below_the_rim():
    ball = np.array([(t, *((5.25, 25, 10) if t < 300 else (20, 10, 4))) for t in range(0, 1000, 40)], float)
    men = np.array([(t, 10, 20, 10) for t in range(0, 1000, 40)], float)
    hoop = (5.25, 25.0)
    assert tracking.control(ball, men, hoop, 400, None, 1000) == 320 and tracking.control(ball, men, hoop, 400, None, 300) is None
    assert tracking.control(ball, men, hoop, 1200, 500, 1000) == 720 and tracking.control(ball, men[:0], hoop, 400, None, 1000) is None
    assert tracking.control(ball[:0], men, hoop, 400, None, 1000) is None


def test_windows_carried_over(spark):
    schema = "k int, v double, l array<long>"
    base = spark.createDataFrame([(1, 1.0, [1]), (2, None, None), (3, 3.0, [3])], schema)
    more = spark.createDataFrame([(1, 1.0, [1]), (2, None, None), (3, 3.0, [3]), (4, 4.0, None)], schema).withColumn("extra", F.lit(1))
    assert checks.carried_over(base, more, ["k"]).first() == (3, 4, 1, 0, 0, True)
    other = spark.createDataFrame([(1, 1.0, [2]), (2, 0.0, None), (4, 4.0, None)], schema)
    assert checks.carried_over(base, other, ["k"]).first() == (3, 3, 1, 1, 2, False)
    assert checks.carried_over(base.where("false"), base.where("false"), ["k"]).first() == (0, 0, 0, 0, 0, True)


def test_frame_index_breaks(spark, raw):
    entities = tracking.dedup_entities(games.game_frames(raw))
    broken = entities.where("unix_ms not between 1004000 and 1004200").withColumn("game_clock", F.when(F.col("unix_ms") > 1_010_000, F.col("game_clock") + 5).otherwise(F.col("game_clock")))
    index = tracking.frame_index(broken)
    assert index.where("gap and dt is not null").count() == 1 and index.where("clock_jump").count() == 1
    assert {r.segment_id for r in index.select("segment_id").distinct().collect()} == {0, 1, 2}


def test_crossing_and_locate():
    f = np.array
    assert tracking.crossing(f([False, True, False, True, True])) == 3
    assert tracking.crossing(f([True, True])) is None and tracking.crossing(f([True, False])) is None and tracking.crossing(f([], dtype=bool)) is None
    unix, clock, segment = np.arange(5) * 40, f([10.9, 10.6, 10.5, 10.4, 9.9]), f([0, 0, 0, 0, 0])
    assert tracking.locate(unix, clock, segment, 10, None) == 80 and tracking.locate(unix, clock, segment, 10, 80) == 120
    assert tracking.locate(unix, clock, segment, 50, None) is None


def test_sticky_handler(spark):
    labels = [-1, 0, 0, 0, 1, 2, -1, -1, -1, 3, 0, 0, 0]
    df = spark.createDataFrame([(1, t, c) for t, c in enumerate(labels)], "p long, t long, c int")
    got = [r.handler for r in tracking.sticky_handler(df, ["p"], ["t"], "c", 3).orderBy("t").collect()]
    assert got == [-1, 0, 0, 0, 0, 2, -1, -1, -1, -1, 0, 0, 0]


def test_resample_holds_ends(spark):
    points = spark.createDataFrame([(1, 0, 0.0), (1, 100, 10.0), (1, 400, 40.0)], "k long, t long, v double")
    spans = spark.createDataFrame([(1, -50, 420)], "k long, t0 long, t1 long")
    got = [(r.t, r.valid, r.v) for r in tracking.resample(points, ["k"], spans, 100, 6, ["v"]).collect()]
    by_time = {t: v for t, valid, v in got if valid}
    assert by_time == {-50: 0.0, 50: 5.0, 150: 15.0, 250: 25.0, 350: 35.0} and sum(not valid for _, valid, _ in got) == 2
    assert all(v == 40.0 for t, valid, v in got if not valid)


def test_pbp_csv(spark, tmp_path):
    path = tmp_path / "pbp.csv"
    names = [c.split()[0] for c in games.PBP.split(", ")]
    path.write_text(",".join(names) + "\n21500001,5,1,1,1,11:22,4 - 6,2,101,10.0,made,\n21500001,6,1,2,1,bad,,TIE,0,,,miss\n")
    a, b = games.read_pbp(spark, str(path)).orderBy("event_num").collect()
    assert (a.game_id, a.pctime_sec, a.score_margin, a.score_visitor, a.score_home, a.p1_team_id) == ("0021500001", 682, 2, 4, 6, 10)
    assert (b.pctime_sec, b.score_margin, b.p1_id, b.p1_team_id) == (None, 0, None, None)


def test_switch_classes(spark):
    switches = spark.createDataFrame([("g", 1, 1, 100, 200, 1000), ("g", 2, 2, 200, 100, 1500), ("g", 3, 3, 100, 200, 1200), ("g", 4, 1, 300, 400, 9000), ("g", 5, 9, 7, 8, 5000)], "g string, switch_id long, def_id long, from_id long, to_id long, t long")
    calls = spark.createDataFrame([("g", "s1", 1, 1, 2, 100, 200, 1200), ("g", "s2", 2, 1, 5, 100, 200, 1100), ("g", "s3", 3, 9, 5, 7, 8, 5500)], "g string, screen_id string, screen_order int, screened_def long, screener_def long, user_id long, screener_id long, t_contact long")
    got = {r.switch_id: (r.event_class, r.screen_id) for r in screens.classify_switches(switches, calls, ["g"], 1000).collect()}
    assert got == {1: ("screen_switch", "s1"), 2: ("screen_switch", "s1"), 3: ("rotation", None), 4: ("rotation", None), 5: ("one_sided", "s3")}


def test_release_policy_and_equality(spark, tmp_path):
    shots_ok = spark.createDataFrame([("g", 1, 2.0, 3.0)], "game_id string, t_release_ms long, shot_x double, shot_y double")
    assert checks.release_problems(shots_ok) == [] and checks.release_problems(shots_ok.union(shots_ok)) == ["shot key repeats"]
    assert checks.release_problems(spark.createDataFrame([(1.0, 2.0)], "def_x double, speed double")) == ["forbidden column def_x"]
    many = spark.range(40).select(F.lit("g").alias("game_id"), F.lit(1).alias("possession_id"))
    assert checks.release_problems(many) == ["40 rows of a possession"]
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "i int, s string")
    assert checks.frames_equal(a, a.orderBy("i")).first() == (True, 3)
    assert not checks.frames_equal(a, a.distinct()).first().equal and checks.frames_equal(a.where("false"), a.where("false")).first() == (True, 0)
    games.write_sorted(a, str(tmp_path / "t"), ["i"], 1)
    assert games.manifest(spark, str(tmp_path / "t")).count() >= 1
    assert games.git_blob_id(b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def test_touch_state_edges(spark):
    s = spark.createDataFrame([(1, 5, 100), (2, 5, 1000), (3, 6, 100)], "shot_id long, actor long, t long")
    touches = spark.createDataFrame([(1, 5, 40, 90), (2, 5, 60, 70), (3, 5, 99, 99)], "touch_id long, actor long, t_start long, t_end long")
    dribbles = spark.createDataFrame([(5, 61), (5, 99), (5, 101)], "actor long, t_dribble long")
    got = {r.shot_id: (r.touch_id, r.n_dribbles, r.touch_s) for r in shots.touch_state(s, touches, dribbles, 100, 10).collect()}
    assert got == {1: (3, 1, 0.001), 2: (None, None, None), 3: (None, None, None)}


def test_streams(spark, tmp_path):
    from tracklane.streaming import events

    rows = [(i, i % 3, ["a", "b"][(i // 4) % 2], float(i), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: events.event_source(spark, str(tmp_path / "in"), df.schema)
    drained = lambda s, n, mode: (events.replayed if mode == "complete" else events.finished)(s, str(tmp_path / n))
    assert drained(events.deduplicated(source(), ["event_id"]), "dedup", "append").count() == 120
    rates = drained(events.rates(events.deduplicated(source(), ["event_id"]), "1 minute", None), "rates", "append")
    assert rates.count() == 0  # windows stay open until the watermark has passed
    complete = drained(events.rates(source(), "1 minute"), "rates_all", "complete")
    assert complete.agg(F.sum("n")).first()[0] == 125
    runs = drained(events.label_runs(events.deduplicated(source(), ["event_id"]), None), "runs", "append").collect()
    for r in runs:
        assert 1 <= r.n <= 4 and r.t_start <= r.t_end
    assert len(runs) >= 40
    anchors, responses = source().where("event_type = 'a'"), source().where("event_type = 'b'")
    joined = drained(events.all_responses(anchors, responses, "5 seconds"), "resp", "append")
    assert joined.where("response_id is not null").count() > 0


def test_game_sets_and_versions(spark):
    from tracklane.operators import gamesets

    games_table = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "ok")], "game_id string, status string")
    wanted = lambda *ids: spark.createDataFrame([(i,) for i in ids], "game_id string")
    assert [r.game_id for r in gamesets.game_set(games_table, wanted("a", "b", "a")).collect()] == ["a"]
    with pytest.raises(ValueError, match="zz"):
        gamesets.game_set(games_table, wanted("zz"))
    with pytest.raises(ValueError):
        gamesets.DataVersion("latest")
    grid = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2)], "game_id string, possession_id int")
    assert [r.possession_id for r in gamesets.assert_grid(grid, 2).collect()] == [2]
    means = {(r.u, r.f): r.mean_of_others for r in gamesets.left_out_means(spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (2, 0, 1.0)], "u int, f int, v double"), "u", "f", "v").collect()}
    assert means == {(1, 0): 4.0, (1, 1): 2.0, (2, 0): None}


def test_files_against_a_listing(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "three")):
        (tmp_path / name).write_text(text)
    listing = games.manifest(spark, str(tmp_path)).select("name", "sha256").collect()
    (tmp_path / "b").write_text("changed")
    (tmp_path / "c").unlink()
    (tmp_path / "d").write_text("four")
    known = spark.createDataFrame([*listing, (None, "x")], "name string, sha256 string")
    got = {r.name: r.status for r in games.compared(games.manifest(spark, str(tmp_path)), known).collect()}
    assert got == {"a": "same", "b": "changed", "c": "missing", "d": "new"}


def test_game_files_hold_a_game_in_a_line(spark):
    """No row, and so no task, holds the text of more than one game."""
    from tracklane.sources import feeds

    keys = spark.range(256 * 20).withColumnRenamed("id", "o_orderkey")
    lines = spark.read.text(feeds.game_files(spark, keys))
    assert lines.count() == 20 and lines.where("instr(substr(value, 2), 'gameid') > 2").count() == 0
    slots, _ = feeds.possession_files(spark, spark.range(3 * feeds.GAME_SLOTS).withColumnRenamed("id", "k"))
    assert spark.read.text(slots).count() == 3
    assert games.read_games(spark, slots, lines=True).selectExpr("sum(size(events)) AS n").first().n == 3 * feeds.GAME_SLOTS


def test_tracked_periods(spark, raw):
    """Moments dealt by period give what single entities give, repeated times and repeated entities too, in as many tasks as there are periods."""
    again = spark.createDataFrame([("0021500001", 9, 0, 1, 1_000_000, 1.0, None, [(-1, -1, 9.0, 9.0, 9.0), (77, 78, 1.0, 2.0, 3.0), (77, 78, 4.0, 5.0, 6.0)])], "game_id string, event_id int, moment_idx int, period int, unix_ms long, game_clock double, shot_clock double, entities array<struct<team_id: long, player_id: long, x: double, y: double, z: double>>")
    moments = games.game_moments(raw).unionByName(again)
    pbp = spark.createDataFrame([("0021500001", n, p, s, k, t, None) for n, p, s, k, t in ((1, 1, 702, 2, HOME), (2, 1, 700, 5, HOME), (3, 2, 700, 5, AWAY), (4, 1, 712, 1, AWAY))], "game_id string, event_num int, period int, pctime_sec int, msg_type int, p1_team_id long, score_margin int")
    tracked = tracking.Tracked.of(moments, pbp)
    assert tracked.partitions == 2 and tracked.moments.rdd.getNumPartitions() == 2
    others = moments.where("event_id < 9 OR unix_ms IS NULL").unionByName(again.withColumn("entities", F.slice("entities", 1, 2)))
    entities = tracking.dedup_entities(others.select("*", F.explode("entities").alias("e")).select("*", "e.*").drop("e", "entities"))
    ordered = lambda df: sorted(df.collect())
    key = ["game_id", "period", "unix_ms"]
    rows = tracked.times().select(*key, "game_clock", F.explode("entities").alias("e"))
    assert ordered(rows.select(*key, "e.*")) == ordered(entities.select(*key, "team_id", "player_id", "x", "y", "z", "game_clock"))
    index = tracking.frame_index(entities)
    assert ordered(rows.select(*key, "game_clock").distinct()) == ordered(index.select(*key, "game_clock"))
    shots = tracking.shot_ball_positions(entities, pbp)
    assert ordered(tracked.shots()) == ordered(shots.select(tracked.shots().columns)) and shots.count() == 2
    direction = tracking.attack_direction(shots)
    hosts = games.game_hosts(raw)
    for second_chances in (False, True):
        found, expected = (df.drop("offense_ids", "defense_ids") for df in (tracked.possessions(direction, hosts, second_chances), tracking.segment_possessions(entities, index, pbp, direction, hosts, second_chances)))
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.where("reject = 'period_untracked'").count() == 1


def test_same_times():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (40, 30)):
        a, b = rng.integers(0, 20, n).astype(float), np.sort(rng.integers(0, 20, m)).astype(float)
        left, right = tracking.same_times(a, b)
        assert [*zip(left.tolist(), right.tolist(), strict=True)] == [(i, j) for i in range(n) for j in range(m) if a[i] == b[j]]


def test_shots_deal_the_ball_alone(spark, raw):
    """Men are left out before moments are dealt, and a moment's values are parsed by the reader: only those of its entities are parsed again."""
    pbp = spark.createDataFrame([("0021500001", 1, 1, 702, 2, HOME, None)], "game_id string, event_num int, period int, pctime_sec int, msg_type int, p1_team_id long, score_margin int")
    tracked = tracking.Tracked.of(games.game_moments(raw), pbp)
    text = tracked.shots()._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filter(entities") >= 1 and text.rindex("filter(entities") > text.index("RepartitionByExpression")
    assert games.game_moments(raw)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert games.game_events(raw)._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 0


def test_index_of_moments(spark, raw):
    """Moments dealt by game give the index of their single entities, with times that repeat, clocks that tie and nulls among them, by one shuffle."""
    schema = "game_id string, event_id int, moment_idx int, period int, unix_ms long, game_clock double, shot_clock double, entities array<struct<team_id: long, player_id: long, x: double, y: double, z: double>>"
    man = lambda team, player: (team, player, 1.0, 2.0, 3.0)
    odd = [
        ("0021500001", 9, 0, 1, 1_000_000, 1.0, None, [man(-1, -1), man(77, 78), man(77, 78)]), ("0021500001", 9, 1, 1, 1_000_000, 2.0, 3.0, [man(77, 78), man(77, 79), man(None, 79)]),
        ("0021500002", 1, 0, 2, 50, 9.0, None, [man(10, 11)]), ("0021500002", 2, 0, 2, 50, 8.0, 20.0, [man(10, 11), man(20, 11)]), ("0021500002", 2, 1, 2, 90, 8.0, 20.0, []),
        ("0021500002", 2, 2, 2, 200, 9.5, 20.0, [man(10, 11), man(-1, -1)]), ("0021500002", 2, 3, 1, 10, 7.0, 5.0, None), ("0021500002", 2, 4, 1, 20, 7.0, 5.0, [man(10, 11)]),
    ]
    moments = games.game_moments(raw).unionByName(spark.createDataFrame(odd, schema))
    entities = tracking.dedup_entities(moments.select("*", F.explode("entities").alias("e")).select("*", "e.*").drop("e", "entities"))
    expected, found = tracking.frame_index(entities), tracking.moment_index(moments)
    columns = [c for c in expected.columns if c != "dt"] + ["dt"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert dict(found.dtypes) == dict(expected.dtypes) and found.where("clock_jump").count() >= 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_both_segmentations_in_one_pass(spark, monkeypatch):
    """Windows without and with second chances come of one read of the moments, in as many partitions as periods ask for, and equal those of two passes."""
    monkeypatch.setattr(tracking, "TASK_PERIODS", 1)
    n = 2 * spark.sparkContext.defaultParallelism
    in_games = lambda df: df.crossJoin(spark.range(n).select(F.col("id").cast("string").alias("game_id")))
    frames = spark.createDataFrame(second_chance_frames(), "g string, event_id int, period int, moment_idx int, unix_ms long, game_clock double, shot_clock double, team_id long, player_id long, x double, y double, z double")
    moments = frames.groupBy("event_id", "period", "moment_idx", "unix_ms", "game_clock").agg(F.collect_list(F.struct("team_id", "player_id", "x", "y", "z")).alias("entities"))
    events = [(2, 1, 4, 697, HOME), (3, 1, 4, None, HOME), (8, 1, 9, None, None), (9, 1, 5, 692, HOME), (10, 2, 4, 700, HOME), (11, 3, 5, 700, AWAY)]
    pbp = spark.createDataFrame([(*e, None) for e in events], "event_num int, period int, msg_type int, pctime_sec int, p1_team_id long, score_margin int")
    direction = in_games(spark.createDataFrame([(HOME, 1, True), (AWAY, 1, False)], "team_id long, period int, attacks_left boolean"))
    hosts = in_games(spark.createDataFrame([(AWAY,)], "home_team_id long"))
    tracked = tracking.Tracked.of(in_games(moments), in_games(pbp))
    both = tracked.both_possessions(direction, hosts)
    assert tracked.partitions == 3 * n == both.rdd.getNumPartitions()
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "entities" in line for line in plan.splitlines()) == 1
    for again, whole in ((False, 0), (True, n)):
        found, alone = both.where(F.col("second_chances") == again).drop("second_chances"), tracked.possessions(direction, hosts, again)
        assert found.schema == alone.schema and sorted(map(str, found.collect())) == sorted(map(str, alone.collect()))
        assert found.count() == 3 * n and found.where("reject IS NULL AND is_second_chance").count() == found.where("reject IS NULL").count() == whole
