"""Streams over growing folders of files, against the batch operators."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklane.operators.interval import first_after_anchor_excluding
from tracklane.operators.islands import stable_labels
from tracklane.operators.tracking import sticky_handler
from tracklane.streaming import events, holding

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def feed(n, seed, users=4):
    """Events in an order that departs from time by up to 20 minutes; some share a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = START + dt.timedelta(seconds=60 * (i + rng.randint(-10, 10)) if rng.random() < 0.9 else 60 * i)
        rows.append((i, t, rng.randrange(users), rng.choice(["-1", "-1", "a", "a", "b"]), float(i), None))
    return rows


@pytest.fixture
def grow(spark, tmp_path):
    """grow(rows) adds a file to the folder of events and gives the folder."""
    folder = f"{tmp_path}/events"

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return folder

    return add


def held_plainly(labels, min_hold, first_holds, touches):
    """(held, settled) of each row, by runs."""
    runs, out, held = [], [], None
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    done = True
    for i, (x, n) in enumerate(runs):
        after = runs[i + 1 :]
        touch = touches and x != "-1" and bool(after) and after[0][0] == "-1" and after[0][1] >= min_hold
        accepted = x is not None and (n >= min_hold or (first_holds and i == 0) or touch)
        open_ = x is not None and not accepted and (not after or (touches and x != "-1" and len(after) == 1 and after[0][0] == "-1" and after[0][1] < min_hold))
        done = done and not open_
        held = x if accepted else held
        out += [(held, done)] * n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "-1", None]), max_size=30), st.lists(st.integers(1, 6), max_size=30), st.integers(1, 4), st.booleans(), st.booleans())
def test_settling_in_parts_equals_all_at_once(labels, cuts, min_hold, first_holds, touches):
    rule = holding.Hold(min_hold, first_holds, touches)
    out, waiting, standing, at = [], [], (None, None, 0, 0), 0
    for n in [*cuts, len(labels)]:
        waiting += labels[at : at + n]
        at += n
        done, *standing = rule.settle(waiting, *standing)
        out, waiting = out + done, waiting[len(done) :]
    assert out == [held for held, done in held_plainly(labels, min_hold, first_holds, touches) if done]


@pytest.mark.parametrize("sticky", [False, True])
def test_held_labels_of_a_growing_stream(spark, grow, tmp_path, sticky):
    rows = feed(600, 3)
    rule = holding.sticky_handler if sticky else holding.stable_path
    parts = [rows[:250], rows[250:400], rows[400:]]
    seen = []
    for part in parts:
        stream = events.event_source(spark, grow(part), spark.createDataFrame([], SCHEMA).schema)
        with holding.state_on_disk(spark):
            seen.append({r.event_id: r.held for r in events.finished(rule(stream, "user_id", "event_type", 3, "30 minutes"), f"{tmp_path}/out").collect()})
    for before, after in zip(seen, seen[1:], strict=False):
        assert len(after) > len(before) and before.items() <= after.items()
    df = spark.createDataFrame(rows, SCHEMA)
    if sticky:
        batch = sticky_handler(df.withColumn("slot", F.translate("event_type", "ab", "12").cast("int")), ["user_id"], ["ts", "event_id"], "slot", 3)
        batch = batch.select("event_id", F.when(F.col("handler") < 0, "-1").otherwise(F.translate(F.col("handler").cast("string"), "12", "ab")).alias("held"))
    else:
        batch = stable_labels(df, ["user_id"], ["ts", "event_id"], "event_type", 3).select("event_id", F.col("stable").alias("held"))
    held = {r.event_id: r.held for r in batch.collect()}
    assert seen[-1].items() <= held.items()
    last = max(r[1] for r in rows) - dt.timedelta(minutes=30)
    settled = sum(done for u in range(4) for _, done in held_plainly([r[3] for r in sorted((r for r in rows if r[2] == u and r[1] <= last), key=lambda r: (r[1], r[0]))], 3, not sticky, sticky))
    assert len(seen[-1]) == settled


def test_first_responses_of_a_growing_stream(spark, grow, tmp_path):
    rows = feed(600, 5, users=6)
    rows[100] = (*rows[100][:2], None, *rows[100][3:])
    found = []
    for part in (rows[:300], rows[300:]):
        stream = events.event_source(spark, grow(part), spark.createDataFrame([], SCHEMA).schema)
        a = stream.where("event_type = 'a'").select(F.col("event_id").alias("anchor_id"), F.lit(1).alias("key"), F.col("ts").alias("a_ts"), F.array("user_id").alias("without"))
        r = stream.where("event_type = 'b'").select(F.col("event_id").alias("response_id"), F.lit(1).alias("r_key"), F.col("user_id").alias("actor"), F.col("ts").alias("r_ts"))
        out = events.finished(events.first_responses(a, r, "3 MINUTES", "30 minutes"), f"{tmp_path}/out")
        found.append({x.anchor_id: (x.response_id, x.actor) for x in out.collect()})
    assert found[0].items() <= found[1].items() and len(found[0]) < len(found[1])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t_ms", F.unix_millis("ts"))
    anchors = df.where("event_type = 'a'").select(F.col("event_id").alias("anchor_id"), F.lit(1).alias("key"), "t_ms", F.array("user_id").alias("without"))
    answers = df.where("event_type = 'b'").select(F.col("event_id").alias("response_id"), F.lit(1).alias("key"), "t_ms", F.col("user_id").alias("actor"))
    batch = {x.anchor_id: (x.response_id, x.actor) for x in first_after_anchor_excluding(anchors, answers, 180_000).collect()}
    assert found[1].items() <= batch.items() and len(found[1]) > len(batch) * 0.8


def test_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), holding.state_on_disk(spark):
        assert spark.conf.get(name) == holding.PROVIDER
        raise ValueError
    assert spark.conf.get(name) == before
