"""The jobs: two runs over growing input, reruns, edges, command lines, SQL."""

import datetime as dt
import hashlib
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, TABLES, plain

from jobs import config, queries, response_log, review_sample
from tracklane.operators.sampling import disjoint_strata

ROOT = Path(__file__).resolve().parent.parent
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns) and plain(got) == plain(expected)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_log_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    conf = response_log.settings()
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 20), dt.datetime(2025, 1, 1)]
    source, out, low = f"{tmp_path}/events", f"{tmp_path}/out", dt.datetime(2000, 1, 1)
    seen = []
    for high in cuts:
        part = events.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1)
        part.write.mode("append").parquet(source)
        low = high
        caplog.clear()
        seen.append(rows_of(response_log.run(spark, source, out, conf)))
        scanned = sum(int(m.split(" rows scanned")[0].split(": ")[1]) for m in caplog.messages if "rows scanned" in m)
        assert 0 < scanned <= 2 * part.count()
    assert all(set(a) < set(b) for a, b in zip(seen, seen[1:], strict=False))
    assert rows_of(response_log.run(spark, source, out, conf)) == seen[-1]
    whole = response_log.run(spark, f"{SF}/events.parquet", f"{tmp_path}/whole", conf)
    assert rows_of(whole) == seen[-1]


def test_log_of_redelivered_late_and_odd_events(spark, tmp_path):
    conf = response_log.settings()
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    first = [
        (1, at(0), 10, "view", 1.0, None), (1, at(0), 10, "view", 1.0, None), (2, at(1), 12, "click", 1.0, None), (3, at(1), 11, "click", 1.0, None),
        (4, at(2), 30, "view", None, None), (None, at(2), 30, "view", None, None), (5, None, 30, "view", None, None), (6, at(3), None, "view", None, None),
        (7, at(3), None, "click", None, None), (8, at(40), 99, "other", None, None),
    ]
    later = [(1, at(0), 10, "view", 1.0, None), (2, at(1), 12, "click", 1.0, None), (9, at(39.5), 30, "view", None, None), (10, at(60), 99, None, None, None)]
    source, out = f"{tmp_path}/events", f"{tmp_path}/out"
    for i, part in enumerate((first, later)):
        spark.createDataFrame(part, EVENT).withColumn("day", F.lit("x")).withColumn("key", F.lit(3)).coalesce(1).write.mode("append").parquet(source)
        got = {r.anchor_id: (r.response_id, r.actor, r.day) for r in response_log.run(spark, source, out, conf).collect()}
        expected = {1: (2, 12, "2024-01-01"), 4: (None, None, "2024-01-01"), 6: (None, None, "2024-01-01")}
        assert got == expected | ({9: (None, None, "2024-01-02")} if i else {})


def test_log_of_no_events(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(f"{tmp_path}/events")
    for _ in range(2):
        assert response_log.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", response_log.settings()).count() == 0


def drawn_plainly(rows, takes, cap, seed):
    """One candidate after the other."""
    pools, groups = {}, {}
    for category, key, grp in rows:
        if key is not None and category in takes:
            held = pools.setdefault(category, {})
            held[key] = min((held[key], grp), key=lambda g: (g is None, g or "")) if key in held else grp
    taken, out = set(), []
    for category in sorted(pools, key=lambda c: (len(pools[c]), c)):
        got = 0
        for key in sorted(pools[category], key=lambda k: (hashlib.md5(f"{seed}:{category}:{k}".encode()).hexdigest(), k)):
            grp = pools[category][key]
            if got == takes[category]:
                break
            if key not in taken and groups.get(grp, 0) < cap:
                taken.add(key)
                groups[grp] = groups.get(grp, 0) + 1
                got += 1
                out.append((category, key, grp, got, len(pools[category])))
    return sorted(out, key=str)


@pytest.mark.parametrize("cap", [1, 4, 50])
def test_strata_against_one_after_the_other(spark, cap):
    rows = [(c, i * m % 101, ["hot", "x", "y", None][(i * m % 101) % 7 // 2]) for c, n, m in (("big", 300, 7), ("mid", 60, 11), ("small", 20, 13), ("unasked", 5, 3)) for i in range(n)]
    rows += [("small", None, "x"), (None, 5, "x")]
    takes = {"big": 25, "mid": 15, "small": 30, "absent": 3}
    got = disjoint_strata(spark.createDataFrame(rows, "category string, key long, grp string"), takes, cap, 5).collect()
    assert sorted(map(tuple, got), key=str) == drawn_plainly(rows, takes, cap, 5)


def test_sample_of_odd_tables(spark, tmp_path):
    conf = review_sample.settings()
    docs = [(1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (2, None, None, None, None), (None, "c", "en", "s", 1), (3, "", "en", "t", 0), (4, "x" * 300_000, "en", "t", 300_000)]
    labels = [(1, 0, 1), (1, 1, 0), (None, 0, 0), (3, None, None), (77, 1, 1)]
    spark.createDataFrame(docs, DOC).withColumns({c: F.lit("z") for c in ("place", "pool", "category", "key", "grp", "toxic")}).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(labels, LABEL).withColumn("source", F.lit("z")).write.parquet(f"{tmp_path}/labels")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none")
    spark.createDataFrame([], LABEL).write.parquet(f"{tmp_path}/unlabelled")
    got = [rows_of(review_sample.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", conf)) for _ in range(2)]
    assert got[0] == got[1]
    found = {r.doc_id: (r.category, r.text, r.pool, r.weight) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: ("toxic", "a", 1, 1.0), 4: ("long_text", "x" * 300_000, 1, 1.0), 3: ("short_text", "", 2, 2.0), 2: ("unlabelled", None, 3, 3.0)}
    assert review_sample.run(spark, f"{tmp_path}/none", f"{tmp_path}/labels", f"{tmp_path}/out", conf).count() == 0
    assert review_sample.run(spark, f"{tmp_path}/docs", f"{tmp_path}/unlabelled", f"{tmp_path}/out", conf).count() == 4


def test_configs_are_checked(tmp_path):
    held = json.loads(response_log.CONFIG.read_text())
    for change in ({"horizon": 1}, {"horizon_seconds": "12"}, {"horizon_seconds": True}):
        (tmp_path / "c.json").write_text(json.dumps(held | change))
        with pytest.raises(ValueError):
            response_log.settings(tmp_path / "c.json")
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError, match="missing"):
        config.load(tmp_path / "c.json", response_log.SETTINGS)
    held = json.loads(review_sample.CONFIG.read_text())
    for change in ({"group": "text"}, {"categories": {"a": {"where": "true"}}}, {"categories": {"a": {"where": "true", "take": -1}}}):
        (tmp_path / "c.json").write_text(json.dumps(held | change))
        with pytest.raises(ValueError):
            review_sample.settings(tmp_path / "c.json")


@pytest.mark.parametrize("args", [["jobs.response_log", "--events", f"{SF}/events.parquet"], ["jobs.review_sample", "--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet"]])
def test_command_lines(spark, tmp_path, args):
    conf = tmp_path / "own.json"
    conf.write_text((ROOT / "jobs" / f"{args[0].split('.')[1]}.json").read_text())
    done = subprocess.run([sys.executable, "-m", *args, "--out", f"{tmp_path}/out", "--config", str(conf), "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert str(tmp_path) in done.stderr and args[0] in done.stderr
    path = f"{tmp_path}/out/rows" if "response" in args[0] else f"{tmp_path}/out"
    assert spark.read.parquet(path).count() > 0
