"""Keeps a log of first responses up to date as event files arrive (incremental).

For each anchor event (say, a screen) the first response (say, a third
defender's help) within a horizon by an actor who is not one of those in the
anchor. Event files are a stream: a run takes the files that came since the last
one, and ends. Redelivered events count once, events later than the allowed
delay are left out, and an anchor is written once, when its horizon is over; one
whose horizon is still open waits in the checkpoint for a later run.

    python -m jobs.response_log --events DIR_OR_FILE --out DIR [--config FILE] [--master local[8]]

Output below DIR: `rows`, Parquet by day of the anchor, and `checkpoint`. A run
without new files changes nothing; after a failure the next run goes on from the
checkpoint, and readers see whole batches only.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import config
from tracklane.session import build_session
from tracklane.streaming import events, holding

log = logging.getLogger("jobs.response_log")

CONFIG = Path(__file__).with_suffix(".json")
SETTINGS = {"anchor": str, "response": str, "key": str, "actor": str, "without": str, "horizon_seconds": int, "late_seconds": int, "files_per_batch": int}
COLUMNS = "anchor_id long, key long, at_ms long, response_id long, actor long, delay_ms long, day string"


def settings(path: str | Path = CONFIG) -> dict:
    return config.load(path, SETTINGS)


def responses(stream: DataFrame, conf: dict) -> DataFrame:
    """First responses in a stream of events. Rows without id or time take no part; a null key or actor meets nobody."""
    late = f"{conf['late_seconds']} seconds"
    rows = stream.where("event_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    key, actor = (F.expr(conf[c]).cast("long") for c in ("key", "actor"))
    anchors = rows.where(conf["anchor"]).select(F.col("event_id").alias("anchor_id"), key.alias("key"), F.col("ts").alias("a_ts"), F.expr(conf["without"]).alias("without"))
    answers = rows.where(conf["response"]).select(F.col("event_id").alias("response_id"), key.alias("r_key"), actor.alias("actor"), F.col("ts").alias("r_ts"))
    first = events.first_responses(anchors, answers, f"{conf['horizon_seconds']} SECONDS", late=None)
    at = F.unix_millis("a_ts")
    return first.select("anchor_id", "key", at.alias("at_ms"), "response_id", "actor", (F.unix_millis("r_ts") - at).alias("delay_ms"), F.date_format("a_ts", "yyyy-MM-dd").alias("day"))


def written(spark: SparkSession, out: str) -> DataFrame:
    """The log as it stands; empty before the first run."""
    return spark.read.schema(COLUMNS).parquet(f"{out}/rows")


def run(spark: SparkSession, events_path: str, out: str, conf: dict) -> DataFrame:
    """Takes what is new below events_path into the log below out, and returns the whole log."""
    schema = spark.read.parquet(events_path).select("event_id", "ts", "user_id", "event_type", "value", "props").schema
    stream = events.event_source(spark, events_path, schema, conf["files_per_batch"])
    counted = responses(stream, conf).observe("written", F.count(F.lit(1)).alias("rows"), F.count("response_id").alias("responses"))
    with holding.state_on_disk(spark):
        query = events.start(counted, out, "day")
        query.awaitTermination()
    for step in query.recentProgress:
        made = (step["observedMetrics"] or {}).get("written")
        log.info("batch %s: %s rows scanned from %s, %s anchors written, %s with a response", step["batchId"], step["numInputRows"], events_path, *(made or (0, 0)))
    found = written(spark, out)
    days = found.groupBy("day").count()
    total = days.agg(F.count(F.lit(1)).alias("days"), F.sum("count").alias("rows")).first()
    log.info("%s/rows holds %s anchors of %s days", out, total.rows or 0, total.days)
    return found


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--events", required=True, help="file or folder of event Parquet files")
    parser.add_argument("--out", required=True, help="folder of the log and its checkpoint")
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--master")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = build_session("response_log", given.master)
    try:
        run(spark, given.events, given.out, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
