"""Structured Streaming forms of the frame operators, for a live event feed.

Inputs are streams with event_id, user_id, event_type, value and a timestamp
`ts`; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def file_or_folder(path: str) -> str:
    """A pattern that matches just this path: streams then take a single file as well as a folder of files."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def event_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files (one, or a folder of them) as a stream, with ts as a timestamp."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(file_or_folder(path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(stream: DataFrame, late: str | None) -> DataFrame:
    """stream with a watermark; None where it has one from an earlier step."""
    return stream.withWatermark("ts", late) if late else stream


def deduplicated(stream: DataFrame, key: list[str], late: str | None = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return _marked(stream, late).dropDuplicatesWithinWatermark(key)


def segments(stream: DataFrame, by: str, gap: str, late: str | None = LATE) -> DataFrame:
    """Continuous stretches per key: a gap of time without rows starts a new one."""
    return (
        _marked(stream, late)
        .groupBy(by, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(by, F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "n", "total")
    )


def rates(stream: DataFrame, width: str, late: str | None = LATE) -> DataFrame:
    """Counts and mean value per type in fixed windows."""
    return (
        _marked(stream, late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("w.start").alias("t_start"), "event_type", "n", "mean_value")
    )


def all_responses(anchors: DataFrame, responses: DataFrame, horizon: str, late: str | None = LATE) -> DataFrame:
    """Anchors with each response of their key within the horizon, and those without any once the watermark has passed.

    anchors: anchor_id, key, a_ts, without (array of actors, null: nobody);
    responses: response_id, r_key, actor, r_ts. Events as they are will do too:
    the user is key and actor then, and nobody is left out. An actor in `without` does not
    respond, nor does a null one. The join's state is dropped as soon as no
    response can come any more.
    """
    if "anchor_id" not in anchors.columns:
        anchors = anchors.select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("key"), F.col("ts").alias("a_ts"), F.lit(None).cast("array<long>").alias("without"))
        responses = responses.select(F.col("event_id").alias("response_id"), F.col("user_id").alias("r_key"), F.col("user_id").alias("actor"), F.col("ts").alias("r_ts"))
    a = anchors.withWatermark("a_ts", late) if late else anchors
    r = responses.withWatermark("r_ts", late) if late else responses
    near = F.expr(f"key = r_key AND r_ts >= a_ts AND r_ts <= a_ts + INTERVAL {horizon} AND actor IS NOT NULL AND NOT coalesce(array_contains(without, actor), false)")
    return a.join(r, near, "leftOuter").select("anchor_id", "key", "a_ts", "response_id", "actor", "r_ts")


def first_responses(anchors: DataFrame, responses: DataFrame, horizon: str, late: str | None = LATE) -> DataFrame:
    """anchor_id, key, a_ts, and response_id, actor, r_ts of the first response (nulls where none came), as in all_responses.

    Ties go to the smaller response_id. The minimum of an anchor is kept beside
    the join and leaves, once, when the watermark has passed its horizon; so an
    anchor whose horizon is not over by the end of the input is not there yet.
    """
    found = F.when(F.col("response_id").isNotNull(), F.struct("r_ts", "response_id", "actor"))
    first = all_responses(anchors, responses, horizon, late).groupBy("anchor_id", "key", "a_ts").agg(F.min(found).alias("f"))
    return first.select("anchor_id", "key", "a_ts", "f.response_id", "f.actor", "f.r_ts")


RUNS = "user_id long, label string, t_start timestamp, t_end timestamp, n long"
RUN_STATE = "label string, t_start timestamp, t_end timestamp, n long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closes the open run when the label changes or the key times out."""
    if state.hasTimedOut:
        label, start, end, n = state.get
        state.remove()
        yield pd.DataFrame([(key[0], label, start, end, n)], columns=["user_id", "label", "t_start", "t_end", "n"])
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    run = list(state.get) if state.exists else None
    closed = []
    for label, ts in zip(rows["event_type"], rows["ts"], strict=True):
        if run and run[0] == label:
            run[2], run[3] = max(run[2], ts), run[3] + 1
        else:
            if run:
                closed.append((key[0], *run))
            run = [label, ts, ts, 1]
    state.update(tuple(run))
    state.setTimeoutTimestamp(max(int(pd.Timestamp(run[2]).value // 1_000_000), state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame(closed, columns=["user_id", "label", "t_start", "t_end", "n"])


def label_runs(stream: DataFrame, late: str | None = LATE) -> DataFrame:
    """Runs of equal labels per key as they close; the state is one open run for each key."""
    return _marked(stream, late).groupBy("user_id").applyInPandasWithState(_advance, RUNS, RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def finished(df: DataFrame, folder: str, by: str | None = None) -> DataFrame:
    """Runs a finite stream of new rows to its end into Parquet files, partitioned by a column, and reads back all that is there.

    folder holds the files and the checkpoint; a later call with the same folder takes only what is new.
    """
    start(df, folder, by).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def start(df: DataFrame, folder: str, by: str | None = None) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.partitionBy(by) if by else writer).trigger(availableNow=True).start()


def replayed(df: DataFrame, folder: str) -> DataFrame:
    """Runs a finite stream of whole results (complete mode) to its end and reads back the last one.

    Each batch overwrites the folder of its number, so a repeated batch leaves the same.
    """
    done = []

    def write(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        done.append(batch)

    run = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows/batch={max(done)}")
