"""Held labels as a stream: the stable path and the sticky handler, with state per key.

Rows wait in list state until the watermark has passed them, are then taken in
order, and leave as soon as their label is settled. What is held back is bounded:
rows within the watermark's delay, and runs shorter than the hold.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOBODY = "-1"


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for streams that start within; the setting before comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Hold:
    """A rule for runs of equal labels, and where a key stands: what was accepted last, and the run that is open.

    A run is accepted if it has min_hold rows; with first_holds the key's first
    run always; with touches also a shorter run right before a run of NOBODY that
    has min_hold rows. Null runs are never accepted. A row's held label is that
    of the last accepted run, its own included.
    """

    def __init__(self, min_hold: int, first_holds: bool, touches: bool) -> None:
        self.min_hold, self.first_holds, self.touches = min_hold, first_holds, touches

    def settle(self, labels: list[str | None], held: str | None, open_label: str | None, open_rows: int, runs: int) -> tuple[list[str | None], str | None, str | None, int, int]:
        """Held labels of the first rows of `labels` (those settled by now), and the standing after them."""
        parts = [(label, len(list(rows))) for label, rows in groupby(labels)]
        out: list[str | None] = []
        for i, (label, n) in enumerate(parts):
            going_on = i == 0 and open_rows > 0 and label == open_label
            length, first = n + (open_rows if going_on else 0), runs == 0 or (going_on and runs == 1)
            accepted = self._accepted(parts, i, label, length, first)
            if accepted is None:
                break
            if accepted:
                held = label
            out += [held] * n
            open_label, open_rows, runs = label, length, runs + (not going_on)
        return out, held, open_label, open_rows, runs

    def _accepted(self, parts: list, i: int, label: str | None, length: int, first: bool) -> bool | None:
        """None: more rows are needed to tell."""
        last = i + 1 == len(parts)
        if label is None:
            return False
        if length >= self.min_hold or (first and self.first_holds):
            return True
        if last:
            return None
        if not self.touches or label == NOBODY or parts[i + 1][0] != NOBODY:
            return False
        return True if parts[i + 1][1] >= self.min_hold else (None if i + 2 == len(parts) else False)


class _Processor(StatefulProcessor):
    def __init__(self, rule: Hold, key: str) -> None:
        self.rule, self.key = rule, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, label string")
        self.standing = handle.getValueState("standing", "held string, open_label string, open_rows long, runs long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in part[["ts", "event_id", "label"]].itertuples(index=False, name=None)]
        yield self._settled(key, new, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(key, [], timerValues)

    def close(self) -> None:
        pass

    def _settled(self, key: tuple, new: list, timers) -> pd.DataFrame:
        now = timers.getCurrentWatermarkInMs()
        rows = sorted([(_millis(t), e, x if isinstance(x, str) else None, t) for t, e, x in [*self.waiting.get(), *new]], key=lambda r: (r[3], r[1]))
        due = [r for r in rows if r[0] <= now]
        held, open_label, open_rows, runs = self.standing.get() if self.standing.exists() else (None, None, 0, 0)
        out, *standing = self.rule.settle([r[2] for r in due], held, open_label, open_rows, runs)
        self.standing.update(tuple(standing))
        left = rows[len(out) :]
        if left:
            self.waiting.put([(t, e, x) for _, e, x, t in left])
        else:
            self.waiting.clear()
        later = [r[0] for r in rows if r[0] > now]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if later:
            self.handle.registerTimer(later[0])
        return pd.DataFrame([(key[0], e, x, h) for (_, e, x, _), h in zip(rows[: len(out)], out, strict=True)], columns=[self.key, "event_id", "label", "held"])


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def held_labels(stream: DataFrame, key: str, label: str, min_hold: int, first_holds: bool, touches: bool = False, late: str | None = "1 hour") -> DataFrame:
    """key, event_id, label and held of each row, once it is settled: as islands.stable_labels in batch.

    stream: key, event_id, ts and the label column; rows of a key are taken by ts
    and event_id. A row later than the watermark goes, as do null times. The run
    that is open at the end stays open until more rows come. Needs state_on_disk.
    """
    rows = stream.select(key, "event_id", "ts", F.col(label).cast("string").alias("label"))
    rows = rows.withWatermark("ts", late) if late else rows
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(_Processor(Hold(min_hold, first_holds, touches), key), f"{key} {kind}, event_id long, label string, held string", "append", "EventTime")


def stable_path(stream: DataFrame, key: str, label: str, min_hold: int, late: str | None = "1 hour") -> DataFrame:
    """The label of the last run that held for min_hold rows; the first run holds always."""
    return held_labels(stream, key, label, min_hold, True, late=late)


def sticky_handler(stream: DataFrame, key: str, label: str, min_hold: int, late: str | None = "1 hour") -> DataFrame:
    """As tracking.sticky_handler: labels of holders, NOBODY where there is none, short touches before flight count; before the first accepted run NOBODY."""
    return held_labels(stream, key, label, min_hold, False, True, late).withColumn("held", F.coalesce("held", F.lit(NOBODY)))
