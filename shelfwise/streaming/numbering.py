"""Session numbers on a stream (E3 of the clickstream, T1).

A visitor's sessions are numbered in the order of time, so an event can be numbered once every earlier one is there: the
events of a visitor wait in keyed state until the watermark has passed the end of their session, then leave it in order with
their session id. What stays of a visitor is the time of the last event and the running number. An event that comes after
the watermark has passed it is not dropped but handed on as late.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwise.session import scratch_path

#: A visitor's next session begins after more than this.
GAP_MINUTES = 30

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "visitor_id string, item_id string, event_type string, event_us long, session_number int, late boolean"


class SessionNumbers(StatefulProcessor):
    """Rows of one visitor (event_us, item_id, event_type) in, numbered rows out. ``behind_ms``: how far the engine's own
    watermark lies behind the one that closes sessions; rows between the two are late."""

    def __init__(self, gap_minutes: int, behind_ms: int) -> None:
        self.gap_us, self.behind_ms = gap_minutes * 60_000_000, behind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "event_us long, item_id string, event_type string")
        self.last = handle.getValueState("last", "event_us long, session_number int")

    def _passed_us(self, timer_values) -> int | None:
        """The time up to which no more events are waited for; None before the first batch has set it."""
        mark = timer_values.getCurrentWatermarkInMs()
        return (mark + self.behind_ms) * 1000 if mark > 0 else None

    def _rows(self, key, rows: list[tuple], late: bool) -> Iterator[pd.DataFrame]:
        if rows:
            us, item, kind, number = zip(*rows, strict=True)
            yield pd.DataFrame({"visitor_id": key[0], "item_id": item, "event_type": kind, "event_us": us,
                                "session_number": pd.array(number, dtype="Int32"), "late": late})

    def _wake(self, end_us: int) -> None:
        """Asks to be called when the watermark has passed ``end_us``."""
        self.handle.registerTimer(end_us // 1000 + 1 - self.behind_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self._passed_us(timerValues)
        late, early = [], []
        for frame in rows:
            for us, item, kind in zip(frame["event_us"], frame["item_id"], frame["event_type"], strict=True):
                if passed is not None and us < passed:
                    late.append((int(us), item, kind, None))
                else:
                    early.append((int(us), item, kind))
        if early:
            self.pending.appendList(early)  # one call of the state store, not one per row
            self._wake(min(r[0] for r in early) + self.gap_us)
        yield from self._rows(key, late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed_us(timerValues)
        events = sorted((tuple(r) for r in self.pending.get()), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        before, number = self.last.get() or (None, 0)
        out, session = [], []
        for i, event in enumerate(events):
            if before is not None and event[0] - before > self.gap_us:
                number += 1
            before = event[0]
            session.append((*event, number))
            if i + 1 == len(events) or events[i + 1][0] - before > self.gap_us:
                if passed is None or before + self.gap_us >= passed:
                    break  # still open, and so are those after it
                out += session
                session = []
        if out:
            self.last.update((out[-1][0], out[-1][3]))
        left = events[len(out):]
        if left:
            self.pending.put(left)
            ends = [a[0] + self.gap_us for a, b in zip(left, [*left[1:], None], strict=True)
                    if b is None or b[0] - a[0] > self.gap_us]
            self._wake(ends[0])
        else:
            self.pending.clear()
        yield from self._rows(key, out, False)

    def close(self) -> None:
        pass


def number_sessions(events: DataFrame, delay_minutes: int = 60, late_days: int = 365, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Streaming ``events`` (visitor_id, item_id, event_type, event_time) as numbered rows: session_id (visitor and number, as
    in the batch table), late. A row comes out when the watermark, ``delay_minutes`` behind the latest event, has passed the
    gap after its session; a row that came later than that has late = true and no session. Rows later than ``late_days``
    days are dropped by the engine and counted in its progress reports. Rows without a visitor or a time are left out."""
    behind = late_days * 24 * 60
    processor = SessionNumbers(gap_minutes, behind * 60_000)
    rows = events.where(F.col("visitor_id").isNotNull() & F.col("event_time").isNotNull()).select(
        F.col("visitor_id").cast("string").alias("visitor_id"), F.col("item_id").cast("string").alias("item_id"), "event_type",
        "event_time", F.unix_micros("event_time").alias("event_us"))
    numbered = (rows.withWatermark("event_time", f"{delay_minutes + behind} minutes").groupBy("visitor_id")
                .transformWithStateInPandas(processor, _OUT, "append", "EventTime"))
    session = F.when(~F.col("late"), F.concat("visitor_id", F.lit("_S"), F.col("session_number")))
    return numbered.select("visitor_id", "item_id", "event_type", F.timestamp_micros("event_us").alias("event_time"),
                           session.alias("session_id"), "late")


def run_numbering(numbered: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with session ids, late events) of everything that is available and closed. ``path``: a folder with the output
    of earlier runs and their state, from which this one goes on."""
    spark = numbered.sparkSession
    path = path or scratch_path(spark, "stream-numbers")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # keyed state with timers needs it
    try:
        q = (numbered.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        finally:
            q.stop()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    out = spark.read.schema(numbered.schema).parquet(f"{path}/out")
    return out.where(~F.col("late")).drop("late"), out.where("late").drop("late", "session_id")
