"""Session numbers on a stream: several batches, a restart, late events."""
import datetime as dt

from pyspark.sql import functions as F

from shelfwise.streaming import numbering

SCHEMA = "visitor_id string, item_id string, event_type string, event_time timestamp"
T0 = dt.datetime(2024, 3, 1, 8)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, path, rows):
    spark.createDataFrame([(v, i, "view", at(m)) for v, i, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, state):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return numbering.run_numbering(numbering.number_sessions(events), state)


def minutes(t):
    return (t - T0).total_seconds() / 60


def test_numbers_go_on_after_a_restart_and_late_events_are_kept(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(spark, source, [("a", "x", 10), ("a", "y", 0), ("a", "z", 40), ("b", "x", 5), ("a", "w", 71), (None, "n", 1)])
    put(spark, source, [("clock", "x", 300)])
    first, late = run(spark, source, state)
    got = sorted((r["visitor_id"], minutes(r["event_time"]), r["session_id"]) for r in first.collect())
    # exactly 30 minutes are no gap, 31 are
    assert got == [("a", 0, "a_S0"), ("a", 10, "a_S0"), ("a", 40, "a_S0"), ("a", 71, "a_S1"), ("b", 5, "b_S0")]
    assert late.count() == 0
    # a new run from the same state: late events, a visitor's next session, and an open one that waits
    put(spark, source, [("a", "late", 60), ("c", "late", 239), ("a", "v", 290), ("b", "u", 241)])
    put(spark, source, [("clock", "x", 900), ("clock", "x", 1000)])
    second, late = run(spark, source, state)
    assert sorted((r["visitor_id"], minutes(r["event_time"])) for r in late.collect()) == [("a", 60), ("c", 239)]
    new = second.where(F.col("event_time") >= at(240))
    got = sorted((r["visitor_id"], minutes(r["event_time"]), r["session_id"]) for r in new.collect())
    assert got == [("a", 290, "a_S2"), ("b", 241, "b_S1"), ("clock", 300, "clock_S0"), ("clock", 900, "clock_S1")]
    assert second.count() == 5 + 4


def test_rows_of_a_visitor_reach_the_state_in_one_call():
    """Each call of the state store is a round trip, so waiting rows go there together."""
    from unittest.mock import MagicMock

    import pandas as pd

    from shelfwise.streaming.numbering import SessionNumbers
    processor, timers = SessionNumbers(30, 0), MagicMock()
    timers.getCurrentWatermarkInMs.return_value = 0
    processor.init(MagicMock())
    processor.pending, processor.last = MagicMock(), MagicMock()
    frames = [pd.DataFrame({"event_us": [5_000_000, 9_000_000], "item_id": ["a", "b"], "event_type": ["view", "view"]}),
              pd.DataFrame({"event_us": [7_000_000], "item_id": [None], "event_type": ["purchase"]})]
    assert list(processor.handleInputRows(("v",), iter(frames), timers)) == []
    (rows,), _ = processor.pending.appendList.call_args
    assert rows == [(5_000_000, "a", "view"), (9_000_000, "b", "view"), (7_000_000, None, "purchase")]
    assert processor.pending.appendList.call_count == 1 and not processor.pending.appendValue.called
