"""Registered streaming queries (T1, T2): every event file available, in append mode, so the result holds the sessions and
hours that the watermark (one hour behind the last event) has closed."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans.catalog import register
from shelfwise.streaming import numbering
from shelfwise.streaming import sessions as st


@register("t1_stream_sessions")
def q_stream_sessions(spark, sf_dir):
    ev = st.clickstream_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet")
    out = st.run_to_files(st.stream_sessions(ev), "t1_sessions")
    return out.select("visitor_id", "session_start", "session_end", F.col("n_events").cast("long").alias("n_events"))


@register("t2_stream_hourly_counts")
def q_stream_hourly(spark, sf_dir):
    ev = st.clickstream_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet")
    out = st.run_to_files(st.stream_hourly_counts(ev), "t2_hourly")
    return out.select("hour", "event_type", F.col("n").cast("long").alias("n"))


@register("t1_stream_session_numbers")
def q_stream_session_numbers(spark, sf_dir):
    """The session ids of E3 given on the stream, for the sessions that the watermark has closed."""
    ev = st.clickstream_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet")
    numbered, _ = numbering.run_numbering(numbering.number_sessions(ev))
    return (numbered.groupBy("visitor_id", "session_id")
            .agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
                 F.count(F.lit(1)).alias("n_events")))
