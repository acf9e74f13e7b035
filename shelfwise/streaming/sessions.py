"""Structured Streaming variants of the clickstream operators.

T1: sessions per visitor with ``session_window`` (30-minute gap) behind a
    watermark -- events later than the watermark are dropped, the state of a
    session is released once the watermark passes its end.
T2: event counts per type and hour (tumbling ``window``) behind a watermark.

Both read the clickstream as a file stream (new files are new micro-batches)
and keep only bounded state: open sessions / open hours. They run in append
mode, so a session or hour appears once the watermark has passed its end.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.events import map_event_types
from shelfwise.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def clickstream_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Supplied ``events`` files as a stream, shaped like the batch clickstream
    (epoch-ms time, raw event names) and passed through C9."""
    from shelfwise.sources.adapters import _raw_event_name
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(path)
    raw = ev.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                    F.col("user_id").alias("visitorid"), _raw_event_name().alias("event"),
                    F.get_json_object("props", "$.k").cast("long").alias("itemid"))
    return map_event_types(raw.withColumn("event_time", F.timestamp_millis("timestamp")))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """One row per (visitor, session): start, end (= last event + gap),
    event count."""
    return (events.withWatermark("event_time", watermark)
            .groupBy(F.session_window("event_time", gap).alias("s"), "visitor_id")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("visitor_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events"))


def stream_hourly_counts(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Events per type and hour."""
    return (events.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 hour").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("hour"), "event_type", "n"))


def run_to_files(result: DataFrame, name: str) -> DataFrame:
    """Run a windowed aggregate over everything available, in append mode: a row is written once, when the watermark has
    passed its window, and its state is released. The rows go to Parquet files under the shared folder (which also
    holds the stream's checkpoint) and are read back from there."""
    spark = result.sparkSession
    path = scratch_path(spark, f"stream-{name}")
    q = (result.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(result.schema).parquet(f"{path}/out")
