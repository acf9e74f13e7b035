"""Clickstream operators: event cleaning (C9-C11), sessions (E1-E4), event
counts (E5) and the latest-value-per-key read of the property log (E6)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.positions import dense_position

# Fixed values from the reference.
EVENT_TYPE_MAP = {"view": "view", "addtocart": "add_to_cart", "transaction": "purchase"}
EVENT_WEIGHTS = {"view": 1.0, "add_to_cart": 3.0, "purchase": 5.0}
SESSION_GAP_MINUTES = 30
MIN_INTERACTIONS_PER_VISITOR = 5
MIN_INTERACTIONS_PER_ITEM = 5
WEB_EVENT_COLUMNS = ["event_id", "visitor_id", "item_id", "session_id", "event_type", "event_time"]


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_event_types(clicks: DataFrame) -> DataFrame:
    """Keep the three known raw events, rename them, ids as strings."""
    mapped = _literal_map(EVENT_TYPE_MAP)[F.col("event")]
    return (clicks.where(F.col("event").isin(list(EVENT_TYPE_MAP)))
            .select(F.col("visitorid").cast("string").alias("visitor_id"),
                    F.col("itemid").cast("string").alias("item_id"),
                    mapped.alias("event_type"),
                    F.col("event_time")))


def sessionize(df: DataFrame, key: str = "visitor_id", ts: str = "event_time",
               gap_minutes: int = SESSION_GAP_MINUTES, tiebreak: tuple = ("item_id", "event_type"),
               bucket_hours: int = 24) -> DataFrame:
    """Session number per key = running count of gaps > ``gap`` (strict).

    Skew-safe: the lag/running-sum windows are partitioned by (key, time
    bucket), so one very active visitor is spread over many tasks. A per-bucket
    summary (one row per key and bucket) supplies the gap across bucket edges
    and the number of sessions opened in earlier buckets.
    """
    gap_us = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col(ts))
    b = F.floor(micros / F.lit(bucket_hours * 3600 * 1_000_000)).alias("_b")
    w_local = Window.partitionBy(key, "_b").orderBy(ts, *tiebreak)
    local = (df.withColumn("_b", b).withColumn("_us", micros)
             .withColumn("_prev", F.lag("_us").over(w_local))
             .withColumn("_brk", F.coalesce((F.col("_us") - F.col("_prev")) > gap_us, F.lit(False)).cast("int"))
             .withColumn("_run", F.sum("_brk").over(w_local.rowsBetween(Window.unboundedPreceding, 0))))
    w_b = Window.partitionBy(key).orderBy("_b")
    summary = (local.groupBy(key, "_b").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"),
                                            F.sum("_brk").alias("_inner"))
               .withColumn("_edge", F.coalesce((F.col("_first") - F.lag("_last").over(w_b)) > gap_us,
                                               F.lit(False)).cast("int"))
               .withColumn("_before", F.coalesce(
                   F.sum(F.col("_edge") + F.col("_inner")).over(w_b.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .select(key, "_b", "_edge", "_before"))
    return (local.join(summary, [key, "_b"])
            .withColumn("session_seq", (F.col("_before") + F.col("_edge") + F.col("_run")).cast("long"))
            .drop("_b", "_us", "_prev", "_brk", "_run", "_edge", "_before"))


def build_fact_web_events(clicks: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """C9 + E1-E4: sessionised events with ``visitor_S<n>`` session ids and a
    dense ``EVT_<n>`` id in (visitor_id, event_time) order (U2)."""
    ev = map_event_types(clicks)
    sess = sessionize(ev, gap_minutes=gap_minutes)
    sess = sess.withColumn("session_id", F.concat("visitor_id", F.lit("_S"), F.col("session_seq").cast("string")))
    # counted on the raw clicks: for files that is a footer count
    pos = dense_position(sess, ["visitor_id", "event_time", "item_id", "event_type"], out="_pos", rows=clicks.count())
    return pos.withColumn("event_id", F.concat(F.lit("EVT_"), F.col("_pos").cast("string"))).select(*WEB_EVENT_COLUMNS)


def event_type_counts(events: DataFrame) -> DataFrame:
    """E5: events by type, most frequent first."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


def add_weights(events: DataFrame) -> DataFrame:
    """View 1, add_to_cart 3, purchase 5."""
    return events.withColumn("weight", _literal_map(EVENT_WEIGHTS)[F.col("event_type")])


def filter_min_activity(events: DataFrame, min_visitor: int = MIN_INTERACTIONS_PER_VISITOR,
                        min_item: int = MIN_INTERACTIONS_PER_ITEM) -> DataFrame:
    """C11: events whose visitor has >= min_visitor and whose item has >=
    min_item events, both counted on the unfiltered log (one pass, not an
    iterated k-core). Counts are map-side partial aggregates; the semi joins
    run against one row per key (AQE splits a skewed visitor's partition)."""
    v = events.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_visitor)
    i = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_item)
    return (events.join(v.select("visitor_id"), "visitor_id", "left_semi")
            .join(i.select("item_id"), "item_id", "left_semi"))


def load_interactions(mapped: DataFrame, min_visitor: int = MIN_INTERACTIONS_PER_VISITOR,
                      min_item: int = MIN_INTERACTIONS_PER_ITEM) -> DataFrame:
    """C10 + C11 on mapped events (C9; session and event ids are not used): visitor_id, item_id, event_type, event_time, weight."""
    ev = mapped.select("visitor_id", "item_id", "event_type", "event_time")
    return add_weights(filter_min_activity(ev, min_visitor, min_item))


def latest_item_property(props: DataFrame, wanted_items: DataFrame | None = None,
                         prop: str = "categoryid", out: str = "category_id") -> DataFrame:
    """Latest value per item of one property, restricted to wanted items.

    The property filter is pushed into the scan; the semi join keeps only the
    wanted items; the latest value is a ``max_by`` aggregate (partial
    aggregation map-side, no per-item sort). Ties on time take the larger value.
    """
    p = props.where(F.col("property") == prop).select("itemid", "timestamp", "value")
    if wanted_items is not None:
        wanted = wanted_items.select(F.col("item_id").cast("long").alias("itemid")).distinct()
        p = p.join(wanted, "itemid", "left_semi")
    return (p.groupBy("itemid").agg(F.max_by("value", F.struct("timestamp", "value")).alias(out))
            .select(F.col("itemid").cast("string").alias("item_id"), out))
