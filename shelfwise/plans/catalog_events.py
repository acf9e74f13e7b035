"""Registered clickstream queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import events, temporal
from shelfwise.plans.catalog import register
from shelfwise.plans.warehouse import Warehouse


@register("c9_mapped_events")
def q_mapped_events(spark, sf_dir):
    return Warehouse(spark, sf_dir).mapped_events


@register("e4_fact_web_events")
def q_fact_web_events(spark, sf_dir):
    return Warehouse(spark, sf_dir).web_events


@register("e3_sessions")
def q_sessions(spark, sf_dir):
    """One row per session: size, first and last event time."""
    ev = Warehouse(spark, sf_dir).web_events
    return ev.groupBy("visitor_id", "session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"))


@register("e5_event_type_counts")
def q_event_type_counts(spark, sf_dir):
    return events.event_type_counts(Warehouse(spark, sf_dir).mapped_events)


@register("e6_item_categories")
def q_item_categories(spark, sf_dir):
    return Warehouse(spark, sf_dir).item_categories


@register("c11_interactions")
def q_interactions(spark, sf_dir):
    return Warehouse(spark, sf_dir).interactions


@register("e6_category_as_of")
def q_category_as_of(spark, sf_dir):
    """Every mapped event with the category that its item had at that time."""
    wh = Warehouse(spark, sf_dir)
    log = (wh.item_properties.where(F.col("property") == "categoryid")
           .select(F.col("itemid").cast("string").alias("item_id"), F.col("timestamp").alias("said_at"), "value"))
    ev = wh.mapped_events.select("visitor_id", "item_id", "event_type", "event_time")
    return temporal.as_of(ev, log, "item_id", F.unix_micros("event_time"), F.col("said_at") * 1000, "value", "category_id")


@register("c11_interactions_strict")
def q_interactions_strict(spark, sf_dir):
    """C11 with limits that leave out a part of the supplied visitors and items: 40 and 60 events."""
    return events.load_interactions(Warehouse(spark, sf_dir).mapped_events, 40, 60)
