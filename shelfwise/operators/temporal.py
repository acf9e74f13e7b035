"""Joins on time: the best of several windows that hold a moment (D1), and the last value before it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_window(rows: DataFrame, windows: DataFrame, key: str, at: str, value: str, tie: str,
                start: str = "start_date", end: str = "end_date") -> DataFrame:
    """``rows`` with ``value`` and ``tie`` of the window (start <= at <= end) of the same key that has the greatest value, of
    equal ones the smallest tie; both NULL where no window holds the row. Every row stays once.

    Windows are cut into days, and the windows of one key and day become one row, so the join is on (key, day), has one
    match at most and is dealt by day as well: the rows of a very common key are spread over its days, and AQE splits what
    is left. A window has a row for each of its days, and an array has the windows that overlap on one day.
    """
    days = windows.select(
        F.col(key).alias("_key"), F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("_day"),
        F.struct((-F.col(value)).alias("minus"), F.col(tie).alias("tie"), F.col(start).alias("lo"), F.col(end).alias("hi"),
                 F.col(value).alias("value")).alias("w"))
    by_day = days.groupBy("_key", "_day").agg(F.array_sort(F.collect_list("w")).alias("_windows"))
    found = rows.withColumn("_at_day", F.to_date(at)).join(
        by_day, (F.col(key) == F.col("_key")) & (F.col("_at_day") == F.col("_day")), "left")
    best = F.get(F.filter("_windows", lambda w: (w["lo"] <= F.col(at)) & (F.col(at) <= w["hi"])), F.lit(0))
    return found.withColumn("_best", best).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_best.value").alias(value),
                                                  F.col("_best.tie").alias(tie))


def as_of(rows: DataFrame, log: DataFrame, key: str, at: Column, log_at: Column, value: str, out: str,
          bucket_hours: int = 7 * 24) -> DataFrame:
    """``rows`` with ``out``: the value of the latest ``log`` row of the same key at or before the row's time, of equally late
    ones the greatest; NULL if there is none. ``at`` and ``log_at`` are microseconds (long). Every row stays once; a NULL key
    or time has no value.

    Rows and log are sorted together by time within (key, time bucket), so a very common key is spread over its buckets; the
    last value of the buckets before comes from one row per key and bucket.
    """
    bucket = F.floor(F.col("_us") / F.lit(bucket_hours * 3_600_000_000))
    mine = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(key).alias("_key"), at.alias("_us"),
                       F.lit(1).alias("_kind"), F.lit(None).cast(log.schema[value].dataType).alias("_value"))
    said = log.select(F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), log_at.alias("_us"),
                      F.lit(0).alias("_kind"), F.col(value).alias("_value")).where("_value IS NOT NULL")
    both = mine.unionByName(said).withColumn("_bucket", bucket)
    inside = (Window.partitionBy("_key", "_bucket").orderBy("_us", "_kind", "_value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = both.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = both.groupBy("_key", "_bucket").agg(
        F.max(F.when(F.col("_kind") == 0, F.struct("_us", "_value"))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"),
                          F.last(F.col("_end._value"), ignorenulls=True).over(earlier).alias("_carried"))
    joined = local.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b")), "left")
    known = F.col("_key").isNotNull() & F.col("_us").isNotNull()
    return joined.select("_row.*", F.when(known, F.coalesce("_here", "_carried")).alias(out))
