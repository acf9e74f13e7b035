"""Data-quality rules (Q1-Q9) as violation counts.

Each rule is one aggregate over one table (a single scan with partial
aggregation, or an anti join for referential integrity); the report is their
UNION ALL: (check, violations). Zero everywhere means the warehouse is sound.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_cents

ALLOWED_EVENT_TYPES = ["view", "add_to_cart", "remove_from_cart", "purchase"]


def key_violations(*key: str) -> Column:
    """Q1: rows with a NULL in the key + duplicate keys."""
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in key])
    one = F.when(whole, F.col(key[0]) if len(key) == 1 else F.struct(*key))
    return F.count_if(~whole) + F.count(one) - F.count_distinct(one)


def broken(rule: Column) -> Column:
    """Rows for which the rule is not true; a NULL in it counts as broken."""
    return F.count_if(~F.coalesce(rule, F.lit(False)))


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules of one table in one aggregate, as rows (check, violations)."""
    one = df.agg(*[v.cast("long").alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations"))
                                          for k in rules])).alias("r")).select("r.*")


def _orphans(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Q5: child rows whose key has no parent row; a NULL key has none."""
    without = child.select(key).join(parent.select(key), key, "left_anti")
    return _rules(without, {name: F.count(F.lit(1))})


def quality_report(t: dict[str, DataFrame], web_events: DataFrame | None = None) -> DataFrame:
    """(check, violations) over the six tables and the events. Each table is
    read by one aggregate for its own rules and by one anti join per foreign
    key; hand in tables that are written out, as all of them are read again."""
    fs, fi, dp, dd, pr, dc = (t["fact_sales"], t["fact_inventory"], t["dim_product"], t["dim_date"],
                              t["dim_promotion"], t["dim_customer"])
    revenue = round_cents(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount")))
    checks = [
        _rules(dc, {"q1_customer_key": key_violations("customer_id")}),
        _rules(dp, {"q1_product_key": key_violations("product_id"),
                    "q2_product_prices": broken((F.col("cost_price") >= 0) & (F.col("base_price") >= 0)
                                                & (F.col("current_price") >= 0))}),
        _rules(dd, {"q1_date_key": key_violations("date_id")}),
        _rules(fs, {"q2_sales_ranges": broken((F.col("quantity") > 0) & (F.col("unit_price") >= 0)
                                              & (F.col("revenue") >= 0) & F.col("discount").between(0, 1)),
                    "q3_revenue_margin": broken(
                        (F.abs(F.col("revenue") - revenue) <= 0.005)
                        & (F.abs(F.col("margin") - round_cents(F.col("revenue") - F.col("cost"))) <= 0.005))}),
        _rules(fi, {"q1_inventory_key": key_violations("product_id", "date_id"),
                    "q2_stock_ranges": broken((F.col("opening_stock") >= 0) & (F.col("stock_in") >= 0)
                                              & (F.col("quantity_sold") >= 0) & (F.col("closing_stock") >= 0)),
                    "q4_closing_stock": broken(F.col("closing_stock") == F.greatest(
                        F.lit(0), F.col("opening_stock") + F.col("stock_in") - F.col("quantity_sold")))}),
        _rules(pr, {"q1_promotion_key": key_violations("promotion_id"),
                    "q7_promotion_rules": broken((F.col("discount_percentage") > 0)
                                                 & (F.col("discount_percentage") <= 0.30)
                                                 & (F.col("start_date") <= F.col("end_date")))}),
        _orphans("q5_sales_customer_fk", fs, dc, "customer_id"),
        _orphans("q5_sales_product_fk", fs, dp, "product_id"),
        _orphans("q5_sales_date_fk", fs, dd, "date_id"),
        _orphans("q5_inventory_product_fk", fi, dp, "product_id"),
        _orphans("q5_promotion_product_fk", pr, dp, "product_id"),
        # the calendar is bounded by the time span: one ordered window is fine
        _rules(dd.withColumn("_gap", F.datediff("date", F.lag("date").over(Window.orderBy("date")))),
               {"q6_calendar_gaps": F.count_if(F.col("_gap") != 1)}),
    ]
    if web_events is not None:
        checks.append(_rules(web_events, {
            "q1_event_key": key_violations("event_id"),
            "q8_event_types": broken(F.col("event_type").isin(ALLOWED_EVENT_TYPES) & F.col("event_time").isNotNull())}))
    return reduce(DataFrame.unionByName, checks)


def leakage_check(name: str, split: DataFrame, time_col: str, test_flag: str = "is_test") -> DataFrame:
    """Q9: 1 when max(train time) >= min(test time), else 0."""
    agg = split.agg(F.max(F.when(~F.col(test_flag), F.col(time_col))).alias("_tr"),
                    F.min(F.when(F.col(test_flag), F.col(time_col))).alias("_te"))
    return agg.select(F.lit(name).alias("check"),
                      F.when(F.col("_tr") >= F.col("_te"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("violations"))
