"""Registered data-quality (Q1-Q9) and extension (D1-D5) queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_up
from shelfwise.operators import extras, kpi, quality, sketches, star, temporal
from shelfwise.operators import forecast as fc
from shelfwise.operators import recommend as rec
from shelfwise.plans.catalog import register
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import written


def _written(spark, sf_dir):
    """The seven tables, each written once: the report reads them several times."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    tables = {name: written(df) for name, df in wh.star.items()}
    return tables, written(wh.web_events)


@register("q1_q8_quality_report")
def q_quality(spark, sf_dir):
    return quality.quality_report(*_written(spark, sf_dir))


@register("q1_q8_planted_faults")
def q_planted_faults(spark, sf_dir):
    """The report over the same tables with faults planted by rule: every check counts some."""
    t, events = _written(spark, sf_dir)

    def when(condition, value, column):
        return F.when(F.expr(condition), value).otherwise(F.col(column))

    t["fact_sales"] = t["fact_sales"].withColumns({
        "quantity": when("date_id % 29 = 0", F.lit(None), "quantity"),
        "discount": when("date_id % 31 = 0", F.lit(1.5), "discount"),
        "revenue": when("date_id % 37 = 0", F.col("revenue") + 1, "revenue"),
        "customer_id": when("date_id % 41 = 0", F.lit("nobody"), "customer_id"),
        "product_id": when("date_id % 43 = 0", F.lit(None), "product_id")})
    t["fact_inventory"] = t["fact_inventory"].withColumns({
        "closing_stock": when("product_id LIKE '%5'", F.col("closing_stock") + 1, "closing_stock"),
        "stock_in": when("product_id LIKE '%9'", F.lit(-1), "stock_in"),
        "date_id": when("product_id LIKE '%4'", F.lit(None), "date_id"),
        "product_id": when("product_id LIKE '%2'", F.lit("no product"), "product_id")})
    twice = t["dim_product"].where("product_id LIKE '%7'")
    t["dim_product"] = t["dim_product"].withColumn(
        "cost_price", when("product_id LIKE '%3'", F.lit(None), "cost_price")).unionByName(twice)
    t["dim_date"] = t["dim_date"].where("day <> 13").unionByName(t["dim_date"].where("day = 14"))
    t["dim_promotion"] = t["dim_promotion"].withColumns({
        "discount_percentage": when("product_id LIKE '%1'", F.lit(0.31), "discount_percentage"),
        "promotion_id": when("product_id LIKE '%6'", F.lit(None), "promotion_id"),
        "product_id": when("product_id LIKE '%8'", F.lit("no product"), "product_id")})
    t["dim_customer"] = t["dim_customer"].withColumn(
        "customer_id", when("customer_id LIKE '%8'", F.lit(None), "customer_id"))
    events = events.withColumns({
        "event_type": F.when(F.expr("event_id LIKE '%9'"), "hover").when(F.expr("event_id LIKE '%3'"), F.lit(None))
        .otherwise(F.col("event_type")),
        "event_time": when("event_id LIKE '%4'", F.lit(None), "event_time"),
        "event_id": when("event_id LIKE '%0'", F.lit("EVT_0"), "event_id")})
    return quality.quality_report(t, events)


@register("q9_leakage")
def q_leakage(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    panel = fc.fill_missing_dates(fc.daily_demand_by_product(wh.fact_sales, wh.dim_date), group_col="product_id")
    checks = [quality.leakage_check("q9_forecast_split", fc.temporal_split(panel), "ds"),
              quality.leakage_check("q9_recommendation_split", rec.temporal_split(wh.interactions), "event_time")]
    return reduce(DataFrame.unionByName, checks)


@register("d1_dated_discount_sales")
def q_dated_discount(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return extras.dated_discount_sales(wh.sales, wh.product_side)


@register("d2_rfm_segments")
def q_rfm(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return extras.rfm_segments(wh.sales, wh.fact_sales)


@register("d3_product_classes")
def q_classes(spark, sf_dir):
    return extras.classify_products(Warehouse(spark, sf_dir).dim_product)


@register("d4_product_kpis")
def q_product_kpis(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return extras.product_kpis(wh.fact_sales, wh.fact_inventory)


@register("d4_conversion_rate")
def q_conversion(spark, sf_dir):
    return extras.conversion_rate(Warehouse(spark, sf_dir).web_events)


@register("d5_category_rollup")
def q_rollup(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return extras.category_rollup(wh.fact_sales, extras.classify_products(wh.dim_product))


@register("k4_risk_by_product")
def q_risk_by_product(spark, sf_dir):
    """K3 for every product (no top-k cut) with its K4 label."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    risk = kpi.inventory_risk(wh.fact_inventory, wh.dim_product, wh.sales, limit=None, exact=True)
    return risk.withColumn("risk", kpi.stock_risk_label(F.col("days_of_stock_estimated")))


@register("d1_overlapping_promotions")
def q_overlapping_promotions(spark, sf_dir):
    """Sales with the best of several promotions that run at their time: each drawn one, one that begins three days later with
    half the discount, and one that begins six days later with a fifth more."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    draws = star.promotion_draws(wh.dim_product.select("product_id"), wh.sales)
    shifts = F.array(*[F.struct(F.lit(days).alias("days"), F.lit(times).alias("times"), F.lit(name).alias("name"))
                       for days, times, name in ((0, 1.0, "a"), (3, 0.5, "b"), (6, 1.2, "c"))])
    later = F.make_interval(days=F.col("s.days"))
    windows = draws.withColumn("s", F.explode(shifts)).select(
        "product_id", (F.col("start_date") + later).alias("start_date"), (F.col("end_date") + later).alias("end_date"),
        round_half_up(F.col("discount_percentage") * F.col("s.times"), 4).alias("promotion_discount"),
        F.concat("product_id", F.lit(":"), F.col("s.name")).alias("promotion"))
    sales = wh.sales.select("order_id", "product_id", "invoice_date", "quantity", "unit_price")
    return temporal.best_window(sales, windows, "product_id", "invoice_date", "promotion_discount", "promotion")


@register("k1_monthly_from_daily_sketches")
def q_monthly_sketches(spark, sf_dir):
    """Monthly lines and units, added up from daily rows, and whether the distinct orders and products estimated from the
    days' sketches lie within three standard errors of the exact counts."""
    facts = Warehouse(spark, sf_dir).fact_sales.select("date_id", "quantity", "order_id", "product_id")
    keys = ["order_id", "product_id"]
    months = sketches.rolled_up(sketches.daily(facts, F.col("date_id"), ["quantity"], keys),
                                F.floor(F.col("day") / 100).cast("int"), "year_month", ["quantity"], keys)
    exact = facts.groupBy(F.floor(F.col("date_id") / 100).cast("int").alias("year_month")).agg(
        *[F.count_distinct(F.col(c)).alias(c) for c in keys])
    near = [(F.abs(F.col(f"{c}_distinct") - F.col(c)) <= F.greatest(F.lit(1.0), 3 * sketches.STANDARD_ERROR * F.col(c)))
            .alias(f"{c}_within") for c in keys]
    return months.join(exact, "year_month").select("year_month", "n", "quantity", *near)
