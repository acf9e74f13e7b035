"""KPI / OLAP queries (K1-K7)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_away, safe_div


def money_sum(c) -> Column:
    """Exact sum of cent amounts (DECIMAL accumulator), returned as DOUBLE:
    independent of summation order, so identical on any partitioning."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def global_kpis(fact_sales: DataFrame) -> DataFrame:
    """K1: distinct orders, revenue, margin, average basket.

    Planned as a group-by on order_id (partial aggregation, one shuffle)
    followed by a tiny global aggregate instead of a COUNT DISTINCT mixed with
    sums (which Spark would expand into two row copies)."""
    per_order = fact_sales.groupBy("order_id").agg(
        F.sum(F.col("revenue").cast("decimal(18,2)")).alias("_r"),
        F.sum(F.col("margin").cast("decimal(18,2)")).alias("_m"))
    agg = per_order.agg(F.count(F.lit(1)).alias("orders_total"),
                        F.sum("_r").cast("double").alias("revenue_total"),
                        F.sum("_m").cast("double").alias("margin_total"))
    return agg.select(
        "orders_total",
        round_half_away("revenue_total", 2).alias("revenue_total"),
        round_half_away("margin_total", 2).alias("margin_total"),
        round_half_away(safe_div(F.col("revenue_total"), F.col("orders_total")), 2).alias("average_order_value"))


def catalogue_counts(spark: SparkSession, dim_product: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """K2: two scalar subqueries in a one-row result."""
    return spark.range(1).select(
        dim_product.select(F.count(F.lit(1))).scalar().alias("n_products"),
        dim_customer.select(F.count(F.lit(1))).scalar().alias("n_customers"))


def sale_days(sales: DataFrame) -> Column:
    """Scalar: the number of days with a sale, at least 1. Only date_id is read."""
    return F.greatest(F.lit(1), sales.select(F.count_distinct("date_id")).scalar())


def inventory_risk(fact_inventory: DataFrame, dim_product: DataFrame, sales: DataFrame,
                   limit: int | None = 20, exact: bool = True) -> DataFrame:
    """K3: days of stock = closing / (units sold per product / distinct sale
    days), rounded to 1 decimal. With ``limit`` the smallest first (NULL last),
    without it all products in no order. ``sales``: the cleaned sales, whose
    quantities are those of the fact table.

    ``exact=False`` keeps the warehouse's integer arithmetic (K3a): integer
    sum DIV integer day count, then integer closing DIV that; products under
    one unit a day then have no estimate (NULL).
    """
    per_product = sales.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("_q"))
    per_product = per_product.withColumn("_n", sale_days(sales).cast("long"))
    if exact:
        avg = F.expr("_q / _n")
        days = round_half_away(safe_div(F.col("closing_stock"), F.col("_avg")), 1)
    else:
        avg = F.expr("_q div _n")
        days = F.expr("CASE WHEN _avg <> 0 THEN closing_stock div _avg END").cast("double")
    out = (fact_inventory.select("product_id", "closing_stock").where(F.col("closing_stock") > 0)
           .join(dim_product.select("product_id", "product_name"), "product_id")
           .join(per_product.withColumn("_avg", avg), "product_id")
           .select("product_id", "product_name", "closing_stock", days.alias("days_of_stock_estimated")))
    return out.orderBy(F.asc_nulls_last("days_of_stock_estimated"), "product_id").limit(limit) if limit else out


# Stock-risk thresholds in days and their labels.
RISK_THRESHOLDS = [(3, "critical"), (7, "serious"), (14, "warning")]


def stock_risk_label(days: Column) -> Column:
    """K4: NULL -> good, < 3 critical, < 7 serious, < 14 warning, else good."""
    expr = F.lit("good")
    for limit, label in reversed(RISK_THRESHOLDS):
        expr = F.when(days < limit, F.lit(label)).otherwise(expr)
    return F.when(days.isNull(), F.lit("good")).otherwise(expr)


def lake_kpis(fact_sales: DataFrame) -> DataFrame:
    """K5: rows, distinct orders, revenue, margin of the processed sales.
    Per-order partial sums first, then one tiny global aggregate."""
    per_order = fact_sales.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("revenue").cast("decimal(18,2)")).alias("_r"),
        F.sum(F.col("margin").cast("decimal(18,2)")).alias("_m"))
    return per_order.agg(F.sum("_n").cast("long").alias("lines"),
                         F.count(F.lit(1)).alias("orders"),
                         F.sum("_r").cast("double").alias("revenue"),
                         F.sum("_m").cast("double").alias("margin"))


def raw_row_count(raw: DataFrame) -> DataFrame:
    """K6: COUNT(*) of one raw table (Parquet answers it from footers)."""
    return raw.agg(F.count(F.lit(1)).alias("n"))


def sample_visitor_ids(known_visitors: DataFrame, n: int = 10) -> DataFrame:
    """K7: the first n known visitor ids in id order (TakeOrdered)."""
    return known_visitors.select("visitor_id").distinct().orderBy("visitor_id").limit(n)
