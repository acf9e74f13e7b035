"""Documented-but-not-coded rules of the reference."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_cents, round_half_up
from shelfwise.functions.positions import exact_quantiles_of
from shelfwise.session import materialize


def dated_discount_sales(sales: DataFrame, side: DataFrame) -> DataFrame:
    """Discount only when the sale falls inside its product's promotion
    window. ``side``: the product side of B6 (one promotion per product at
    most), so one equi join; the window is checked in the row.
    Revenue/cost/margin as in B6."""
    df = sales.join(side, "product_id", "left")
    inside = F.col("invoice_date").between(F.col("_ps"), F.col("_pe"))
    disc = F.coalesce(F.when(inside, F.col("_d")), F.lit(0.0))
    revenue = round_cents(F.col("quantity") * F.col("unit_price") * (1 - disc))
    cost = round_cents(F.col("quantity") * F.col("_cp"))
    return df.select("order_id", "customer_id", "product_id", "date_id", "quantity", "unit_price",
                     disc.alias("discount"), revenue.alias("revenue"), cost.alias("cost"),
                     round_cents(revenue - cost).alias("margin"))


def rfm_segments(sales: DataFrame, fact_sales: DataFrame) -> DataFrame:
    """Recency (days since the customer's last order, to the last sale
    date), frequency (distinct orders), monetary (revenue); each scored 1-5
    by the exact 20/40/60/80 % cut points (a global NTILE would run in one
    task); recency scores high when recent. segment = 'R F M' digits.

    The three measures are computed once and written out; the twelve cut
    points come from one ranking of their distinct values."""
    last_day = sales.select(F.max("invoice_date").cast("date")).scalar()
    per = (fact_sales.groupBy("customer_id", "order_id").agg(
        F.sum(F.col("revenue").cast("decimal(18,2)")).alias("_r"))
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("frequency"), F.sum("_r").cast("double").alias("monetary"))
        .join(sales.groupBy("customer_id").agg(F.max("invoice_date").cast("date").alias("_last")), "customer_id")
        .withColumn("recency", F.datediff(F.lit(last_day), F.col("_last")))
        .drop("_last"))
    per = materialize(per)
    names, qs = ["recency", "frequency", "monetary"], [0.2, 0.4, 0.6, 0.8]
    cuts = exact_quantiles_of(per, names, qs).select(F.struct(*names)).scalar()

    def score(col: str) -> Column:
        return 1 + sum((F.col(col) > F.col("_cuts")[col][i]).cast("int") for i in range(len(qs)))

    return (per.withColumn("_cuts", cuts)
            .select("customer_id", "recency", "frequency", "monetary",
                    (6 - score("recency")).alias("r_score"), score("frequency").alias("f_score"),
                    score("monetary").alias("m_score"))
            .withColumn("segment", F.concat_ws("", "r_score", "f_score", "m_score")))


# Keyword taxonomy for product names (first match wins).
CATEGORY_RULES = [
    ("bolt|rod|plate", "hardware"),
    ("gear|anvil", "tools"),
    ("widget|gizmo", "gadgets"),
    ("ring", "jewellery"),
]
BRAND_RULES = [("acme", "Acme")]
UNKNOWN = "unknown"


def _first_match(name: Column, rules, default: str) -> Column:
    expr = F.lit(default)
    for pattern, label in reversed(rules):
        expr = F.when(name.rlike(f"(?i)\\b({pattern})\\b"), F.lit(label)).otherwise(expr)
    return expr


def classify_products(dim_product: DataFrame) -> DataFrame:
    """D3: category / subcategory / brand from the product name; 'unknown'
    when no rule matches (never invented)."""
    name = F.col("product_name")
    all_words = "|".join(p for p, _ in CATEGORY_RULES)
    sub = F.regexp_extract(F.lower(name), f"\\b({all_words})\\b", 1)
    return dim_product.select(
        "product_id", "product_name",
        _first_match(name, CATEGORY_RULES, UNKNOWN).alias("category"),
        F.when(sub == "", F.lit(UNKNOWN)).otherwise(sub).alias("subcategory"),
        _first_match(name, BRAND_RULES, UNKNOWN).alias("brand"))


def product_kpis(fact_sales: DataFrame, fact_inventory: DataFrame) -> DataFrame:
    """D4 (product level): revenue, margin, margin rate, units, current
    stock, stock rotation (units sold / closing stock) and overstock flag
    (stock above 90 days of average sales over the sale days)."""
    n_days = F.greatest(F.lit(1), fact_sales.select(F.count_distinct("date_id")).scalar())
    per = fact_sales.groupBy("product_id").agg(
        F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"),
        F.sum(F.col("margin").cast("decimal(18,2)")).cast("double").alias("margin"),
        F.sum("quantity").cast("long").alias("units"))
    inv = fact_inventory.select("product_id", F.col("closing_stock").alias("current_stock"))
    out = per.join(inv, "product_id", "left")
    avg_daily = F.col("units") / n_days
    return out.select(
        "product_id", "revenue", "margin",
        round_half_up(F.when(F.col("revenue") != 0, F.col("margin") / F.col("revenue")), 6).alias("margin_rate"),
        "units", "current_stock",
        round_half_up(F.when(F.col("current_stock") > 0, F.col("units") / F.col("current_stock")), 6)
        .alias("stock_rotation"),
        (F.col("current_stock") > avg_daily * 90).alias("overstock_risk"))


def conversion_rate(web_events: DataFrame) -> DataFrame:
    """D4 (commercial): sessions with a purchase / all sessions."""
    per = web_events.groupBy("session_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("_p"))
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("_p").cast("long").alias("purchasing_sessions"),
                   round_half_up(F.sum("_p") / F.count(F.lit(1)), 6).alias("conversion_rate"))


def category_rollup(fact_sales: DataFrame, classified: DataFrame) -> DataFrame:
    """Revenue and margin rolled up by category > subcategory (ROLLUP:
    detail rows, category subtotals and a grand total)."""
    df = fact_sales.select("product_id", "revenue", "margin").join(
        classified.select("product_id", "category", "subcategory"), "product_id")
    return (df.rollup("category", "subcategory").agg(
        F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"),
        F.sum(F.col("margin").cast("decimal(18,2)")).cast("double").alias("margin"),
        F.grouping_id().alias("level")))
