"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the supplied tables (or tables Spark derives from them) in
full; limits appear only where the limit is the feature (top-k reports,
samples).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import clean, kpi, star
from shelfwise.plans.warehouse import Warehouse

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    # import side effects register the remaining areas
    from shelfwise.plans import (catalog_events, catalog_extras, catalog_forecast,  # noqa: F401
                                 catalog_pricing, catalog_recommend, catalog_streaming)
    return dict(_REGISTRY)


# ---- cleaning and star schema ---------------------------------------------

@register("c7_clean_sales")
def q_clean_sales(spark, sf_dir):
    return Warehouse(spark, sf_dir).sales


@register("c8_cleaning_report")
def q_cleaning_report(spark, sf_dir):
    return clean.cleaning_report(Warehouse(spark, sf_dir).raw_sales)


@register("b1_dim_customer")
def q_dim_customer(spark, sf_dir):
    return Warehouse(spark, sf_dir).dim_customer


@register("b2_dim_product")
def q_dim_product(spark, sf_dir):
    return Warehouse(spark, sf_dir).dim_product


@register("b3_dim_date")
def q_dim_date(spark, sf_dir):
    return Warehouse(spark, sf_dir).dim_date


@register("b4_dim_promotion")
def q_dim_promotion(spark, sf_dir):
    return Warehouse(spark, sf_dir, reuse=True).dim_promotion


@register("b5_fact_inventory")
def q_fact_inventory(spark, sf_dir):
    return Warehouse(spark, sf_dir, reuse=True).fact_inventory


@register("b6_fact_sales")
def q_fact_sales(spark, sf_dir):
    return Warehouse(spark, sf_dir, reuse=True).fact_sales


@register("s9_sample_orders")
def q_sample(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    sample = star.referential_sample(wh.star, n=5000)
    f = sample["fact_sales"]
    return f.groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"),
                                       F.count_distinct("order_id").alias("orders"))


@register("c12_product_search")
def q_product_search(spark, sf_dir):
    return clean.search_products(Warehouse(spark, sf_dir).dim_product, "blue", limit=20)


@register("c13_product_lookup")
def q_product_lookup(spark, sf_dir):
    """Batch point lookups: every product id that appears in the order lines
    (cancelled ones included, so unknown keys answer NULL)."""
    wh = Warehouse(spark, sf_dir)
    requests = clean.normalise_headers(wh.raw_sales).select(F.col("product_id").cast("string")).distinct()
    return clean.lookup_by_key(wh.dim_product.select("product_id", "product_name", "current_price"),
                               requests, "product_id")


# ---- KPIs ------------------------------------------------------------------

@register("k1_global_kpis")
def q_global_kpis(spark, sf_dir):
    return kpi.global_kpis(Warehouse(spark, sf_dir, reuse=True).fact_sales)


@register("k2_catalogue_counts")
def q_catalogue_counts(spark, sf_dir):
    wh = Warehouse(spark, sf_dir)
    return kpi.catalogue_counts(spark, wh.dim_product, wh.dim_customer)


@register("k3_inventory_risk")
def q_inventory_risk(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return kpi.inventory_risk(wh.fact_inventory, wh.dim_product, wh.sales, limit=20, exact=True)


@register("k3a_inventory_risk_integer")
def q_inventory_risk_int(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return kpi.inventory_risk(wh.fact_inventory, wh.dim_product, wh.sales, limit=20, exact=False)


@register("k4_stock_risk_labels")
def q_stock_risk(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    risk = kpi.inventory_risk(wh.fact_inventory, wh.dim_product, wh.sales, limit=None, exact=True)
    return (risk.withColumn("risk", kpi.stock_risk_label(F.col("days_of_stock_estimated")))
            .groupBy("risk").agg(F.count(F.lit(1)).alias("n_products")))


@register("k5_lake_kpis")
def q_lake_kpis(spark, sf_dir):
    return kpi.lake_kpis(Warehouse(spark, sf_dir, reuse=True).fact_sales)


@register("k6_raw_row_count")
def q_raw_count(spark, sf_dir):
    return kpi.raw_row_count(Warehouse(spark, sf_dir).table("lineitem"))
