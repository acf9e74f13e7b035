"""Registered pricing queries (S8, P1-P12). Reported doubles that come out of
sums/regressions are rounded to 6 decimals (summation order differs between
engines in the last bits)."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_up
from shelfwise.operators import clean, pricing
from shelfwise.plans.catalog import register
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import materialize, written


def _history(wh: Warehouse):
    """Read twice (elasticity and mean demand), so written once."""
    return written(pricing.price_history(wh.fact_sales, wh.dim_date))


def _r6(*cols):
    return {c: round_half_up(c, 6) for c in cols}


@register("s8_price_history")
def q_price_history(spark, sf_dir):
    return _history(Warehouse(spark, sf_dir, reuse=True))


@register("p1_product_day_panel")
def q_panel(spark, sf_dir):
    panel = pricing.product_day_panel(_history(Warehouse(spark, sf_dir, reuse=True)))
    return panel.withColumns(_r6("unit_price")).withColumn("quantity", F.col("quantity").cast("long"))


@register("p3_elasticity")
def q_elasticity(spark, sf_dir):
    e = pricing.estimate_elasticity_all(_history(Warehouse(spark, sf_dir, reuse=True)))
    return e.withColumns(_r6("elasticity", "r_squared"))


@register("p5_avg_daily_demand")
def q_avg_demand(spark, sf_dir):
    return pricing.average_daily_demand(_history(Warehouse(spark, sf_dir, reuse=True))).withColumns(_r6("avg_daily_demand"))


def _pricing_table(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return pricing.build_pricing_table(wh.dim_product, _history(wh))


@register("p8_price_curves")
def q_price_curves(spark, sf_dir):
    """The 13-point curve of every product, one row per point."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    h = _history(wh)
    base = (wh.dim_product.select("product_id", "cost_price", "current_price")
            .join(pricing.estimate_elasticity_all(h), "product_id", "left")
            .join(pricing.average_daily_demand(h), "product_id", "left")
            .withColumn("avg_daily_demand", F.coalesce("avg_daily_demand", F.lit(pricing.DEFAULT_DAILY_DEMAND))))
    curve = pricing.price_curve(F.col("current_price"), F.col("avg_daily_demand"), F.col("cost_price"),
                                F.col("elasticity"))
    pts = base.select("product_id", F.explode(curve).alias("c")).select("product_id", "c.*")
    return pts.select("product_id", F.col("i").alias("point"),
                      *[round_half_up(c, 4).alias(c) for c in ("price", "estimated_demand", "estimated_revenue",
                                                               "estimated_cost", "estimated_margin")])


@register("p10_pricing_table")
def q_pricing_table(spark, sf_dir):
    return _pricing_table(spark, sf_dir).withColumns(_r6("r_squared", "avg_daily_demand"))


@register("p11_pricing_summary")
def q_pricing_summary(spark, sf_dir):
    s = pricing.pricing_summary(_pricing_table(spark, sf_dir))
    return s.withColumns(_r6("avg_elasticity", "pct_price_changed", "median_margin_uplift_pct"))


@register("p12_custom_simulation")
def q_custom_simulation(spark, sf_dir):
    """Custom grids (-20 %..+20 %) for every product of the table: 5 points, and the rejected sizes 2 and 51; and an id
    that the table does not have."""
    table = materialize(_pricing_table(spark, sf_dir))
    lo, hi = F.lit(-0.2).alias("lo"), F.lit(0.2).alias("hi")
    req = table.select("product_id", lo, hi, F.explode(F.array(F.lit(5), F.lit(2), F.lit(51))).alias("n"))
    unknown = spark.createDataFrame([("no such product", 5), ("no such product", 2)], "product_id string, n int")
    answers = pricing.simulate_requests(table, req.unionByName(unknown.select("product_id", lo, hi, "n")))
    return answers.withColumn("point", F.coalesce("point", F.lit(-1)))


@register("p10_pricing_lookup")
def q_pricing_lookup(spark, sf_dir):
    """Pricing answers for every product id of the raw order lines and one that does not exist."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    asked = clean.normalise_headers(wh.raw_sales).select(F.col("product_id").cast("string")).distinct()
    asked = asked.unionByName(spark.createDataFrame([("no such product",)], "product_id string"))
    found = pricing.pricing_lookup(pricing.build_pricing_table(wh.dim_product, _history(wh)), asked)
    return found.select("product_id", "found", "current_price", "recommended_price", "elasticity",
                        F.coalesce("is_estimated", F.lit(False)).alias("is_estimated"))
