"""Price elasticity and price simulation.

The per-product regression is a plain grouped aggregate (``regr_slope`` /
``regr_r2`` are algebraic, so partial aggregation runs map-side and a hot
product never gathers its rows in one place). The price grid is built inside
each product row with higher-order array functions: no explode, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_cents, safe_div
from shelfwise.functions.positions import exact_quantile

# Fixed values from the reference.
MIN_DISTINCT_PRICES = 5
MIN_OBSERVATIONS = 20
MIN_PRICE_CV = 0.05
DEFAULT_ASSUMED_ELASTICITY = -1.5
ELASTICITY_BOUNDS = (-10.0, 0.0)
PRICE_GRID_RANGE = (-0.30, 0.30)
PRICE_GRID_POINTS = 13
DEFAULT_DAILY_DEMAND = 0.1


def price_history(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Sales lines with their calendar date. The calendar has one row per
    day of the sales span (bounded by time, not by data volume): broadcast."""
    return (fact_sales.select("product_id", "date_id", "unit_price", "quantity")
            .join(F.broadcast(dim_date.select("date_id", F.col("date").alias("ds"))), "date_id")
            .select("product_id", "ds", "unit_price", "quantity"))


def product_day_panel(history: DataFrame) -> DataFrame:
    """Mean price and units per product and day."""
    return history.groupBy("product_id", "ds").agg(F.avg("unit_price").alias("unit_price"),
                                                   F.sum("quantity").alias("quantity"))


def elasticity_aggregates(panel: DataFrame, key: str = "product_id", price: str = "unit_price",
                          qty: str = "quantity") -> DataFrame:
    """P2 + P3 + P4 on a (key, price, quantity) table: slope of ln(q + 1) on
    ln(p) over rows with p > 0, clipped to [-10, 0]; R^2 (0 when ln(q+1) is
    constant); a product with too few rows / prices / price variation gets the
    assumed -1.5 and no R^2."""
    p = F.col(price)
    pos = p > 0
    x = F.when(pos, F.log(p))
    y = F.when(pos, F.log(F.col(qty) + 1))
    agg = panel.groupBy(key).agg(
        F.count_if(pos).alias("n_observations"),
        F.count_distinct(F.when(pos, p)).alias("_nd"),
        F.avg(F.when(pos, p)).alias("_mean"),
        F.stddev_samp(F.when(pos, p)).alias("_sd"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"),
        F.var_pop(y).alias("_vy"),
    )
    cv = F.coalesce(safe_div(F.col("_sd"), F.col("_mean")), F.lit(0.0))
    eligible = ((F.col("n_observations") >= MIN_OBSERVATIONS) & (F.col("_nd") >= MIN_DISTINCT_PRICES)
                & (cv > MIN_PRICE_CV))
    lo, hi = ELASTICITY_BOUNDS
    return agg.select(
        key,
        F.when(eligible, F.least(F.greatest(F.col("_slope"), F.lit(lo)), F.lit(hi)))
         .otherwise(F.lit(DEFAULT_ASSUMED_ELASTICITY)).alias("elasticity"),
        F.when(eligible, F.when(F.col("_vy") > 0, F.col("_r2")).otherwise(F.lit(0.0))).alias("r_squared"),
        F.col("n_observations").cast("long").alias("n_observations"),
        eligible.alias("is_estimated"),
    )


def estimate_elasticity_all(history: DataFrame) -> DataFrame:
    """Elasticity of every product from its product-day panel."""
    return elasticity_aggregates(product_day_panel(history))


def average_daily_demand(history: DataFrame) -> DataFrame:
    """P5 (per product): mean over sale days of the day's units."""
    daily = history.groupBy("product_id", "ds").agg(F.sum("quantity").alias("_q"))
    return daily.groupBy("product_id").agg(F.avg("_q").alias("avg_daily_demand"))


def grid_pct(i: Column, lo: float, hi: float, n: int) -> Column:
    """The i-th of n evenly spaced steps over [lo, hi] (NumPy linspace:
    lo + i * step, the last point exactly hi)."""
    if n == 1:
        return F.lit(lo)
    step = (hi - lo) / (n - 1)
    return F.when(i == n - 1, F.lit(hi)).otherwise(i * F.lit(step) + F.lit(lo))


def price_curve(current_price: Column, base_demand: Column, cost_price: Column, elasticity: Column,
                lo: float = PRICE_GRID_RANGE[0], hi: float = PRICE_GRID_RANGE[1],
                n: int = PRICE_GRID_POINTS) -> Column:
    """P6-P8 as an ARRAY<STRUCT<i, price, estimated_demand, estimated_revenue,
    estimated_cost, estimated_margin>> built in the row.

    Demand = Q0 (p / p0)^e (P7), 0 when p0 <= 0 or Q0 <= 0."""
    valid = (current_price > 0) & (base_demand > 0)

    def point(i: Column) -> Column:
        price = current_price * (F.lit(1.0) + grid_pct(i, lo, hi, n))
        demand = F.when(valid, base_demand * F.pow(price / current_price, elasticity)).otherwise(F.lit(0.0))
        return F.struct(i.alias("i"), price.alias("price"), demand.alias("estimated_demand"))

    def money(s: Column) -> Column:
        return F.struct(s["i"].alias("i"), s["price"].alias("price"),
                        s["estimated_demand"].alias("estimated_demand"),
                        (s["price"] * s["estimated_demand"]).alias("estimated_revenue"),
                        (cost_price * s["estimated_demand"]).alias("estimated_cost"),
                        (s["price"] * s["estimated_demand"] - cost_price * s["estimated_demand"])
                        .alias("estimated_margin"))

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point), money)


def recommend_price(df: DataFrame, current_price: str = "current_price", base_demand: str = "avg_daily_demand",
                    cost_price: str = "cost_price", elasticity: str = "elasticity",
                    lo: float = PRICE_GRID_RANGE[0], hi: float = PRICE_GRID_RANGE[1],
                    n: int = PRICE_GRID_POINTS) -> DataFrame:
    """Margin-maximising grid price (first on ties = lowest price) and the
    margin at the grid point nearest the current price, per row."""
    p0 = F.col(current_price)
    curve = price_curve(p0, F.col(base_demand), F.col(cost_price), F.col(elasticity), lo, hi, n)
    best = F.array_max(F.transform(curve, lambda c: F.struct(
        c["estimated_margin"].alias("m"), (-c["i"]).alias("neg_i"), c["price"].alias("price"),
        c["estimated_demand"].alias("demand"))))
    near = F.array_min(F.transform(curve, lambda c: F.struct(
        F.abs(c["price"] - p0).alias("dist"), c["i"].alias("i"), c["estimated_margin"].alias("m"))))
    return (df.withColumn("_best", best).withColumn("_near", near)
            .withColumns({
                "recommended_price": round_cents(F.col("_best.price"), 2),
                "price_difference": round_cents(F.col("_best.price") - p0, 2),
                "estimated_demand_at_recommended_price": round_cents(F.col("_best.demand"), 2),
                "estimated_margin_at_current_price": round_cents(F.col("_near.m"), 2),
                "estimated_margin_at_recommended_price": round_cents(F.col("_best.m"), 2),
            })
            .withColumn("elasticity_rounded", round_cents(F.col(elasticity), 3))
            .withColumn("current_price_rounded", round_cents(p0, 2))
            .drop("_best", "_near"))


PRICING_COLUMNS = ["product_id", "current_price", "recommended_price", "price_difference",
                   "estimated_demand_at_recommended_price", "estimated_margin_at_current_price",
                   "estimated_margin_at_recommended_price", "elasticity", "is_estimated", "r_squared",
                   "cost_price", "avg_daily_demand"]


def build_pricing_table(dim_product: DataFrame, history: DataFrame) -> DataFrame:
    """P10: reference prices ⋈ elasticity ⋈ mean daily demand (0.1 when
    missing, kept if > 0) -> recommendation for every product."""
    ref = dim_product.select("product_id", "cost_price", "current_price")
    merged = (ref.join(estimate_elasticity_all(history), "product_id", "left")
              .join(average_daily_demand(history), "product_id", "left")
              .withColumn("avg_daily_demand", F.coalesce("avg_daily_demand", F.lit(DEFAULT_DAILY_DEMAND)))
              .where(F.col("avg_daily_demand") > 0))
    rec = recommend_price(merged)
    return (rec.drop("current_price", "elasticity")
            .withColumnsRenamed({"current_price_rounded": "current_price", "elasticity_rounded": "elasticity"})
            .select(*PRICING_COLUMNS))


def pricing_summary(pricing_table: DataFrame) -> DataFrame:
    """Counts, mean elasticity, median margin uplift % (current margin 0
    -> no uplift), share of products whose price changes."""
    uplift = safe_div(F.col("estimated_margin_at_recommended_price") - F.col("estimated_margin_at_current_price"),
                      F.abs("estimated_margin_at_current_price")) * 100
    med = exact_quantile(pricing_table.select(uplift.alias("u")), "u", 0.5, out="m").select("m").scalar()
    return pricing_table.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_if("is_estimated").alias("n_estimated"),
        F.count_if(~F.col("is_estimated")).alias("n_assumed"),
        # exact mean of 3-decimal values (DECIMAL accumulator, order-independent)
        F.avg(F.col("elasticity").cast("decimal(12,3)")).cast("double").alias("avg_elasticity"),
        F.avg((F.col("price_difference") != 0).cast("double") * 100).alias("pct_price_changed"),
    ).withColumn("median_margin_uplift_pct", med)


# The grid sizes that a request may ask for.
REQUEST_POINTS = (3, 50)


def simulate_requests(pricing_table: DataFrame, requests: DataFrame) -> DataFrame:
    """Custom grids (product_id, lo, hi, n) on the stored (rounded) price
    and elasticity; one row per grid point, all values rounded to cents.

    Every request is answered. ``status`` is ``ok``; ``bad_grid`` if n is not
    within 3..50 or a bound is missing; ``unknown_product`` if the table does
    not have the product. The last two give one row with NULL values.
    """
    t = pricing_table.select("product_id", "current_price", "avg_daily_demand", "cost_price", "elasticity",
                             F.lit(True).alias("_known"))
    good = F.coalesce(F.col("n").between(*REQUEST_POINTS) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.lit(False))
    df = requests.select("product_id", "lo", "hi", "n").join(t, "product_id", "left").withColumn(
        "status", F.when(~good, "bad_grid").when(F.col("_known").isNull(), "unknown_product").otherwise("ok"))
    i, ok = F.col("_i"), F.col("status") == "ok"
    pct = F.when(i == F.col("n") - 1, F.col("hi")).otherwise(
        i * ((F.col("hi") - F.col("lo")) / (F.col("n") - 1)) + F.col("lo"))
    price = F.col("current_price") * (F.lit(1.0) + pct)
    valid = (F.col("current_price") > 0) & (F.col("avg_daily_demand") > 0)
    demand = F.when(valid, F.col("avg_daily_demand") * F.pow(price / F.col("current_price"), F.col("elasticity"))) \
              .otherwise(F.lit(0.0))
    points = F.when(ok, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(None).cast("int")))
    pts = df.withColumn("_i", F.explode(points)).withColumn("_p", F.when(ok, price)).withColumn("_d", F.when(ok, demand))
    return pts.select(
        "product_id", "lo", "hi", "n", "status", F.col("_i").alias("point"),
        round_cents("_p").alias("price"),
        round_cents("_d").alias("estimated_demand"),
        round_cents(F.col("_p") * F.col("_d")).alias("estimated_revenue"),
        round_cents(F.col("cost_price") * F.col("_d")).alias("estimated_cost"),
        round_cents(F.col("_p") * F.col("_d") - F.col("cost_price") * F.col("_d")).alias("estimated_margin"))


def pricing_lookup(pricing_table: DataFrame, requests: DataFrame) -> DataFrame:
    """Pricing answers by product id: every requested id once, ``found`` false
    and NULL values where the table does not have it."""
    asked = requests.select("product_id").distinct()
    return (asked.join(pricing_table.withColumn("found", F.lit(True)), "product_id", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))
