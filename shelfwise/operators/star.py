"""Star-schema builders (B1-B7), synthetic draws (U1 via hash draws) and the
referentially consistent sample (S9).

Synthetic columns are keyed hash draws, not a sequential PRNG: the value of a
row does not depend on partitioning or retries, and the SQL oracle reproduces
it exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numeric import (RANDOM_SEED, hash_uniform, randint_between, round_cents,
                                         round_half_up, uniform_between)
from shelfwise.functions.positions import dense_position

# Fixed values from the reference generator.
GENDERS = ["M", "F", "Autre"]
AGE_RANGE = (18, 75)
COST_MARGIN_RANGE = (0.15, 0.45)
PROMO_PROBABILITY = 0.15
PROMO_DISCOUNT_RANGE = (0.05, 0.30)
PROMO_DURATION_DAYS = (3, 14)
DAYS_OF_COVER = (3, 21)
STOCK_IN_FACTOR = (0.5, 1.5)
SOLD_FACTOR = (0.7, 1.3)
MIN_AVG_DAILY_SALES = 0.1

_SECONDS_PER_DAY = 86400


def _first_order(*extra: str) -> Column:
    """Total order of a product's/customer's lines in time: pandas' sort keeps
    ties in an undefined order, here the order id and the named columns break
    them."""
    return F.struct("invoice_date", "order_id", *extra)


def _non_null_first(value: str, order: Column) -> Column:
    """First non-NULL ``value`` in ``order`` (pandas ``first`` skips NULLs)."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def _non_null_last(value: str, order: Column) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


def sales_bounds(sales: DataFrame) -> Column:
    """One scalar subquery with every whole-table bound the builders need:
    first/last sale (t0, t1), span = max(1, whole days between them) and the
    snapshot date id. Identical subqueries are computed once per query."""
    secs = F.unix_seconds(F.max("invoice_date")) - F.unix_seconds(F.min("invoice_date"))
    return sales.select(F.struct(
        F.min("invoice_date").alias("t0"), F.max("invoice_date").alias("t1"),
        F.greatest(F.lit(1), F.floor(secs / _SECONDS_PER_DAY)).cast("int").alias("span"),
        F.date_format(F.max("invoice_date"), "yyyyMMdd").cast("int").alias("snap"))).scalar()


def span_days(sales: DataFrame) -> Column:
    """max(1, whole days between the first and the last sale)."""
    return sales_bounds(sales).getField("span")


def build_dim_customer(sales: DataFrame) -> DataFrame:
    """B1: registration date = first order, city = first non-null country,
    synthetic age and gender."""
    agg = sales.groupBy("customer_id").agg(
        F.min("invoice_date").alias("registration_date"),
        _non_null_first("country", _first_order("product_id")).alias("city"),
    )
    gender_ix = F.floor(hash_uniform("customer_id", tag="gender") * len(GENDERS)).cast("int")
    return agg.select(
        "customer_id",
        randint_between(*AGE_RANGE, "customer_id", tag="age").cast("smallint").alias("age"),
        F.element_at(F.array(*[F.lit(g) for g in GENDERS]), gender_ix + 1).alias("gender"),
        "city",
        "registration_date",
    )


def grouped_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact (interpolated) median of ``value`` by ``key`` without gathering a
    group's values in one task: values are first counted per (key, value)
    with a map-side partial aggregate, then the two middle values are located
    by a running count over the (much smaller) distinct values of the key. A
    key without any value has a NULL median."""
    # a NULL value counts nothing; a filter instead would make another plan of ``df``, which its other readers could not share
    freq = df.groupBy(key, value).agg(F.count(value).alias("_c"))
    w_run = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    freq = (freq.withColumn("_cum", F.sum("_c").over(w_run))
            .withColumn("_n", F.sum("_c").over(Window.partitionBy(key))))
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= pos) & (pos < F.col("_cum")), F.col(value)))

    return (freq.groupBy(key).agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
            .select(key, (F.col("_lo") + F.lit(0.5) * (F.col("_hi") - F.col("_lo"))).alias(out)))


def build_dim_product(sales: DataFrame) -> DataFrame:
    """B2: first name, exact median price (base), last price (current),
    synthetic cost = round(base * (1 - U(0.15, 0.45)), 2)."""
    firsts = sales.groupBy("product_id").agg(
        _non_null_first("product_name", _first_order("product_name")).alias("product_name"),
        _non_null_last("unit_price", _first_order("unit_price")).alias("current_price"),
    )
    med = grouped_median(sales, "product_id", "unit_price", "base_price")
    ratio = uniform_between(*COST_MARGIN_RANGE, "product_id", tag="cost")
    med = med.withColumnRenamed("product_id", "_mp")
    # both sides have every product; an equality that NULLs satisfy lets no filter reach ``sales`` on one side only, so that
    # both read the same shuffled lines
    return (firsts.join(med, F.col("product_id").eqNullSafe(F.col("_mp")), "left")
            .select("product_id", "product_name", "base_price", "current_price",
                    round_half_up(F.col("base_price") * (1 - ratio), 2).alias("cost_price")))


def build_dim_date(sales: DataFrame) -> DataFrame:
    """Gap-free calendar from the first to the last sale day (Monday = 0).
    The calendar is bounded by the time span, not by the data volume."""
    bounds = sales.agg(F.min("invoice_date").cast("date").alias("lo"),
                       F.max("invoice_date").cast("date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    wd = F.weekday("date")
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_id"),
        "date",
        F.year("date").cast("smallint").alias("year"),
        F.month("date").cast("smallint").alias("month"),
        F.dayofmonth("date").cast("smallint").alias("day"),
        wd.cast("smallint").alias("weekday"),
        (wd >= 5).alias("is_weekend"),
    )


def promotion_draws(products: DataFrame, sales: DataFrame) -> DataFrame:
    """The promoted products with their window and discount, without an id:
    one draw per product (p = 0.15, discount 5-30 %), start offset in
    [0, span-1] days, length 3-14 days, end capped at the last sale. Lazy; the
    other columns of ``products`` stay."""
    bounds = sales_bounds(sales)
    start, end, span = bounds.getField("t0"), bounds.getField("t1"), bounds.getField("span")
    pid = "product_id"
    offset = F.floor(hash_uniform(pid, tag="promo_offset") * span)
    length = randint_between(*PROMO_DURATION_DAYS, pid, tag="promo_length")
    return (products.where(hash_uniform(pid, tag="promo") < PROMO_PROBABILITY)
            .withColumn("start_date", F.timestamp_seconds(F.unix_seconds(start) + offset * _SECONDS_PER_DAY))
            .withColumn("end_date", F.least(
                F.timestamp_seconds(F.unix_seconds("start_date") + length * _SECONDS_PER_DAY), end))
            .withColumn("discount_percentage",
                        round_half_up(uniform_between(*PROMO_DISCOUNT_RANGE, pid, tag="discount"), 2)))


def build_dim_promotion(dim_product: DataFrame, sales: DataFrame) -> DataFrame:
    """The draws with an id, which is the product's position in product_id
    order. The position is the one part that runs jobs (U2); callers that need
    only discounts or windows use :func:`promotion_draws`."""
    positioned = dense_position(dim_product.select("product_id"), ["product_id"], out="_i")
    return promotion_draws(positioned, sales).select(
        F.format_string("PROMO_%06d", F.col("_i")).alias("promotion_id"),
        "product_id", "start_date", "end_date", "discount_percentage")


def build_fact_inventory(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    """One stock snapshot per product at the last sale date.

    avg = quantity / span days (missing -> 0.1, floored at 0.1); opening =
    avg * U{3..21}, in = avg * U(0.5, 1.5), sold = avg * U(0.7, 1.3), each
    rounded half-even; closing = max(0, opening + in - sold).
    """
    bounds = sales_bounds(sales)
    span, snapshot = bounds.getField("span"), bounds.getField("snap")
    qty = sales.groupBy("product_id").agg(F.sum("quantity").alias("_q"))
    pid = "product_id"
    avg = F.greatest(F.coalesce(F.col("_q") / span, F.lit(0.1)), F.lit(MIN_AVG_DAILY_SALES))
    base = dim_product.select(pid).join(qty, pid, "left").withColumn("_avg", avg)

    def units(x: Column) -> Column:
        return F.greatest(F.lit(0), F.bround(x, 0)).cast("int")

    out = base.select(
        pid,
        F.lit(snapshot).cast("int").alias("date_id"),
        units(F.col("_avg") * randint_between(*DAYS_OF_COVER, pid, tag="cover")).alias("opening_stock"),
        units(F.col("_avg") * uniform_between(*STOCK_IN_FACTOR, pid, tag="stock_in")).alias("stock_in"),
        units(F.col("_avg") * uniform_between(*SOLD_FACTOR, pid, tag="sold")).alias("quantity_sold"),
    )
    return out.withColumn(
        "closing_stock",
        F.greatest(F.lit(0), F.col("opening_stock") + F.col("stock_in") - F.col("quantity_sold")).cast("int"))


FACT_SALES_COLUMNS = ["order_id", "customer_id", "product_id", "date_id", "quantity", "unit_price",
                      "discount", "revenue", "cost", "margin"]


def product_side(dim_product: DataFrame, draws: DataFrame) -> DataFrame:
    """What a sale looks up by product: cost, and the promotion's window and
    discount if there is one. One row per product, so that the sales need one
    join; written out first, that join has two shuffled inputs and AQE can
    split a hot product."""
    promo = draws.select(F.col("product_id").alias("_pp"), F.col("start_date").alias("_ps"),
                         F.col("end_date").alias("_pe"), F.col("discount_percentage").alias("_d"))
    return (dim_product.select("product_id", F.col("cost_price").alias("_cp"))
            .join(promo, F.col("product_id") == F.col("_pp"), "left").drop("_pp"))


def build_fact_sales(sales: DataFrame, side: DataFrame) -> DataFrame:
    """Discount of the product's promotion (every sale of a promoted
    product, as coded in the reference; see D1 for the dated variant), cost by
    product, revenue/cost/margin rounded to cents. ``side``: :func:`product_side`;
    it grows with the catalogue, so no broadcast hint."""
    df = (sales.join(side.select("product_id", "_cp", "_d"), "product_id", "left")
          .withColumn("discount", F.coalesce(F.col("_d"), F.lit(0.0))))
    revenue = round_cents(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount")))
    cost_c = round_cents(F.col("quantity") * F.col("_cp"))
    return (df.withColumn("revenue", revenue).withColumn("cost", cost_c)
            .withColumn("margin", round_cents(F.col("revenue") - F.col("cost")))
            .select(*FACT_SALES_COLUMNS))


def build_star_schema(sales: DataFrame) -> dict[str, DataFrame]:
    """The six tables from cleaned sales. Building runs the jobs of the
    promotion ids (B4); a caller that writes all six should first write or
    materialise ``sales``, which every table reads."""
    dim_product = build_dim_product(sales)
    draws = promotion_draws(dim_product.select("product_id"), sales)
    return {
        "dim_customer": build_dim_customer(sales),
        "dim_product": dim_product,
        "dim_date": build_dim_date(sales),
        "dim_promotion": build_dim_promotion(dim_product, sales),
        "fact_sales": build_fact_sales(sales, product_side(dim_product, draws)),
        "fact_inventory": build_fact_inventory(sales, dim_product),
    }


def sample_orders(fact_sales: DataFrame, n: int = 5000, seed: int = RANDOM_SEED) -> DataFrame:
    """S9 (step 1): n distinct orders chosen by a seeded hash order -- the
    limit IS the sampling operator. A TakeOrdered keeps n rows per task."""
    orders = fact_sales.select("order_id").distinct()
    return (orders.withColumn("_h", F.md5(F.concat_ws("#", "order_id", F.lit(str(seed)))))
            .orderBy("_h", "order_id").limit(n).drop("_h"))


def referential_sample(tables: dict[str, DataFrame], n: int = 5000, seed: int = RANDOM_SEED) -> dict[str, DataFrame]:
    """Sampled fact rows plus the product, inventory and promotion rows
    they reference (semi joins; the sample key sets are bounded by n)."""
    chosen = sample_orders(tables["fact_sales"], n, seed)
    facts = tables["fact_sales"].join(chosen, "order_id", "left_semi")
    products = facts.select("product_id").distinct()
    return {
        "fact_sales": facts,
        "dim_product": tables["dim_product"].join(products, "product_id", "left_semi"),
        "fact_inventory": tables["fact_inventory"].join(products, "product_id", "left_semi"),
        "dim_promotion": tables["dim_promotion"].join(products, "product_id", "left_semi"),
    }
