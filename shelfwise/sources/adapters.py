"""Shape the supplied TPC-H-like tables into the three raw inputs.

* raw sales   = lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation, with the
  spreadsheet's column names (so the header normalisation C1 runs for real);
* clickstream = events, epoch-millisecond time and the raw event vocabulary;
* property log = one key/value record per event for the event's item.

Each adapter selects only the columns it needs so the Parquet scans are pruned.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_up

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the retail spreadsheet has them.

    Invoice = 'C' || orderkey for returned lines (cancellations), StockCode =
    partkey, Quantity = int(quantity), Price = extendedprice / quantity rounded
    half-up to cents, InvoiceDate = order date, Customer ID = custkey, Country =
    the customer's nation.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                                 "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation (25 rows) is a fixed-size dimension: broadcast is size-safe.
    cust_country = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
    # An order gets its customer before its lines do: orders are fewer and narrower than lines, which then move twice, the
    # second time for the wide product name.
    placed = orders.join(cust_country.select("c_custkey", "n_name"), orders.o_custkey == cust_country.c_custkey, "left")
    lines = (li.join(placed.drop("c_custkey"), li.l_orderkey == placed.o_orderkey)
             .join(part, li.l_partkey == part.p_partkey))
    return lines.select(
        F.concat(F.when(F.col("l_returnflag") == "R", F.lit("C")).otherwise(F.lit("")),
                 F.col("l_orderkey").cast("string")).alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("o_orderdate").cast("timestamp").alias("InvoiceDate"),
        round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("Price"),
        F.col("o_custkey").alias("Customer ID"),
        F.col("n_name").alias("Country"),
    )


# Raw clickstream vocabulary produced from the supplied event types.
RAW_EVENT_NAMES = {"view": "view", "click": "addtocart", "purchase": "transaction"}


def _raw_event_name() -> F.Column:
    c = F.col("event_type")
    expr = c  # signup / error keep their names and are dropped by C9
    for src, dst in RAW_EVENT_NAMES.items():
        expr = F.when(c == src, F.lit(dst)).otherwise(expr)
    return expr


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clickstream rows: timestamp (epoch ms), visitorid, event, itemid, transactionid."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return ev.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("user_id").alias("visitorid"),
        _raw_event_name().alias("event"),
        F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"),
    )


def raw_item_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value property log: timestamp (epoch ms), itemid, property, value.

    Two of three events write the item's 'categoryid', a bucket that moves with
    the ISO week (so "latest value wins" matters); the rest write 'available'.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    item = F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp")
    is_cat = F.pmod(F.col("event_id"), F.lit(3)) != 0
    return ev.select(
        F.unix_millis(ts).alias("timestamp"),
        item.alias("itemid"),
        F.when(is_cat, F.lit("categoryid")).otherwise(F.lit("available")).alias("property"),
        F.when(is_cat, F.pmod(item * 7 + F.weekofyear(ts), F.lit(20)))
         .otherwise(F.pmod(F.col("event_id"), F.lit(2))).cast("string").alias("value"),
    )
