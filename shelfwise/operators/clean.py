"""Cleaning of raw order lines (C1-C8) and catalogue lookups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header spellings of the two spreadsheet versions -> model names.
RENAME_MAP = {
    "Invoice": "order_id",
    "InvoiceNo": "order_id",
    "StockCode": "product_id",
    "Description": "product_name",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "unit_price",
    "UnitPrice": "unit_price",
    "Customer ID": "customer_id",
    "CustomerID": "customer_id",
    "Country": "country",
}

CLEAN_COLUMNS = ["order_id", "product_id", "product_name", "quantity", "invoice_date",
                 "unit_price", "customer_id", "country"]


def normalise_headers(raw: DataFrame) -> DataFrame:
    """Rename whichever spelling is present."""
    present = {k: v for k, v in RENAME_MAP.items() if k in raw.columns}
    return raw.withColumnsRenamed(present)


def _is_cancellation() -> Column:
    return F.col("order_id").startswith("C")


def _rule_flags() -> dict[str, Column]:
    """Per-row outcome of C2-C4 in the order they are applied (NULL fails)."""
    cancelled = F.coalesce(_is_cancellation(), F.lit(False))
    bad_qty = ~cancelled & ~F.coalesce(F.col("quantity") > 0, F.lit(False))
    bad_price = ~cancelled & ~bad_qty & ~F.coalesce(F.col("unit_price") >= 0, F.lit(False))
    no_cust = ~cancelled & ~bad_qty & ~bad_price & F.col("customer_id").isNull()
    return {"cancelled": cancelled, "bad_quantity": bad_qty, "bad_price": bad_price,
            "null_customer": no_cust}


def _typed(raw: DataFrame) -> DataFrame:
    df = normalise_headers(raw)
    return df.withColumns({"order_id": F.col("order_id").cast("string"),
                           "product_id": F.col("product_id").cast("string")})


def _filtered(raw: DataFrame) -> DataFrame:
    """C2-C5 (before distinct)."""
    df = _typed(raw)
    df = df.where(~_is_cancellation())                                    # C2
    df = df.where((F.col("quantity") > 0) & (F.col("unit_price") >= 0))   # C3
    df = df.where(F.col("customer_id").isNotNull())                       # C4
    df = df.withColumn("customer_id",                                      # C5
                       F.concat(F.lit("CUST_"), F.col("customer_id").cast("long").cast("string")))
    return df.select(*CLEAN_COLUMNS)


def clean_sales(raw: DataFrame) -> DataFrame:
    """The cleaned order lines with ``date_id`` = yyyyMMdd.

    The full-row distinct (C6) is a hash aggregate on all columns: partial
    de-duplication runs map-side before the shuffle.
    """
    df = _filtered(raw).dropDuplicates()                                   # C6
    return df.withColumn("date_id", F.date_format("invoice_date", "yyyyMMdd").cast("int"))  # C7


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows in, dropped by each rule, duplicates, kept -- one scan for the
    rule counts and one for the distinct count (a scalar subquery)."""
    flags = _rule_flags()
    typed = _typed(raw)
    kept = clean_sales(raw).select(F.count(F.lit(1))).scalar()
    return typed.agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(v).alias(k) for k, v in flags.items()],
        F.count_if(~flags["cancelled"] & ~flags["bad_quantity"] & ~flags["bad_price"]
                   & ~flags["null_customer"]).alias("_valid"),
    ).select(
        "rows_in", *flags.keys(),
        (F.col("_valid") - kept).alias("duplicates"),
        kept.alias("rows_kept"),
        (F.col("rows_in") - kept).alias("rows_dropped"),
    )


def search_products(dim_product: DataFrame, term: str | None = None, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search; '%' and '_' in the term stay
    wildcards (ILIKE semantics). Ordered by id, top ``limit`` -- a TakeOrdered."""
    df = dim_product.select("product_id", "product_name")
    if term:
        df = df.where(F.col("product_name").ilike(f"%{term}%"))
    return df.orderBy("product_id").limit(limit)


def lookup_by_key(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """C13 in batch form: a request table joined to a keyed serving table.
    Unknown keys come back with NULL columns (the 'None' answer)."""
    return requests.select(key).join(table, key, "left")
