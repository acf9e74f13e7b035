"""Sinks: layered Parquet lake (S4, S5), lake check (S6), typed warehouse
load (S7) and model/serving artefacts (S10). All writes are distributed
``DataFrameWriter`` calls on any Hadoop file system path."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Warehouse column types (the DDL of the star schema).
WAREHOUSE_TYPES = {
    "dim_customer": {"customer_id": "string", "age": "smallint", "gender": "string", "city": "string",
                     "registration_date": "timestamp"},
    "dim_product": {"product_id": "string", "product_name": "string", "category": "string", "subcategory": "string",
                    "brand": "string", "cost_price": "decimal(12,2)", "base_price": "decimal(12,2)",
                    "current_price": "decimal(12,2)"},
    "dim_date": {"date_id": "int", "date": "date", "year": "smallint", "month": "smallint", "day": "smallint",
                 "weekday": "smallint", "is_weekend": "boolean"},
    "dim_promotion": {"promotion_id": "string", "product_id": "string", "start_date": "timestamp",
                      "end_date": "timestamp", "discount_percentage": "decimal(5,4)"},
    "fact_sales": {"order_id": "string", "customer_id": "string", "product_id": "string", "date_id": "int",
                   "quantity": "int", "unit_price": "decimal(12,2)", "discount": "decimal(5,4)",
                   "revenue": "decimal(14,2)", "cost": "decimal(14,2)", "margin": "decimal(14,2)"},
    "fact_inventory": {"product_id": "string", "date_id": "int", "opening_stock": "int", "stock_in": "int",
                       "quantity_sold": "int", "closing_stock": "int"},
    "fact_web_events": {"event_id": "string", "visitor_id": "string", "item_id": "string",
                        "session_id": "string", "event_type": "string", "event_time": "timestamp"},
}
# what a source may not have; such a column is loaded as NULL
OPTIONAL_COLUMNS = {"dim_product": {"category", "subcategory", "brand"}}
# dimensions before facts (foreign-key order)
LOAD_ORDER = ["dim_customer", "dim_product", "dim_date", "dim_promotion", "fact_sales", "fact_inventory",
              "fact_web_events"]


def write_table(df: DataFrame, base: str, layer: str, name: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """One Parquet table per name under ``base/layer/name``."""
    path = f"{base.rstrip('/')}/{layer}/{name}"
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def raw_layer(df: DataFrame) -> DataFrame:
    """Every non-numeric, non-temporal column as STRING; NULL stays NULL."""
    keep = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return df.select([F.col(f.name) if isinstance(f.dataType, keep) else F.col(f.name).cast("string").alias(f.name)
                      for f in df.schema.fields])


def lake_inventory(spark: SparkSession, base: str) -> DataFrame:
    """Objects under ``base`` (path, size) from file metadata only; the
    content column is never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(base))
    return files.select("path", "length")


def check_lake(spark: SparkSession, base: str) -> DataFrame:
    """Object count and bytes; raises when the lake is empty."""
    summary = lake_inventory(spark, base).agg(F.count(F.lit(1)).alias("objects"),
                                              F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    row = summary.first()
    if row["objects"] == 0:
        raise RuntimeError(f"empty lake at {base}: write the raw and processed layers first")
    return summary


def to_warehouse_types(name: str, df: DataFrame) -> DataFrame:
    """Cast a table to its warehouse types (money as DECIMAL at the sink only)."""
    optional = OPTIONAL_COLUMNS.get(name, set()) - set(df.columns)
    return df.select([(F.lit(None) if c in optional else F.col(c)).cast(t).alias(c) for c, t in WAREHOUSE_TYPES[name].items()])


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    return hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()) \
        if place.toUri().getScheme() else hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())


def _point_to(spark: SparkSession, base: str, version: str) -> None:
    """Makes ``version`` the one that readers see: the name is written beside the pointer and moved over it in one step."""
    hadoop = spark._jvm.org.apache.hadoop
    files = _file_system(spark, base)
    new, pointer = hadoop.fs.Path(f"{base}/{version}.new"), hadoop.fs.Path(f"{base}/CURRENT")
    flags = spark._jvm.java.util.EnumSet.of(hadoop.fs.CreateFlag.CREATE, hadoop.fs.CreateFlag.OVERWRITE)
    none = spark._sc._gateway.new_array(hadoop.fs.Options.CreateOpts, 0)
    out = files.create(new, flags, none)
    out.writeBytes(version)
    out.close()
    renames = getattr(hadoop.fs, "Options$Rename")
    over = spark._sc._gateway.new_array(renames, 1)
    over[0] = renames.OVERWRITE
    files.rename(new, pointer, over)


def current_version(spark: SparkSession, base: str) -> str | None:
    """The published version of the warehouse under ``base``; None before the first one."""
    folder = f"{base.rstrip('/')}/warehouse"
    if not _file_system(spark, folder).util().exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")):
        return None
    return spark.read.text(f"{folder}/CURRENT").first()["value"]


def read_warehouse(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the published version."""
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no warehouse was published under {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/warehouse/{version}/{name}")


def publish_warehouse(tables: dict[str, DataFrame], base: str, quality: DataFrame | None, fact_partition: bool = True) -> str:
    """S7, whole or not at all: all tables go to the folder of a new version, and only when every one is there does the
    pointer that readers follow move to it. A load that fails leaves readers with the version before. Tables that are not
    given are those of the version before. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before = current_version(spark, base)
    whole = dict(tables)
    if before is not None:
        whole = {name: read_warehouse(spark, base, name) for name in LOAD_ORDER if name not in tables
                 and _file_system(spark, base).util().exists(
                     spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/warehouse/{before}/{name}"))} | whole
    load_warehouse(whole, base, quality, fact_partition, version)
    _point_to(spark, f"{base.rstrip('/')}/warehouse", version)
    return version


def load_warehouse(tables: dict[str, DataFrame], base: str, quality: DataFrame | None,
                   fact_partition: bool = True, version: str | None = None) -> dict[str, str]:
    """Typed tables written dimensions first; the data-quality report must
    be all zeros, otherwise nothing is written. Only an explicit None, for
    tables that were checked before, loads without a report. fact_sales is
    partitioned by month (date_id // 100) for time pruning. ``version``: a
    folder of its own (see :func:`publish_warehouse`)."""
    if quality is not None:
        bad = quality.where(F.col("violations") != 0).limit(20).collect()
        if bad:
            raise ValueError(f"data-quality violations: {[(r['check'], r['violations']) for r in bad]}")
    out = {}
    for name in LOAD_ORDER:
        if name not in tables:
            continue
        df = to_warehouse_types(name, tables[name])
        parts = None
        if name == "fact_sales" and fact_partition:
            df = df.withColumn("year_month", (F.col("date_id") / 100).cast("int"))
            parts = ["year_month"]
        out[name] = write_table(df, base, f"warehouse/{version}" if version else "warehouse", name, parts)
    return out


def write_artifacts(base: str, artifacts: dict[str, DataFrame]) -> dict[str, str]:
    """serving/model tables (popular items, category popularity, item
    factors and index, visitor lookup, pricing table, known products)."""
    return {name: write_table(df, base, "models", name) for name, df in artifacts.items()}
