"""File sources S1-S3 with explicit schemas (no inference on large inputs)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLICKSTREAM_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("visitorid", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("itemid", T.LongType()),
    T.StructField("transactionid", T.LongType()),
])

PROPERTY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("itemid", T.LongType()),
    T.StructField("property", T.StringType()),
    T.StructField("value", T.StringType()),
])


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_with_rejects(spark: SparkSession, path: str | list[str], schema: T.StructType,
                      header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files: a line that does not have the schema's number of fields, or a field that is not of its
    type, is no row with gaps but a reject (file, line). Together they are all lines; blank ones count as none."""
    bad = "_rejected_line"
    lines = (spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())]))
             .option("header", header).option("enforceSchema", "true").option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", bad).csv(path).withColumn("_file", F.col("_metadata.file_path")))
    # the reader finds fault only with fields that it is asked for, so both sides ask for all (the condition always holds)
    whole = F.length(F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in schema.fields])) >= 0
    rows = lines.where(F.col(bad).isNull() & whole).drop(bad, "_file")
    return rows, lines.where(F.col(bad).isNotNull() & whole).select(F.col("_file").alias("file"), F.col(bad).alias("line"))


def reject_report(rejects: DataFrame) -> DataFrame:
    """Rejected lines by file, for the cleaning report."""
    return rejects.groupBy("file").agg(F.count(F.lit(1)).alias("rejected_lines"))


def read_raw_sales_with_rejects(spark: SparkSession, paths: list[str],
                                schema: T.StructType | list[T.StructType]) -> tuple[DataFrame, DataFrame]:
    """S1 from CSV files with a schema, or one per file: (order lines under the model's names, rejects)."""
    from shelfwise.operators.clean import normalise_headers
    schemas = schema if isinstance(schema, list) else [schema] * len(paths)
    both = [read_with_rejects(spark, path, own) for path, own in zip(paths, schemas, strict=True)]
    parts = [normalise_headers(strip_column_names(rows)) for rows, _ in both]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts),
            reduce(DataFrame.unionByName, [rejects for _, rejects in both]))


def read_clickstream_with_rejects(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """S2 from CSV files: (events with event_time, rejects)."""
    rows, rejects = read_with_rejects(spark, path, CLICKSTREAM_SCHEMA)
    return rows.withColumn("event_time", F.timestamp_millis("timestamp")), rejects


def read_item_properties_with_rejects(spark: SparkSession, paths: list[str],
                                      prop: str = "categoryid") -> tuple[DataFrame, DataFrame]:
    """S3 from CSV files: (rows of one property, rejects of any)."""
    rows, rejects = read_with_rejects(spark, paths, PROPERTY_SCHEMA)
    return rows.where(F.col("property") == prop), rejects


def read_raw_sales(spark: SparkSession, paths: list[str], fmt: str = "csv",
                   schema: T.StructType | list[T.StructType] | None = None) -> DataFrame:
    """Several sheets/files of order lines as one table (UNION ALL by name). CSV needs a ``schema``, or a list with
    one for each file where the sheets differ. Each part gets the model's column names (C1) before the union, so files
    with the older and the newer header spelling go together."""
    from shelfwise.operators.clean import normalise_headers
    if fmt == "csv" and schema is None:
        raise ValueError("CSV order lines need a schema: inferring one reads the files twice and guesses the types")
    schemas = schema if isinstance(schema, list) else [schema] * len(paths)
    parts = []
    for path, own in zip(paths, schemas, strict=True):
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true").option("enforceSchema", "true").schema(own)
        parts.append(normalise_headers(strip_column_names(reader.load(path))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_clickstream(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Clickstream file(s) with epoch-ms time converted to TIMESTAMP."""
    if fmt == "csv":
        df = spark.read.option("header", "true").schema(CLICKSTREAM_SCHEMA).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.withColumn("event_time", F.timestamp_millis("timestamp"))


def read_item_properties(spark: SparkSession, paths: list[str], prop: str = "categoryid",
                         fmt: str = "csv") -> DataFrame:
    """S3: all property-log files as ONE scan; the property filter reaches the
    reader (Parquet: row-group pruning, CSV: filter during the scan)."""
    if fmt == "csv":
        df = spark.read.option("header", "true").schema(PROPERTY_SCHEMA).csv(paths)
    else:
        df = spark.read.format(fmt).load(paths)
    return df.where(F.col("property") == prop)
