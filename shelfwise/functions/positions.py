"""Global positions (U2) and exact quantiles without a single-partition sort.

A dense 0-based position in a global key order is what ``row_number() OVER
(ORDER BY k) - 1`` gives in SQL; in Spark that window runs in ONE task. Here
instead:

1. range-partition on the key and sort inside each partition; the number of
   partitions follows from the number of rows;
2. materialise that layout with a reliable ``checkpoint()`` so partition
   contents cannot change if a task is retried or an executor is lost;
3. per partition row counts (one tiny row per partition) become offsets by a
   running sum over the partition index;
4. position = offset of the partition + index of the row inside it
   (``monotonically_increasing_id`` keeps the in-partition index in its low 33
   bits).

A range partition never splits rows that are equal in all sort columns, so
positions ask for a total order, or for ``split_ties``: the rows are written
out first, and a hash of each row's place in that written copy becomes the last
sort column, which cuts a group of equal rows like any other range. Quantiles
are full of equal values by nature: they count rows by value first and then
look among the distinct values.

The offsets table has exactly one row per partition, so its broadcast has a
proven size bound.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir, materialize

_LOW_33 = (1 << 33) - 1

# Rows that one sorted partition should hold, about.
ROWS_PER_PARTITION = 2_000_000


def _order_exprs(order_cols) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in order_cols]


def partitions_for(df: DataFrame, rows: int | None) -> int:
    """As many as ``spark.sql.shuffle.partitions`` says, or more if the rows ask for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(rows or 0) // ROWS_PER_PARTITION))


def dense_position(df: DataFrame, order_cols, out: str = "position",
                   num_partitions: int | None = None, rows: int | None = None, split_ties: bool = False) -> DataFrame:
    """Append ``out`` = 0-based rank of each row in ``order_cols`` order.

    The order must be total (add tie-break columns) for a deterministic result.
    ``rows``: the number of rows where it is known or cheap (a footer count);
    it raises the number of partitions above the session's setting.
    ``split_ties``: rows that are equal in all ``order_cols`` may be many; they
    get consecutive positions in an arbitrary order, in several tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    exprs = _order_exprs(order_cols)
    if split_ties:
        df = materialize(df)  # the place of a row in this copy is the same whenever a task is repeated
        rows = df.count() if rows is None else rows
        df = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        exprs.append(F.col("_tie").asc())
    n = num_partitions or partitions_for(df, rows)
    laid_out = df.repartitionByRange(n, *exprs).sortWithinPartitions(*exprs).drop("_tie").checkpoint(eager=True)
    tagged = (laid_out
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33))))
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_idx")).cast("long"))
            .drop("_pid", "_idx", "_off"))


def value_ranks(df: DataFrame, value_cols) -> DataFrame:
    """For each column and distinct non-NULL value: (_name, _v, _c rows with
    the value, _before rows of the column below it, _n rows of the column).

    Rows are counted by value before any ordering (a partial aggregate), so a
    value that most rows share is one row here. The distinct values are laid
    out by range; running sums stay inside a partition and are completed by
    one row per partition and column.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in value_cols])).alias("_p"))
    counts = materialize(pairs.select("_p.*").where(F.col("_v").isNotNull())
                         .groupBy("_name", "_v").agg(F.count(F.lit(1)).alias("_c")))
    n = partitions_for(df, counts.count())
    laid_out = materialize(counts.repartitionByRange(n, "_name", "_v").withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid_out.groupBy("_pid", "_name").agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy("_name").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_pid", "_name", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"),
                           F.sum("_s").over(Window.partitionBy("_name")).alias("_n"))
    return (laid_out.withColumn("_upto", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
            .join(F.broadcast(offsets), ["_pid", "_name"])
            .select("_name", "_v", "_c", (F.col("_off") + F.col("_upto")).alias("_before"), "_n"))


def exact_quantiles_of(df: DataFrame, value_cols, qs) -> DataFrame:
    """One-row DataFrame with a column per value column: an array of its
    linearly interpolated quantiles ``qs`` (pandas/NumPy 'linear', DuckDB
    ``quantile_cont``), NULL for a column without values."""
    ranks = value_ranks(df, value_cols)
    aggs = []
    for q in qs:
        h = F.lit(float(q)) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            there = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
            aggs.append(F.max(F.when(there, F.col("_v"))).alias(f"{side}{len(aggs) // 2}"))
    per = ranks.groupBy("_name").agg(F.max("_n").alias("_n"), *aggs)
    frac = [F.lit(float(q)) * (F.col("_n") - 1) - F.floor(F.lit(float(q)) * (F.col("_n") - 1)) for q in qs]
    values = F.array(*[F.col(f"lo{i}") + f * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i, f in enumerate(frac)])
    per = per.select("_name", values.alias("_q"))
    return per.agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c) for c in value_cols])


def exact_quantiles(df: DataFrame, value_col: str, qs, prefix: str = "q") -> DataFrame:
    """One-row DataFrame with columns ``q0, q1, ...`` for one value column."""
    one = exact_quantiles_of(df.select(F.col(value_col).alias("_value")), ["_value"], qs)
    return one.select(*[F.col("_value")[i].alias(f"{prefix}{i}") for i in range(len(qs))])


def exact_quantile(df: DataFrame, value_col: str, q: float, out: str = "quantile") -> DataFrame:
    """One-row DataFrame with the single quantile ``q`` in column ``out``."""
    return exact_quantiles(df, value_col, [q]).select(F.col("q0").alias(out))
