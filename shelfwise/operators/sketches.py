"""Daily figures that can be added up over any days (K1, K5): sums, counts, and HyperLogLog sketches of distinct keys.

A distinct count of a month cannot be had from those of its days, a sketch can: sketches of days are united without looking at
the facts again. A sketch has a fixed size (2^LG_K places of 4 to 8 bits), so a day's row has one too.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14

#: Relative standard error of an estimate with 2^LG_K places; three of it hold nearly always.
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def daily(rows: DataFrame, day: Column, sums: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """day, n (rows), the sums, and <column>_sketch per column of ``distinct``: one row per day. NULL keys are not counted."""
    return rows.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums],
        *[F.hll_sketch_agg(F.col(c), F.lit(LG_K)).alias(f"{c}_sketch") for c in distinct])


def rolled_up(days: DataFrame, by: Column, name: str, sums: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """The rows of :func:`daily` added up: ``name``, n, the sums, and <column>_distinct, an estimate within a few
    STANDARD_ERRORs."""
    return days.groupBy(by.alias(name)).agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums],
        *[F.hll_sketch_estimate(F.hll_union_agg(F.col(f"{c}_sketch"))).alias(f"{c}_distinct") for c in distinct])
