"""Operator 13, weighted rendezvous sharding.

Every shard draws a number for a record's key; the shard with the least -ln(draw) / weight gets the record. The draw depends
on the key and the number of the shard only. So a new shard takes over just the records for which it draws best, a removed
one gives away its own, and a changed weight moves records to or from that shard alone; a shard's share of the keys is its
share of the weights.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.positions import dense_position

#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def key_text(key: Column) -> Column:
    """The key as text; a null key differs from every text."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def draw(key: Column, shard: Column, seed: int = 42) -> Column:
    """The number, above 0 and below 1, that a shard draws for a key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), shard.cast("string"), key).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16 ** _DIGITS))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 42) -> Column:
    """The shard (0 to len(weights) - 1) of a key (see :func:`key_text`). Shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more, one at least above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w])
    bids = F.transform(shards, lambda s: F.struct((-F.ln(draw(key, s["shard"], seed)) / s["weight"]).alias("bid"),
                                                  s["shard"].alias("shard")))
    return F.array_min(bids)["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", out: str = "shard", seed: int = 42) -> DataFrame:
    """All columns of ``docs``, then ``out`` (int). A narrow projection: nothing is shuffled. Equal keys share a shard; null
    keys are one key of their own. A column named ``out`` is replaced."""
    return docs.drop(out).withColumn(out, rendezvous(key_text(F.col(f"`{key}`")), weights, seed))


def with_slots(sharded: DataFrame, order: Sequence[str], shard: str = "shard", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """All columns, then slot (long): 0, 1, ... without a gap within each shard.

    A shard's rows are in the seeded order of their keys (a shuffle that reruns repeat), then by the ``order`` columns; rows
    equal in all of these are interchangeable. All shards are numbered at once by one range partitioning of the rows, split
    finer than shards and keys, and the counts of the shards (one row each) are taken off. A column named slot is replaced.
    """
    rows = sharded.drop("slot")
    mixed = F.md5(F.concat_ws(":", F.lit(seed), key_text(F.col(f"`{key}`"))).cast("binary"))
    placed = dense_position(rows.withColumn("__mixed", mixed), [shard, "__mixed", *order], out="__position", split_ties=True)
    first = placed.groupBy(F.col(shard).alias("__shard")).agg(F.min("__position").alias("__first"))
    numbered = placed.join(F.broadcast(first), F.col(shard).eqNullSafe(F.col("__shard")))
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__position") - F.col("__first")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000, shard: str = "shard") -> None:
    """Rows with slots as Parquet, one folder per shard, its files in the order of the slots. Files are dealt by shard and
    slot range, so a large shard is written by many tasks."""
    part = F.floor(F.col("slot") / F.lit(rows_per_file))
    (sharded.withColumn("__part", part).repartition(F.col(shard), F.col("__part")).sortWithinPartitions(shard, "slot")
     .drop("__part").write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path))
