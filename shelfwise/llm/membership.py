"""Which of many keys may belong to a set, told by a Bloom filter of a fixed size.

It is there to leave out rows before a shuffle: a key of the set always passes, another one passes rarely (and always, once
the set is far larger than the filter), so that a join behind it still has to decide, and no result depends on the filter.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Size of a filter (8 MB); with two places per key it lets 1 in 300 others pass at 2 million keys, 1 in 5 at 20 million.
_DIGITS = 26
BITS = 1 << _DIGITS


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """The bits of each key (int64)."""
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return [(h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(64 - _DIGITS)).astype(np.int64)]


class Members:
    """The filter as tasks see it."""

    def __init__(self, held: Broadcast) -> None:
        self.held = held

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        bits = self.held.value
        out = np.ones(len(keys), bool)
        for at in _places(keys):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def members(keys: DataFrame) -> Members:
    """``keys``: one column of longs without nulls. Every task makes a filter of its own keys; these are put together by other
    tasks, so that the driver sees a few (compressed) and holds one."""
    name = keys.columns[0]

    def packed(bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(bits.tobytes())], pa.binary())],
                                          names=["bits"])

    def unpacked(one: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(one), np.uint8)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS >> 3, np.uint8)
        for batch in batches:
            for at in _places(batch.column(name).to_numpy()):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield packed(bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS >> 3, np.uint8)
        for batch in batches:
            for one in batch.column("bits"):
                bits |= unpacked(one.as_py())
        yield packed(bits)

    spark = keys.sparkSession
    # a task holds two filters at most: its keys come in a few partitions only where there are few
    parts = keys.mapInArrow(make, "bits binary").repartition(8).mapInArrow(merge, "bits binary")
    bits = np.zeros(BITS >> 3, np.uint8)
    for row in parts.toLocalIterator():
        bits |= unpacked(bytes(row["bits"]))
    return Members(spark.sparkContext.broadcast(bits))
