"""Operator 8, SimHash near-duplicates: tiled exact comparison of all fingerprints.

Fingerprints are grouped by their population count (the number of 1 bits) and cut into tiles. Two fingerprints
within ``radius`` bits of each other have population counts within ``radius``, so only tiles whose counts are that
near are paired; a pair of tiles is compared in full with exclusive-or and bit counts. A tile pair hands on a
spanning forest of its links, so a group of a thousand alike texts costs a thousand rows, not a million.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfwise.llm import textbytes as tb
from shelfwise.llm.components import components
from shelfwise.session import materialize

#: Distinct fingerprints of a tile, about; a pair of tiles is one unit of work.
TILE = 8192
#: Fingerprints compared at once inside a pair of tiles.
SUBTILE = 512
#: Shingles hashed at once inside a task.
_HASHES = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; summed in bytes, 255 hashes at a time, and then in full."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    sums = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return sums + np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text. Words are runs of bytes other than \\x20 and \\x09-\\x0D with A-Z folded;
    bit i is 1 if it is 1 in over half the XXH64 of the shingles, repeats included. Fewer words than a shingle are
    hashed as one sequence; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    view = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(view == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _HASHES):
        shingles = [joined[a:b] for a, b in zip(first[k:k + _HASHES], last[k:k + _HASHES], strict=True)]
        ones += _ones(np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(seed))), np.uint64))
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` without its text, with __fp (long: the fingerprint's bits, signed)."""
    keep = [c for c in docs.columns if c != text]
    schema = StructType([*(f for f in docs.schema.fields if f.name != text), StructField("__fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches, text, 4 << 20):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))],
                                             names=[*keep, "__fp"])

    return docs.mapInArrow(run, schema)


class _Forest:
    """Union-find over 0..n-1 in which every root is the smallest of its set."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        r = self.parent[nodes]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            hi, lo = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            # of the several links that a root is offered, the smallest is taken; the others wait for the next turn
            np.minimum.at(self.parent, hi, lo)


def link_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between the fingerprints ``a`` and ``b`` (within ``a`` and within ``b`` are not looked at, unless they
    are the same tile), a spanning forest: pairs (fingerprint, smaller-placed fingerprint of its tree)."""
    both = np.concatenate([a, b])
    same = a is b
    forest = _Forest(len(both))
    for i in range(0, len(a), SUBTILE):
        x = a[i:i + SUBTILE, None]
        for j in range(i if same else 0, len(b), SUBTILE):
            near = np.bitwise_count(x ^ b[None, j:j + SUBTILE]) <= radius
            if near.any():
                p, q = np.nonzero(near)
                forest.link(p + i, q + (j if same else j + len(a)))
    nodes = np.arange(len(both))
    roots = forest.roots(nodes)
    child = roots != nodes
    return both[child], both[roots[child]]


def _tiles(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles: pop, part, fps; cells: the pairs of tiles to compare as pop, part, pop_b, part_b).

    Fingerprints of one population count are dealt over tiles by a hash of the fingerprint; the number of tiles of a
    count follows from how many there are. At most 65 counts come to the driver.
    """
    spark = distinct.sparkSession
    pops = dict(distinct.groupBy("pop").count().collect())
    parts = {p: -(-n // TILE) for p, n in pops.items()}
    sizes = spark.createDataFrame([(p, n) for p, n in sorted(parts.items())], "pop int, parts long")
    n_parts = F.broadcast(sizes)  # one row per population count, 65 at most
    tiles = (distinct.join(n_parts, "pop")
             .withColumn("part", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")))
             .groupBy("pop", "part").agg(F.collect_list("fp").alias("fps")))  # about TILE values
    return tiles, sizes


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fps``: distinct fingerprints in column fp (long). Returns edges a, b that connect whatever a chain of links of at
    most ``radius`` differing bits connects."""
    distinct = materialize(fps.select("fp", F.bit_count("fp").cast("int").alias("pop")))
    tiles, sizes = _tiles(distinct)
    tiles = materialize(tiles)
    # the partners of a tile: the same population count from its own part on, and the next counts up to the radius
    near = (tiles.withColumn("pop_b", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
            .join(F.broadcast(sizes.select(F.col("pop").alias("pop_b"), "parts")), "pop_b")
            .withColumn("part_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .where((F.col("pop_b") > F.col("pop")) | (F.col("part_b") >= F.col("part"))))
    other = tiles.select(F.col("pop").alias("pop_b"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b"))
    cells = (near.select("pop", "part", "pop_b", "part_b", "fps").join(other, ["pop_b", "part_b"])
             .repartition("pop", "part", "pop_b", "part_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fps")
            partner = batch.column("fps_b")
            for i in range(batch.num_rows):
                a = own[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                same = (batch.column("pop")[i] == batch.column("pop_b")[i]
                        and batch.column("part")[i] == batch.column("part_b")[i])
                b = a if same else partner[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = link_tiles(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))],
                                                 names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id
    that links lead to, the document's own included. Texts without words (null, empty, white space) have fingerprint
    zero and are linked like any other. A null doc_id is kept and is the smallest of a component only if that has no
    other. Repeated rows are copies like any other. Other columns are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, shingle))
    lowest = materialize(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("id").alias("low")))
    roots = components(near_links(lowest.select("fp"), radius))
    grouped = (lowest.join(roots, lowest["fp"] == roots["node"], "left")
               .select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = grouped.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return (prints.join(classes, "__fp")
            .select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_representatives(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the document with the smallest doc_id
    stays (null ids come last; of several rows with that id, the one whose text hashes lowest, and of equal rows one)."""
    key = [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("__id"),
           F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("__key")]
    prints = materialize(fingerprints(docs.select(*key, "text"), shingle))
    lowest = materialize(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.struct("__id", "__key")).alias("low")))
    roots = components(near_links(lowest.select("fp"), radius))
    grouped = (lowest.join(roots, lowest["fp"] == roots["node"], "left")
               .select(F.coalesce("root", "fp").alias("root"), "low"))
    stay = grouped.groupBy("root").agg(F.min("low").alias("low")).select("low.__id", "low.__key")
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key).join(stay, ["__id", "__key"], "left_semi")
    twin = Window.partitionBy("__id", "__key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return (held.withColumn("__twin", F.row_number().over(twin)).where("__twin = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
