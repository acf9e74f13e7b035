"""Operator 6, exact top-k search by inner product: a KD-tree per shard, best-first traversal.

Vectors are dealt over shards of about SHARD rows by a hash of their id, and each shard becomes one row that holds a
KD-tree: median splits, a tight bounding box per node. Queries are packed into blocks. A pair of a block and a shard is a
unit of work of bounded size. Each block first searches one shard; the k-th score it finds there goes with it to all
others and prunes their boxes from the start.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import materialize

SHARD = 16_384
BLOCK = 256
LEAF = 128


class Tree:
    """Rows ordered so that every node is a range; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n, dim = vectors.shape
        levels = 0
        while dim and n >> levels > LEAF:
            levels += 1
        nodes = (1 << levels + 1) - 1
        order = np.arange(n)
        self.start, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.end[0] = n
        self.leaf = (1 << levels) - 1  # the first leaf
        for i in range(self.leaf):
            a, b = self.start[i], self.end[i]
            part = vectors[order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            self.start[2 * i + 1], self.end[2 * i + 1] = a, a + middle
            self.start[2 * i + 2], self.end[2 * i + 2] = a + middle, b
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.zeros((nodes, dim)), np.zeros((nodes, dim))
        self.first_id = np.zeros(nodes, np.int64)  # the smallest in the node, for ties
        for i in range(nodes - 1, -1, -1):
            if i >= self.leaf:
                part = slice(self.start[i], self.end[i])
                self.low[i], self.high[i] = self.vectors[part].min(0), self.vectors[part].max(0)
                self.first_id[i] = self.ids[part].min()
            else:
                pair = slice(2 * i + 1, 2 * i + 3)
                self.low[i], self.high[i] = self.low[pair].min(0), self.high[pair].max(0)
                self.first_id[i] = self.first_id[pair].min()

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product that a vector in the node's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[float, int]]]:
        """Per query its best (score, id), at most k, the query's own id left out. kth: a score that k vectors elsewhere
        are known to reach, so that lower ones need not be found; -inf if none is."""
        bounds = self.bounds(queries)
        found = []
        for q in range(len(queries)):
            own, vector, bound, floor = int(query_ids[q]), queries[q], bounds[q], kth[q]
            best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
            open_ = [(-bound[0], 0)]
            while open_:
                top, node = heapq.heappop(open_)
                if -top < floor or len(best) == k and -top < best[0][0]:
                    break
                if len(best) == k and -top == best[0][0] and self.first_id[node] > -best[0][1]:
                    continue
                if node < self.leaf:
                    for child in (2 * node + 1, 2 * node + 2):
                        heapq.heappush(open_, (-bound[child], child))
                    continue
                part = slice(self.start[node], self.end[node])
                scores = self.vectors[part] @ vector
                limit = max(floor, best[0][0]) if len(best) == k else floor
                for j in np.flatnonzero(scores >= limit):
                    entry = (float(scores[j]), -int(self.ids[part][j]))
                    if -entry[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            found.append([(s, -i) for s, i in best])
        return found

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "vectors": self.vectors.tobytes(),
                "nodes": np.concatenate([self.start, self.end, self.first_id]).tobytes(),
                "boxes": np.concatenate([self.low, self.high]).tobytes()}

    @classmethod
    def unpack(cls, packed: dict, dim: int) -> Tree:
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(packed["ids"], np.int64)
        tree.vectors = np.frombuffer(packed["vectors"], np.float64).reshape(len(tree.ids), dim)
        tree.start, tree.end, tree.first_id = np.frombuffer(packed["nodes"], np.int64).reshape(3, -1)
        tree.low, tree.high = np.frombuffer(packed["boxes"], np.float64).reshape(2, len(tree.start), dim)
        tree.leaf = len(tree.start) // 2
        return tree


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), int(pdf["dim"][0]))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    packed = Tree(pdf["id"].to_numpy(np.int64), _matrix(pdf)).pack()
    return pd.DataFrame([{"dim": pdf["dim"][0], "shard": pdf["shard"][0], **packed}])


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"dim": pdf["dim"][0], "block": pdf["block"][0], "q_ids": pdf["id"].to_numpy(np.int64).tobytes(),
                          "q_vectors": _matrix(pdf).tobytes()}])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                tree = Tree.unpack(row, row["dim"])
                ids = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_vectors"], np.float64).reshape(len(ids), row["dim"])
                kth = np.frombuffer(row["kth"], np.float64) if row.get("kth") else np.full(len(ids), -np.inf)
                found = tree.search(ids, queries, k, kth)
                flat = [(int(q), i, int(s)) for q, hits in zip(ids, found, strict=True) for s, i in hits]
                query, vec, score = zip(*flat, strict=True) if flat else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()),
                                                  pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


_HITS = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v (array<long>: floor(scale * x) of each component as double), dim of the rows that take part."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(vec_id).cast("long").alias("id"),
                    F.transform(parts, lambda x: F.floor(x * scale)).alias("v"), F.size(vector).alias("dim")))


def _part(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), n)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``vectors``: id, v (array of integers as long), dim. Returns query_id, rank (int, from 1), vec_id, score (long): for every
    row where ``is_query`` holds, the k rows with the highest inner product, or all if there are fewer; ties go to the
    smaller id.

    A query's own id is no candidate. Rows with the same id and vector count once. Only vectors of equal length are
    compared, and empty ones score 0. Products are exact while dim * max|component|^2 is below 2^53 (float64 holds them);
    that is checked, and larger components raise an error. Duplicate vectors are split by place, so no leaf grows with
    them. An empty table, or one without queries, gives an empty table.
    """
    vectors = materialize(vectors.select("id", "v", "dim").distinct())
    spark = vectors.sparkSession
    worst = vectors.agg(F.max(F.col("dim") * F.pow(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)).cast("double"),
                                                   2))).first()[0] or 0
    if worst >= 2 ** 53:
        raise ValueError("components are too large for exact products")
    # one row per vector length: numbers of shards and blocks
    sizes = (vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"),
                                        F.ceil(F.count_if(is_query) / BLOCK).alias("blocks")))
    sizes = materialize(sizes)
    dealt = vectors.join(sizes, "dim")
    trees = materialize(dealt.withColumn("shard", _part(F.col("shards"), 1)).select("dim", "shard", "id", "v")
                        .groupBy("dim", "shard").applyInPandas(_build, "dim int, shard long, ids binary, vectors binary, "
                                                                       "nodes binary, boxes binary"))
    blocks = materialize(dealt.where(is_query).withColumn("block", _part(F.col("blocks"), 2))
                         .select("dim", "block", "id", "v").groupBy("dim", "block")
                         .applyInPandas(_block, "dim int, block long, q_ids binary, q_vectors binary"))
    # the pilot: each block against one shard of its own choice
    pilot = blocks.join(sizes.select("dim", "shards"), "dim").withColumn("shard", F.pmod("block", "shards")).drop("shards")
    near = materialize(pilot.join(trees, ["dim", "shard"]).repartition("dim", "block").mapInArrow(_search(k), _HITS))
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    known = materialize(_with_kth(blocks, dealt.where(is_query).withColumn("block", _part(F.col("blocks"), 2)), kth))
    rest = (known.join(sizes.select("dim", "shards"), "dim")
            .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
            .where(F.col("shard") != F.pmod("block", "shards")).drop("shards"))
    far = rest.join(trees, ["dim", "shard"]).repartition("dim", "block", "shard").mapInArrow(_search(k), _HITS)
    return (_ranked(near.unionByName(far), k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _with_kth(blocks: DataFrame, rows: DataFrame, kth: DataFrame) -> DataFrame:
    """``blocks`` with kth, the pilot's k-th scores in the order of q_ids (-inf where it found fewer)."""
    known = (rows.select("dim", "block", "id").join(kth, rows["id"] == kth["query_id"])
             .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "kth")).alias("pairs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                score = {p["id"]: p["kth"] for p in row["pairs"] or []}
                line = np.array([score.get(int(i), -np.inf) for i in np.frombuffer(row["q_ids"], np.int64)], np.float64)
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("dim", "block", "q_ids", "q_vectors")},
                                                   "kth": line.tobytes()}], schema=arrow)

    arrow = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()),
                       ("kth", pa.binary())])
    return (blocks.join(known, ["dim", "block"], "left")
            .mapInArrow(run, "dim int, block long, q_ids binary, q_vectors binary, kth binary"))
