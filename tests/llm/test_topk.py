"""Operator 6 against all products."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, k=5):
    data = {}
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            data.setdefault((i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in e)), None)
    out = []
    for i, q in data:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in data if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, topk.top_k(vectors, F.col("id") % 50 == 0, k).collect()))


@pytest.mark.parametrize("shard, block, leaf", [(16_384, 256, 128), (60, 3, 7)])
def test_random_equal_and_odd_vectors(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist(), "x") for i in rng.permutation(400)]
    rows += [(1000 + i, [0.5] * 6, "x") for i in range(150)]  # a hot vector; ties everywhere
    rows += [(2000, None, "x"), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (2100, [float("nan")] + [0.0] * 5, "x"),
             (2150, [float("inf")] + [0.0] * 5, "x"), (None, [9.0] * 6, "x"), (3000, [1.0, 2.0], "x"), (3001, [1.0, -2.0], "x"),
             (3050, [], "x"), (3051, [], "x"), (3100, [4.0], "x"), (rows[0][0], rows[0][1], "twin")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_too_large(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], "x"), (2, [1.0], "x")]) == []
    with pytest.raises(ValueError):
        run(spark, [(0, [1e9], "x"), (1, [1e9], "x")])


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-300, 300, (5000, 8)).astype(float)
    tree = topk.Tree(np.arange(5000), vectors)
    queries = rng.integers(-300, 300, (20, 8)).astype(float)
    bounds = tree.bounds(queries)
    for node in range(len(tree.start)):
        products = queries @ tree.vectors[tree.start[node]:tree.end[node]].T
        assert (products.max(1) <= bounds[:, node]).all()
    assert sorted(tree.ids) == list(range(5000))
