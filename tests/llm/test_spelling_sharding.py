"""Operators 12 and 13 against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import catalog, sharding, spelling
from tests.conftest import SF_SMALL


def _near(a, b):
    """One inserted, deleted or replaced code point, by definition."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def _groups(counts, ratio=2):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(near)
    rows = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w] = (w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] is not None else None)
    return rows


def _check(spark, counts, ratio=2):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_groups(df, ratio).collect()
    assert {tuple(r) for r in got} == set(_groups(counts, ratio).values()) and len(got) == len(counts)


def test_groups_of_random_words(spark):
    rng = random.Random(11)
    for letters, length in (("ab", 6), ("aé😀", 4), ("abcdefgh", 3)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, length + 1))) for _ in range(150)}
        _check(spark, {w: rng.choice([3, 4, 6, 7, 12, 100, 5000]) for w in words})
    _check(spark, {"aaaaa": 3, "aaaa": 6, "aaaaaa": 6, "aaaab": 12, "a": 1, "b": 1, "": 9}, 1.5)


def test_ways_of_many_forms(spark):
    """A chain in which every word is the form of the one before, and a word with very many variants."""
    chain = {"a" * k + "b" * (30 - k): 3 * 2 ** k for k in range(31)}
    hub = {"hubword": 10 ** 6} | {f"hubword{chr(0x4E00 + i)}": 3 for i in range(300)}
    df = spark.createDataFrame(list((chain | hub).items()), "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_groups(df).collect()}
    assert {got[w]["root"] for w in chain} == {"a" * 30}
    assert {got[w]["root"] for w in hub} == {"hubword"} and got["hubword"]["n_near"] == 300
    assert got["hubword一"]["n_near"] == 300 and got["hubword一"]["form"] == "hubword"


def test_odd_words(spark):
    schema = "n int, word string, extra string, prefix int"
    df = spark.createDataFrame([(5, None, "x", 1), (4, "abcde", "x", 1), (9, "abcdf", "x", 1)], schema)
    assert sorted(tuple(r) for r in spelling.spelling_groups(df).collect()) == [
        ("abcde", "abcdf", "abcdf", 4, 1, 9), ("abcdf", None, "abcdf", 9, 1, None)]
    assert spelling.spelling_groups(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, 1)


def test_a_group_never_makes_pairs(spark):
    """Rows that a group hands on: one per rotation, whatever its size."""
    words = spark.createDataFrame([(f"wor{chr(0x4E00 + i)}d", 3) for i in range(2000)], "word string, n long")
    assert spelling.rotations(words).count() == 2000 * (2 * 5 + 1)
    assert {r["n_near"] for r in spelling.neighbours(words).collect()} == {1999}


def _occurrences(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
        yield run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run


def _brute_counts(rows):
    counts = Counter(w for doc_id, text in rows for w in _occurrences(doc_id, text))
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_query_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = _groups(_brute_counts(docs))
    got = catalog.op12_spelling(spark, SF_SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == set(want.values())


def test_spelling_query_of_odd_documents(spark, tmp_path):
    rows = [(None, "wordsword wordsword wordsword"), (1, None), (2, ""), (3, "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü İstanbul istanbul ISTANBUL stanbul"),
            (3, "÷×÷×÷ a×b÷c A×B÷C " * 3), (4, "letters" * 40_000 + " x")] + [(i, "Wordswords wordswora") for i in range(5, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.op12_spelling(spark, str(tmp_path)).collect()}
    assert got == set(_groups(_brute_counts(rows)).values()) and len(got) == 5


# ---------------------------------------------------------------- sharding


def _shard(key, weights, seed=42):
    def bid(s):
        digits = hashlib.md5(f"{seed}:{s}:{key}".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 0.5) / 16 ** 13) / weights[s]
    return min((s for s in range(len(weights)) if weights[s] > 0), key=lambda s: (bid(s), s))


def test_shards_by_definition(spark):
    rows = [(i, "t", 1) for i in range(500)] + [(None, "t", 1), (None, "u", 2), (7, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    weights = [1.0, 3.0, 0.0, 0.5]
    got = sharding.assign(docs, weights).collect()
    assert len(got) == len(rows)
    assert all(r["shard"] == _shard("null" if r["doc_id"] is None else f"={r['doc_id']}", weights) for r in got)
    with pytest.raises(ValueError):
        sharding.assign(docs, [0.0])
    assert sharding.assign(docs.limit(0), weights).collect() == []


def test_shares_and_moves(spark):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 3.0, 4.0]
    both = sharding.assign(docs, weights)
    for name, other in {"more": [*weights, 5.0], "less": weights[:3], "heavier": [1.0, 2.0, 6.0, 4.0]}.items():
        both = sharding.assign(both, other, out=name)
    got = both.collect()
    share = Counter(r["shard"] for r in got)
    assert all(abs(share[s] / 40_000 - w / 10) < 0.012 for s, w in enumerate(weights))
    assert all(r["more"] in (r["shard"], 4) for r in got)
    assert abs(sum(r["more"] == 4 for r in got) / 40_000 - 1 / 3) < 0.012
    assert all(r["less"] == r["shard"] for r in got if r["shard"] < 3)
    assert all(r["heavier"] in (r["shard"], 2) for r in got)


def test_slots_are_gapless_where_one_row_is_very_common(spark):
    rows = [(1, "same")] * 700 + [(None, "no id")] * 300 + [(i, None) for i in range(100)] + [(3, "other")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    placed = sharding.with_slots(sharding.assign(docs, [1.0] * 5), ["doc_id", "text"]).collect()
    assert len(placed) == len(rows) and Counter((r["doc_id"], r["text"]) for r in placed) == Counter(rows)
    for s in range(5):
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.with_slots(sharding.assign(docs.limit(0), [1.0]), ["doc_id"]).collect() == []


def test_sharding_query(spark, tmp_path):
    rows = [(1, None, 5), (1, None, 5), (2, "é😀", 5), (None, "x", 5), (3, "", 5)] + [(i, "copy", 5) for i in range(4, 300)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op13_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_crc32"]): r for r in got}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        r = by[doc_id, zlib.crc32(raw)]
        key = "null" if doc_id is None else f"={doc_id}"
        assert (r["size"], r["law"]) == (len(raw) + 8, "key")
        assert (r["shard"], r["grown_shard"]) == (_shard(key, [1.0] * 24), _shard(key, [1.0] * 25))


def test_written_shards_are_whole_and_in_order(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    placed = sharding.with_slots(sharding.assign(docs, [1.0, 1.0, 2.0]), ["doc_id"])
    sharding.write_shards(placed, f"{tmp_path}/out", rows_per_file=200)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 3000 and back.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m")) \
        .where("n <> m + 1").count() == 0
    per_file = back.groupBy(F.input_file_name().alias("f"), "shard").agg(
        F.min(F.floor(F.col("slot") / 200)).alias("lo"), F.max(F.floor(F.col("slot") / 200)).alias("hi"))
    assert per_file.where("lo <> hi").count() == 0


def test_sharding_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = sharding.assign(docs, [1.0] * 24)._jdf.queryExecution().executedPlan().toString()
    plan += sharding.with_slots(sharding.assign(docs, [1.0]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)|MapIn", plan)
