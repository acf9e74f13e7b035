"""Operator 11 against all periods of all stretches."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import catalog, runs
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def _by_definition(words, min_words=6, periods=4):
    """(start, length, period) of every stretch that is a run, from the definition."""
    out, n = set(), len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(min_words, periods * q) and _smallest_period(words[start:end]) == q:
                out.add((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _texts():
    rng = random.Random(5)
    for alphabet in (1, 2, 3, 5, 40):
        for n in (0, 1, 3, 5, 6, 7, 15, 40, 120):
            yield [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    for _ in range(60):  # blocks that recur, nested and side by side
        words = []
        for _ in range(rng.randrange(1, 6)):
            block = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 12))]
            if rng.random() < 0.5:
                block = block * rng.randrange(1, 6) + [f"w{rng.randrange(9)}"]
            words += (block * rng.randrange(1, 8))[:rng.randrange(1, 70)]
        yield words


@pytest.mark.parametrize(("min_words", "periods"), [(6, 4), (3, 3), (1, 5)])
def test_runs_by_definition(min_words, periods):
    texts = list(_texts())
    words = [w for t in texts for w in t]
    codes = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, end, period = runs.BasicFactors(codes, row).runs(min_words, periods)
    first = np.append(0, np.cumsum([len(t) for t in texts]))
    for i, t in enumerate(texts):
        mine = row[start] == i if len(start) else np.zeros(0, bool)
        got = [(int(a - first[i]), int(b - a), int(q)) for a, b, q in zip(start[mine], end[mine], period[mine], strict=True)]
        assert got == _by_definition(t, min_words, periods), t


def test_columns_of_odd_rows(spark):
    long_ = "x y z " * 30_000
    rows = [(1, None, "clash", 1), (2, "", "c", 1), (3, " \t\n", "c", 1), (4, "a b " * 3 + "a b", "c", 1),
            (None, "a b " * 3 + "a b", "c", 1), (4, "a b " * 3 + "a b", "c", 1), (5, "é é é é é é " * 2, "c", 1),
            (6, long_, "c", 1), (7, "a a a a a", "c", 1), (8, "q a a a a a a\tr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for r, (doc, text, _, _) in zip(got, rows, strict=True):  # rows keep their order within a partition
        words = WORD.findall(text or "")
        want = [(0, 90_000, 3)] if doc == 6 else _by_definition(words)
        assert r["doc_id"] == doc and r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == _collapsed(words, want)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_periods=2)


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(2)
    words = [f"word{rng.randrange(50_000)}" for _ in range(300_000)]
    words[1000:1000] = ["p", "q", "r", "q"] * 5
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(1000, 20, 4)] and got["n_words"] == 300_020
    assert got["collapsed"] == " ".join(words[:1004] + words[1020:])


def test_strongest_is_exact_and_breaks_ties_by_start_then_period(spark):
    cases = {1: [(0, 9, 2), (5, 18, 4), (30, 27, 6)], 2: [(3, 8, 2), (3, 16, 4)], 3: [],
             4: [(0, 2 * 10**9, 5 * 10**8 + 1), (9, 2 * 10**9, 5 * 10**8)]}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], f"id int, runs array<{runs.RUN}>")
    got = {r["id"]: r["best"] for r in df.withColumn("best", runs.strongest(F.col("runs"))).collect()}
    assert tuple(got[1]) == (0, 9, 2) and tuple(got[2]) == (3, 8, 2) and got[3] is None and got[4]["start"] == 9


def _planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in catalog.op11_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > 5

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    for doc_id, text in docs:
        words, r = _planted(doc_id, text), got[doc_id]
        want = _by_definition(words)
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == digest("".join(f"{a},{b},{c}\n" for a, b, c in want))
        assert r["collapsed_sha256"] == digest(_collapsed(words, want))
        if want:
            from fractions import Fraction
            best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None


def test_planting_leaves_rows_without_an_id_or_words(spark):
    rows = [(None, "a b c"), (0, None), (1, ""), (2, " ")] + [(i, "a  b\tc d e f g h") for i in range(3, 60)]
    got = catalog.planted_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (doc_id, text) in zip(got, rows, strict=True):
        assert WORD.findall(r["text"] or "") == _planted(doc_id, text)
