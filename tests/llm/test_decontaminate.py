"""Operator 2 against a search of every window in every text."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words = fold(text)
    hit, found, longest = set(), set(), 0
    for name, item in items:
        own = fold(item)
        size = min(window, len(own))
        for s in range(len(own) - size + 1) if own else ():
            for p in range(len(words) - size + 1):
                if words[p:p + size] == own[s:s + size]:
                    hit.update(range(p, p + size))
                    found.add(str(name))
                    n = size
                    while p + n < len(words) and s + n < len(own) and words[p + n] == own[s + n]:
                        n += 1
                    longest = max(longest, n)
    return len(words), len(hit), longest, sorted(found)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "cd", "ö1", "7"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 12, 40])))) for i in range(8)]
    items += [(100, ""), (101, None), (102, "?!")]
    texts = []
    for _ in range(docs):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]
        if rng.random() < .7:
            words = rng.choice(items[:8])[1].split()
            a = rng.randint(0, len(words) - 1)
            parts.append("--".join(words[a:a + rng.randint(5, 40)]).upper())
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(5)))
        texts.append(".\n".join(parts))
    return texts + [None, "", " . "] + texts[:3], items


@pytest.mark.parametrize("seed", range(4))
def test_shards_find_what_brute_force_finds(seed):
    texts, items = corpus(seed)
    block = dc.TestBlock.of([i for i, _ in items], [t for _, t in items], 10)
    n_words, longest, hit, found = dc._search_piece(pa.array(texts, pa.string()), block)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    for i, text in enumerate(texts):
        want = brute(text, items)
        got = (n_words[i], hit[bounds[i]:bounds[i + 1]].sum(), longest[i], sorted(set(found[i])))
        assert got == want


def test_suffix_array_is_sorted_to_its_depth():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 400)
    symbols[100:200] = symbols[200:300]
    depth = 40
    order = dc.SuffixArray(symbols, depth, 2).order
    assert sorted(order) == list(range(400))

    def key(i):  # up to the first 0, beyond which no search goes
        part = symbols[i:i + depth].tolist()
        return part[:part.index(0) + 1] if 0 in part else part
    keys = [key(i) for i in order]
    assert keys == sorted(keys)


def test_query_columns_blocks_and_odd_rows(spark, monkeypatch):
    texts, items = corpus(11, docs=25)
    docs = spark.createDataFrame([(i if i else None, t, 5, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_hit int, items string")
    table = spark.createDataFrame(items, "item_id long, text string")
    one = {r["doc_id"]: r for r in dc.find_contamination(docs, table).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 40)
    many = {r["doc_id"]: r for r in dc.find_contamination(docs, table).collect()}
    assert one == many and len(one) == len(texts)
    for i, t in enumerate(texts):
        r = one[i if i else None]
        assert (r["n_words"], r["n_hit"], r["longest"], r["items"]) == brute(t, items)
        assert r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"])
        assert sum(s["end"] - s["start"] for s in r["hit_spans"]) == r["n_hit"]
    kept = dc.remove_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in one.items() if not r["contaminated"]}
    assert dc.find_contamination(docs.limit(0), table).collect() == []
    assert not any(r["contaminated"] for r in dc.find_contamination(docs, table.limit(0)).collect())


def test_a_very_long_text_is_searched_to_its_end(spark):
    item = " ".join(f"k{i}" for i in range(12))
    long = " ".join(str(i) for i in range(1_000_000)) + " " + item
    docs = spark.createDataFrame([(1, long), (2, item)], "doc_id long, text string")
    got = dc.find_contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["n_words"], r["n_hit"], r["longest"]) for r in got] == [(1_000_012, 12, 12), (12, 12, 12)]


def test_a_block_is_built_before_the_next_one_is_read(spark, monkeypatch):
    events, read, build = [], dc._blocks, dc.TestBlock.of

    def blocks(*args):
        for block in read(*args):
            events.append("read")
            yield block

    monkeypatch.setattr(dc, "BLOCK_BYTES", 1)
    monkeypatch.setattr(dc, "_blocks", blocks)
    monkeypatch.setattr(dc.TestBlock, "of", lambda *args: events.append("build") or build(*args))
    items = spark.createDataFrame([(str(i), f"one two three {i}") for i in range(3)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three 2"), (2, "one two")], "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in dc.find_contamination(docs, items).collect()}
    assert got == {1: ["2"], 2: []} and events == ["read", "build"] * 3
