"""Operator 8 against all pairs."""
import random
import re

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash as sh
from shelfwise.llm.components import components


def brute_print(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((x for x in m if x is not None), default=None) for g, m in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "déjà", "x y", "e1", "zz", "THE", "of"]
    out = []
    for _ in range(12):
        base = [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(rng.choice([1, 3, 4, 60, 400]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(rng.choice([" ", "\n", "\t \x0b"]).join(copy))
    return out + [None, "", " \n", out[0], out[0].upper() + "\r\n"]


def test_documents(spark):
    data = [(i if i != 7 else None, t, "x", 1) for i, t in enumerate(texts())] + [(3, texts()[3], "y", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, fingerprint string, component_id int")
    got = sh.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, _, _ in data]
    want = sorted(((i, f"{p:016x}", c) for (i, *_), p, c in
                   zip(data, prints, brute_components([d[0] for d in data], prints), strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert sh.near_duplicates(docs.limit(0)).collect() == []
    kept = sh.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted({c for _, _, c in want}, key=repr)


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sh, "TILE", 16)
    monkeypatch.setattr(sh, "SUBTILE", 5)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:20].tolist():  # chains of ever further fingerprints, and a group all near each other
        x = b
        for _ in range(6):
            x ^= 1 << int(rng.integers(63)) | 1 << int(rng.integers(63))
            prints.add(x)
    prints |= {int(base[30]) ^ 1 << int(i) for i in range(40)} | {0, 15, (1 << 63) | 1}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    roots = components(sh.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    got = {p: p for p in signed} | {r["node"]: r["root"] for r in roots}
    want = dict(zip(signed, brute_components(signed, prints), strict=True))
    assert got == want


def test_forest_of_a_dense_group_is_small():
    prints = np.array([1 << i for i in range(64)] + [0], np.uint64)
    a, b = sh.link_tiles(prints, prints, 4)
    assert len(a) == 64 and len(b) == 64  # not 2080 pairs


@pytest.mark.parametrize("words", [0, 1, 3, 4, 5, 1000, 70_000])
def test_long_and_short_fingerprints(words):
    text = " ".join(f"w{i % 777}" for i in range(words))
    assert sh.fingerprint(text) == brute_print(text)
