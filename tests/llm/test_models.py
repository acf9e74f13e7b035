"""Operators 4, 7 and 9: gradients and probabilities against definitions, held-out accuracy on the supplied tables."""
import zlib
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import gru, langid, quality_lm, toxicity
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.01")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# ---- toxicity

def test_gradients_are_the_slopes():
    p = gru.init(5, 8, 3, 2, 4, 3, seed=1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(0)
    steps, batch = 5, 3
    x = rng.standard_normal((5, steps * batch))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], np.float64)
    d = rng.standard_normal(batch)
    _, kept = gru.forward(p, x, mask, keep=True)
    grad, d_x = gru.backward(p, x, mask, kept, d)
    for name, g in [*grad.items(), ("x", d_x)]:
        target = x if name == "x" else p[name]
        for at in [tuple(rng.integers(s) for s in target.shape) for _ in range(4)]:
            old, values = target[at], []
            for step in (1e-3, -1e-3):
                target[at] = old + step
                values.append(float(gru.forward(p, x, mask) @ d))
            target[at] = old
            assert g[at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=2e-2, abs=2e-4), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        at = toxicity.window_starts(n)
        covered = sorted({w for a in at for w in range(a, min(n, a + toxicity.WINDOW))})
        assert covered == list(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(at, at[1:], strict=False))


def test_scores_do_not_depend_on_neighbours():
    model = toxicity.train([(i % 2, [b"good words here" if i % 2 == 0 else b"foul words here"]) for i in range(40)],
                           toxicity.Settings(first_rounds=3, later_rounds=2))
    texts = ["foul " * 100, "", None, "good", "a b c", "x " * 70 + "foul", "?!", "ø"]
    together = toxicity.score_texts(model, pa.array(texts))
    alone = [toxicity.score_texts(model, pa.array([t], pa.string()))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5)
    assert together[0] > 0.7 > together[3] and together[5] > together[4]
    assert [together[i] for i in (1, 2, 6)] == [0, 0, 0]
    assert toxicity.score_texts(toxicity.train([]), pa.array(["a"]))[0] < 0.01


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.Settings(per_label=600, later_rounds=4, windows=16))
    rows = toxicity.score(docs.join(labels, "doc_id"), model).select("doc_id", "score", "toxic").collect()
    unseen = [(r["score"], r["toxic"]) for r in rows if held(r["doc_id"])]
    pos, neg = np.array([s for s, t in unseen if t == 1]), np.array([s for s, t in unseen if t == 0])
    auc = np.mean((pos[:, None] > neg) + (pos[:, None] == neg) / 2)
    assert auc > 0.9, auc
    assert np.mean(neg >= 0.7) < 0.1 and np.mean(pos >= 0.7) > 0.7
    odd = spark.createDataFrame([(None, None, 5), (1, "", 5), (1, "", 5)], "doc_id long, text string, score int")
    assert [r["score"] for r in toxicity.score(odd, model).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_no_held_out_label_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    used = labels.where(~toxicity.held_out(labels["doc_id"])).select("doc_id").collect()
    assert used and not any(held(r["doc_id"]) for r in used)
    n = toxicity.training_sample(docs, labels, toxicity.Settings(per_label=5)).count()
    assert n <= 10


# ---- language

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = toxicity.held_out(docs["doc_id"])
    model = langid.fit(docs.where(~held_out))
    rows = langid.predict(docs, model).collect()
    unseen = [r for r in rows if held(r["doc_id"])]
    assert np.mean([r["lang_pred"] == r["lang"] for r in unseen]) > 0.97
    assert np.mean([r["rejected"] for r in unseen]) < 0.1 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 ?!", 1), (None, "é", 1), (4, "字字字", 1), (4, "字字字", 1)],
                                "doc_id long, text string, rejected int")
    got = langid.predict(odd, model).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False]
    assert got[4]["rejected"] and got[4]["lang_pred"] in model.languages and got[4] == got[5]
    assert langid.predict(odd.limit(0), model).collect() == []
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_trigram_counts():
    got = langid.counts(pa.array(["Ab", None, "ab ab", "aB1", "x\ny", "ab"]))
    assert got[0].sum() == 2 and (got[0] == got[5]).all() and (got[0] == got[3]).all()
    assert got[1].sum() == 0 and got[2].sum() == 5  # " ab", "ab ", "b a", " ab", "ab "


# ---- quality

def kneser_ney(texts):
    """Probabilities by definition: gram -> p, for any gram of four characters."""
    order = quality_lm.ORDER
    grams = [("\x02" * 3 + t)[i:i + 4] for t in texts for i in range(len(t))]
    counts = {order: Counter(grams)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, off = {}, defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(float))
    for n, c in counts.items():
        k = Counter(c.values())
        if k[1] and k[2]:
            y = k[1] / (k[1] + 2 * k[2])
            d = [i + 1 - (i + 2) * y * k[i + 2] / k[i + 1] if k[i + 1] else 0.5 for i in range(3)]
            discount[n] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            discount[n] = [0.5] * 3
        for g, m in c.items():
            total[n][g[:-1]] += m
            off[n][g[:-1]] += discount[n][min(m, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n, h = len(g), g[:-1]
        if not total[n].get(h):
            return p(g[1:])
        m = counts[n][g]
        own = (m - discount[n][min(m, 3) - 1]) / total[n][h] if m else 0.0
        return own + off[n][h] / total[n][h] * p(g[1:])
    return p


def test_perplexity_is_that_of_the_definition(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat", "that hat that cat", "öde 😀 öde", "mat mat mat", "on and on"]
    other = ["the rat", "zzz", "", None, "cat" * 3000, "\x02x", "the rat"]
    ids = [i for i in range(1000) if not held(i)]
    rows = [(ids[i], t, "xx", "c") for i, t in enumerate(texts)] + [(ids[50 + i], t, None, "c") for i, t in enumerate(other)]
    rows += [(None, "the cat", "xx", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(ids[i], 1) for i in range(len(texts))] + [(ids[50], 0), (ids[51], 0), (ids[51], 1), (None, 1)],
                                   "doc_id long, quality int")
    got = quality_lm.classify(docs, labels).collect()
    assert len(got) == len(rows)
    p = kneser_ney(texts)
    for r in got:
        text = next(t for i, t, _, _ in rows if i == r["doc_id"]) or ""
        units = text.encode("utf-16-le").decode("utf-16-le")
        if any(ord(c) > 0xFFFF for c in units):
            continue  # two units
        if not text:
            assert r["perplexity"] is None and not r["keep"] and r["n_chars"] == 0
            continue
        line = "\x02" * 3 + text
        want = -sum(log(p(line[i:i + 4])) for i in range(len(text))) / len(text)
        if "😀" not in "".join(texts):
            assert r["perplexity"] == pytest.approx(exp(want), rel=1e-4)
        assert r["threshold"] is None and r["keep"]


def test_perplexity_without_surrogates(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat", "that hat that cat", "öde öde", "mat mat mat", "on and on"]
    ids = [i for i in range(1000) if not held(i)]
    rows = [(ids[i], t, "xx") for i, t in enumerate(texts + ["the rat", "zzz", "cat" * 3000, "q"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(ids[i], 1) for i in range(len(texts))], "doc_id long, quality int")
    p = kneser_ney(texts)
    for r in quality_lm.classify(docs, labels).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        line = "\x02" * 3 + text
        want = -sum(log(p(line[i:i + 4])) for i in range(len(text))) / len(text)
        assert r["perplexity"] == pytest.approx(exp(want), rel=1e-4), text


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lm.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    good = [r["keep"] for r in rows if r["quality"] == 1 and held(r["doc_id"])]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5
    assert quality_lm.classify(docs.limit(0), labels).collect() == []


def test_quality_threshold_is_the_plain_quantile_of_the_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = quality_lm.classify(docs, labels).join(trusted, "doc_id", "left").where("perplexity is not null").collect()
    langs = 0
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        unseen = sorted(log(r["perplexity"]) for r in own if r["q"] == 1 and held(r["doc_id"]))
        if len(unseen) < quality_lm.MIN_DOCS:
            continue
        langs += 1
        limit = unseen[-(-99 * len(unseen) // 100) - 1]
        for r in own:
            assert log(r["threshold"]) == pytest.approx(limit, abs=quality_lm.BIN)  # whatever the length
            assert r["keep"] or log(r["perplexity"]) > limit - quality_lm.BIN
    assert langs


def test_samples_are_bounded_by_rows_too(spark):
    """One id on very many rows is one document of a sample, the same one whatever the order."""
    rows = [(1, f"der Text Nummer {i}", "de") for i in range(300)] + [(2, "the text", "en"), (2, None, "en"), (3, "nur einer", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._sample(docs, langid.Settings(per_language=2))
    assert sorted((r["doc_id"], r["lang"]) for r in sample) == [(1, "de"), (2, "en"), (3, "de")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, toxic int")
    first, again = (toxicity.training_sample(d, labels, toxicity.Settings()).collect() for d in (docs, docs.orderBy("text").repartition(3)))
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (1, 2, 3))
