"""Operator 4, toxicity: a bidirectional GRU with attention pooling over character and word inputs.

The network is trained in numpy on a bounded sample of labelled documents and then scores all overlapping windows of
every text; the score of a document is that of its highest window. A label belongs to a document and not to a window,
so training starts with the windows that have words which stand out in documents of label 1, and goes on with the windows
that score highest.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfwise.llm import gru
from shelfwise.llm import textbytes as tb
from shelfwise.llm.decontaminate import _FOLD, _WORD

#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 32, 16
#: Rows of the trigram table; trigrams share rows by hash.
TRIGRAMS = 1 << 13
MIN_DOCS = 4
#: Windows scored at once.
BATCH = 2048
#: The logit of a score of 0.7, which the fitted cut between the labels is shifted to.
CUT_LOGIT = float(np.log(0.7 / 0.3))


@dataclass(frozen=True)
class Settings:
    """per_label: labelled documents of each label that training may use, chosen by a hash of doc_id. windows: windows of
    each of them, spread evenly over its text. vocabulary: words with an embedding of their own, the most frequent by
    document among those in MIN_DOCS sampled documents at least; other words have their characters only. A round goes
    through its windows as often as it takes for ``steps`` steps of 256. One document in four of the sample is not trained on: it places the cut between the labels."""

    per_label: int = 1800
    windows: int = 24
    vocabulary: int = 8192
    word_dim: int = 8
    char_dim: int = 8
    hidden: int = 8
    attention: int = 8
    first_rounds: int = 1
    later_rounds: int = 8
    steps: int = 24
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes; word i + 1 of the embedding, 0 is any other word
    params: gru.Params


class Words:
    """The words of some texts: vocabulary ids, and character vectors as sums over byte trigrams."""

    def __init__(self, column: pa.Array) -> None:
        raw, self.offsets = tb.utf8(column)
        raw = _FOLD[raw]
        self.starts, self.ends = tb.spans(_WORD[raw], self.offsets)
        self.first = tb.rows_of(self.starts, self.offsets)
        self.hashes = tb.PrefixHash(raw).of(self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.raw = raw

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of the trigram table for every byte of a word with its neighbours, first of them for every word)."""
        here = np.where(_WORD[self.raw], self.raw, 0x20).astype(np.uint32)
        before, after = np.roll(here, 1), np.roll(here, -1)
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[edges] = 0x20
        after[edges - 1] = 0x20
        code = (before * np.uint32(0x10001) ^ here * np.uint32(0x101) ^ after) * np.uint32(0x9E3779B1)
        code >>= np.uint32(32 - TRIGRAMS.bit_length() + 1)
        inside = _WORD[self.raw]
        upto = np.concatenate([[0], np.cumsum(inside)])
        return code[inside].astype(np.int64), upto[self.starts]


def _char_vectors(table: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(char_dim, words): tanh of the mean of the trigram vectors of each word."""
    count = np.diff(np.append(first, len(code))).astype(np.float32)
    out = np.empty((len(table), len(first)), np.float32)
    for d, row in enumerate(table):
        np.divide(np.add.reduceat(row[code], first), count, out=out[d])
    return np.tanh(out, out=out)


def _ids(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin: every STRIDE words, the last one at the end of the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sample_windows(settings: Settings):
    """Text of the sampled windows of each row; a word counts up to 64 bytes, so a row's sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches):
            words = Words(piece.column("text"))
            ends = np.minimum(words.ends, words.starts + 64)
            out = []
            for i in range(piece.num_rows):
                a, b = words.first[i], words.first[i + 1]
                at = window_starts(int(b - a))
                if len(at) > settings.windows:
                    at = at[np.linspace(0, len(at) - 1, settings.windows).astype(int)]
                out.append([b" ".join(words.raw[s:e].tobytes() for s, e in
                                      zip(words.starts[a + w:min(a + w + WINDOW, b)], ends[a + w:min(a + w + WINDOW, b)],
                                          strict=True)) for w in at])
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(out, pa.list_(pa.binary()))],
                                             names=["toxic", "windows"])

    return run


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """toxic, windows of the documents that training may use: labelled 0 or 1, crc32(doc_id) mod 3 not 1, at most
    settings.per_label of each label. A document with several labels is toxic if one of them is 1."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(settings.per_label).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(settings.per_label))
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows that share an id are one document of the sample: the row whose text has the least hash
    text = text.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")
    return text.mapInArrow(_sample_windows(settings), "toxic int, windows array<binary>")


def _window_words(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, words of every window, trigrams of every word, trigrams per word); taken piece by piece, as the
    arrays behind the hashes are many times the text."""
    text = pa.array([t.decode("utf-8", "replace") for t in windows], pa.string())
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64))]
    for piece in tb.pieces([pa.RecordBatch.from_arrays([text], names=["text"])], max_bytes=tb.PIECE_BYTES // 4):
        words = Words(piece.column("text"))
        code, first = words.trigrams()
        out.append((words.hashes, np.diff(words.first), code.astype(np.int16), np.diff(np.append(first, len(code)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def train(sample: list[tuple[int, list[bytes]]], settings: Settings = Settings()) -> Model:
    """sample: (label, windows) of each document. Without both labels the model gives the share of label 1 to all."""
    sample = sorted((y, list(w)) for y, w in sample if w)
    label = np.array([y for y, _ in sample], np.float32)
    owner = np.repeat(np.arange(len(sample)), [len(w) for _, w in sample])
    n_windows = len(owner)
    hashes, length, code, sizes = _window_words([t for _, w in sample for t in w])
    distinct, word = np.unique(hashes, return_inverse=True)
    doc_of_word = owner[np.repeat(np.arange(n_windows), length)] if n_windows else np.zeros(0, int)
    in_docs = np.bincount(np.unique(word.astype(np.int64) * max(1, len(sample)) + doc_of_word) // max(1, len(sample)),
                          minlength=len(distinct)) if len(word) else np.zeros(0, int)
    frequent = np.flatnonzero(in_docs >= MIN_DOCS)
    frequent = frequent[np.argsort(-in_docs[frequent], kind="stable")][:settings.vocabulary]
    vocabulary = np.sort(distinct[frequent])
    p = gru.init(len(vocabulary) + 1, TRIGRAMS, settings.word_dim, settings.char_dim, settings.hidden, settings.attention,
                 settings.seed)
    model = Model(vocabulary, p)
    if not n_windows or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        p["out"][:] = 0
        p["out_b"][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    ids = _ids(vocabulary, hashes)
    stops = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.cumsum(length) - length
    rng = np.random.default_rng(settings.seed)
    adam = gru.Adam(p, settings.rate)
    share = float(label.mean())
    weight = np.where(label > 0, min(4.0, max(1.0, (1 - share) / share) ** 0.5), 1.0).astype(np.float32)

    def inputs(windows: np.ndarray):
        steps = min(WINDOW, int(length[windows].max(initial=1)))
        place = begin[windows][None, :] + np.arange(steps)[:, None]
        mask = (np.arange(steps)[:, None] < length[windows][None, :]).astype(np.float32)
        place = np.where(mask > 0, place, 0).ravel()
        used, back = np.unique(place, return_inverse=True)
        sizes = stops[used + 1] - stops[used]
        at = np.cumsum(sizes) - sizes
        mine = np.repeat(stops[used] - at, sizes) + np.arange(sizes.sum())
        chars = _char_vectors(p["char"], code[mine], at)
        x = np.concatenate([p["word"][:, ids[used]], chars])[:, back]
        return x, mask, (used, back, mine, at, chars)

    def learn(windows: np.ndarray) -> None:
        size = min(256, len(windows))
        turns = max(1, -(-settings.steps * size // len(windows)))
        order = np.concatenate([rng.permutation(windows) for _ in range(turns)])
        for k in range(0, len(order), size):
            part = order[k:k + size]
            x, mask, (used, back, mine, at, chars) = inputs(part)
            logit, kept = gru.forward(p, x, mask, keep=True)
            y = label[owner[part]]
            d = ((1 / (1 + np.exp(-logit)) - y) * weight[owner[part]] / len(part)).astype(np.float32)
            grad, d_x = gru.backward(p, x, mask, kept, d)
            by_word = np.stack([np.bincount(back, row, len(used)) for row in d_x]).astype(np.float32)
            w = settings.word_dim
            grad["word"] = np.stack([np.bincount(ids[used], row, len(vocabulary) + 1) for row in by_word[:w]]).astype(np.float32)
            sizes = np.diff(np.append(at, len(mine)))
            each = by_word[w:] * (1 - chars * chars) / sizes
            grad["char"] = np.stack([np.bincount(code[mine], np.repeat(row, sizes), TRIGRAMS) for row in each]).astype(np.float32)
            adam.update(grad)

    aside = rng.permutation(len(sample)) % 4 == 3
    aside &= label[aside].min(initial=1) < label[aside].max(initial=0)  # a tiny sample is all trained on
    own = np.flatnonzero(~aside[owner])

    def logits(windows: np.ndarray) -> np.ndarray:
        return np.concatenate([gru.forward(p, *inputs(windows[k:k + BATCH])[:2]) for k in range(0, len(windows), BATCH)])

    def highest(each: int) -> np.ndarray:
        logit, doc = logits(own), owner[own]
        order = np.lexsort((-logit, doc))
        doc = doc[order]
        rank = np.arange(len(own)) - np.searchsorted(doc, doc, "left")
        return own[order[(rank == 0) | ((label[doc] == 0) & (rank < each))]]

    # a start: words that stand out in documents of label 1, and the windows that have most of them
    trained = ~aside
    z = _standing_out(ids, doc_of_word, label, trained, len(vocabulary) + 1)
    marks = np.bincount(np.repeat(np.arange(n_windows), length), np.maximum(z[ids] - 2, 0), n_windows)
    toxic_windows = own[label[owner[own]] == 1]
    marked = toxic_windows[marks[toxic_windows] > 0]
    start = np.concatenate([marked if len(marked) else toxic_windows, own[label[owner[own]] == 0]])
    for _ in range(settings.first_rounds):
        learn(start)
        learn(own)
        learn(start)
    for k in range(settings.later_rounds):
        adam.rate = settings.rate * (0.5 if k < settings.later_rounds // 2 else 0.2)
        learn(highest(4))
    judged = aside if aside.any() else np.ones(len(sample), bool)
    windows = np.flatnonzero(judged[owner])
    top = np.full(len(sample), -np.inf, np.float32)
    np.maximum.at(top, owner[windows], logits(windows))
    p["out_b"] -= np.float32(_cut(top[judged], label[judged]) - CUT_LOGIT)
    return model


def _standing_out(ids: np.ndarray, doc: np.ndarray, label: np.ndarray, trained: np.ndarray, size: int) -> np.ndarray:
    """For each vocabulary word, by how many standard errors its share of the label-1 documents is above that of the others;
    0 for words outside the vocabulary."""
    pair = np.unique(ids * len(label) + doc)
    word, at = pair // len(label), pair % len(label)
    keep = trained[at]
    word, one = word[keep], label[at[keep]]
    n1, n0 = label[trained].sum(), (1 - label[trained]).sum()
    a, b = np.bincount(word, one, size), np.bincount(word, 1 - one, size)
    share = (a + b + 0.5) / (n1 + n0 + 1)
    z = (a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[0] = 0
    return z


def _cut(logit: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap between two documents that parts the labels best, a false alarm counting twice."""
    order = np.argsort(logit, kind="stable")
    logit, label = logit[order], label[order]
    missed = np.concatenate([[0], np.cumsum(label)]) / label.sum()
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - label)]) / (1 - label).sum()
    k = int(np.argmin(missed + 2 * alarms))
    below = logit[k - 1] if k else logit[0] - 1
    above = logit[k] if k < len(logit) else logit[-1] + 1
    return float(below + above) / 2


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model for the labels in ``labels`` (doc_id, toxic); what comes to the driver is bounded by ``settings``."""
    rows = training_sample(docs, labels, settings).collect()
    return train([(r["toxic"], [bytes(w) for w in r["windows"]]) for r in rows], settings)


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """The score of each text, 0.0 for one without words."""
    p = model.params
    words = Words(column)
    counts = np.diff(words.first)
    best = np.full(len(counts), -np.inf, np.float32)
    if not counts.any():
        return np.zeros(len(counts))
    ids = _ids(model.vocabulary, words.hashes)
    chars = _char_vectors(p["char"], *words.trigrams())
    n_windows = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), n_windows)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = words.first[row] + np.minimum(turn * STRIDE, np.maximum(counts[row] - WINDOW, 0))
    size = np.minimum(counts[row], WINDOW)
    order = np.argsort(size, kind="stable")  # short texts together, so that few batches need a mask
    for k in range(0, len(order), BATCH):
        part = order[k:k + BATCH]
        steps = int(size[part].max())
        mask = (np.arange(steps)[:, None] < size[part][None, :]).astype(np.float32)
        place = np.where(mask > 0, start[part][None, :] + np.arange(steps)[:, None], 0).ravel()
        x = np.concatenate([p["word"][:, ids[place]], chars[:, place]])
        np.maximum.at(best, row[part], gru.forward(p, x, mask))
    return np.where(counts > 0, 1 / (1 + np.exp(-best.astype(np.float64))), 0.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then score (double, 0 to 1). Null and empty texts and texts without words score 0.0; every
    text is scored whole, whatever its length. A column of ``docs`` named score is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, text):
            scores = score_texts(shared.value, piece.column(text))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(scores)],
                                             names=[*columns, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold`` under a model fitted to ``labels``."""
    scored = score(docs.withColumnRenamed("score", "__score"), fit(docs, labels))
    kept = scored.where(F.col("score") < threshold).drop("score")
    return kept.withColumnRenamed("__score", "score").select(*[F.col(f"`{c}`") for c in docs.columns])
