"""Operator 7, language identification by nearest centroid.

A text is a normalised TF-IDF vector over hashed letter trigrams (of UTF-8 bytes, in lower case, everything else a single
space). Each language has several centroids, clustered from a bounded sample of its documents; the document frequencies
come from all of them. The nearest centroid by cosine gives the language, and a text further from it than the sample's
own texts are is marked as rejected.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from shelfwise.llm import textbytes as tb

#: Dimensions; trigrams share them by hash.
DIM = 4096
#: Documents turned into vectors at once.
_ROWS = 256

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass(frozen=True)
class Settings:
    """per_language: documents of each language that the centroids may be clustered from, chosen by a hash of doc_id.
    centroids: clusters of a language. reject: a text is rejected if its distance to the nearest centroid is above
    ``reject`` times the 99 % quantile of the sample's distances to that centroid."""

    per_language: int = 300
    centroids: int = 4
    rounds: int = 10
    reject: float = 1.25
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # (DIM,)
    centroids: np.ndarray  # (centroids, DIM), unit length
    owner: np.ndarray  # of each centroid, the place of its language
    limit: np.ndarray  # of each centroid, the distance from which a text is rejected


def counts(column: pa.Array) -> np.ndarray:
    """(rows, DIM): how often each trigram occurs."""
    kind = pa.large_string()
    lower = pc.utf8_lower(pc.fill_null(column.cast(kind), pa.scalar("", kind)))
    ends = pa.scalar("", kind)
    raw, offsets = tb.utf8(pc.binary_join_element_wise(ends, lower, ends, pa.scalar(" ", kind)))  # a space at both ends
    raw = np.where(_LETTER[raw], raw, 0x20)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    keep = raw != 0x20
    keep[1:] |= raw[:-1] != 0x20
    keep[:1] = True
    starts = offsets[:-1]
    keep[starts[starts < len(raw)]] = True
    raw, row = raw[keep].astype(np.uint32), row[keep]
    if len(raw) < 3:
        return np.zeros((len(column), DIM), np.float32)
    code = raw[:-2] * np.uint32(0x1F35D) + raw[1:-1] * np.uint32(0x4F1B) + raw[2:] * np.uint32(0x3D)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1)
    inside = row[:-2] == row[2:]
    at = row[:-2][inside] * DIM + code[inside]
    return np.bincount(at, minlength=len(column) * DIM).reshape(len(column), DIM).astype(np.float32)


def _vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for piece in tb.pieces(batches, text):
        for i in range(0, piece.num_rows, _ROWS):
            yield piece.slice(i, _ROWS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(in how many documents each dimension occurs, number of documents); a task hands on DIM sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIM, np.int64), 0
        for part in _slices(batches):
            total += (counts(part.column("text")) > 0).sum(0)
            rows += part.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.append(rows, total))],
                                             names=["dim", "n"])

    sums = dict(docs.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n")).collect())
    return np.array([sums.get(i, 0) for i in range(DIM)], np.float64), sums.get(-1, 0)


def _sample(docs: DataFrame, settings: Settings) -> list:
    """lang, codes, counts of the sampled documents, as sparse vectors."""
    # the first ids by hash within 64 parts of a language and then among those, so that no task sorts a whole language
    ids = docs.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.col("h") % 64)
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= settings.per_language)
    ids = ids.select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            c = counts(part.column("text"))
            at = [np.flatnonzero(x) for x in c]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())),
                 pa.array([x[a] for x, a in zip(c, at, strict=True)], pa.list_(pa.float32()))],
                names=["doc_id", "lang", "codes", "counts"])

    # the sample is bounded by the settings and the number of languages: of rows that share both, the text with the least hash
    chosen = (docs.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang")
              .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    return chosen.mapInArrow(run, "doc_id long, lang string, codes array<int>, counts array<float>").collect()


def _cluster(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means, begun with rows that are far apart."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        centre.append(x[np.argmin(np.max(x @ np.array(centre).T, 1))])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """``docs``: doc_id, text, lang, all of which may be learned from; null languages are left out."""
    docs = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = sorted(_sample(docs, settings), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, len(r["codes"])))
    languages = sorted({r["lang"] for r in rows})
    centroids, owner, limit = [np.zeros((0, DIM))], [], []
    for i, lang in enumerate(languages):
        mine = [r for r in rows if r["lang"] == lang]
        c = np.zeros((len(mine), DIM))
        for k, r in enumerate(mine):
            c[k, r["codes"]] = r["counts"]
        x = _vectors(c, idf)
        centre = _cluster(x, settings.centroids, settings.rounds, settings.seed)
        cosine = x @ centre.T
        own = np.argmax(cosine, 1)
        for j in range(len(centre)):
            distance = 1 - cosine[own == j, j]
            limit.append(settings.reject * float(np.quantile(distance, 0.99)) if len(distance) else 1.0)
        owner += [i] * len(centre)
        centroids.append(centre)
    return Model(languages, idf.astype(np.float32), np.concatenate(centroids).astype(np.float32),
                 np.array(owner, np.int64), np.array(limit))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then lang_pred, score, rejected.

    score is the cosine to the nearest centroid, 0 to 1; equal cosines go to the language that sorts first. rejected says
    that the distance, 1 - score, is above the centroid's limit; lang_pred names the nearest language all the same. A text
    that is null or has no letter is ``und`` with score 0, and so is every text of a model without languages; both count
    as rejected. Whole texts are used. Columns of ``docs`` with the name of a result column are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in _slices(batches, text):
            column = part.column(text)
            known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not len(m.owner):
                known = np.zeros(len(column), bool)
                best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            else:
                cosine = _vectors(counts(column), m.idf) @ m.centroids.T
                best = np.argmax(cosine, 1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
            lang = [m.languages[m.owner[b]] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, score, 0.0)
            far = ~known if not len(m.owner) else ~known | (1 - score > m.limit[best])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang, pa.string()),
                                              pa.array(score), pa.array(far)],
                                             names=[*columns, "lang_pred", "score", "rejected"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("rejected", BooleanType())])
    return docs.mapInArrow(run, schema)

