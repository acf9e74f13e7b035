"""Operator 9, quality classifier: an interpolated modified Kneser-Ney model over characters.

The model is counted on the trusted documents and scores all documents by perplexity; each language has its own
threshold, from the quantiles of trusted documents that the model has not seen. A character is a UTF-16 unit and a
gram is four of them, 16 bits each, in one long.

Documents are packed into shards of a bounded size, written once as a table bucketed by shard. Counts meet by gram:
the shards' counts are summed, orders are joined to get probabilities, every gram that occurs in any shard gets its
probability by joins, and each shard gets back the probabilities of its own distinct grams. So no task holds the
model, only the part that its shard needs, and the text itself is never shuffled.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from shelfwise.llm import textbytes as tb
from shelfwise.session import materialize, scratch_path

ORDER = 4
#: Text bytes of a shard, about (a longer document stands alone).
SHARD_BYTES = 16 << 20
#: Stands ORDER - 1 times before every text. In a text it is a character like any other.
_START = 2
#: Unseen languages, and those with fewer unseen trusted documents, take the threshold of all languages together.
MIN_DOCS = 20
#: Width of the bins of log-perplexity that quantiles are counted in.
BIN = 1e-3


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram at every character of the texts, in order; number of characters of each text)."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    lead = np.full(ORDER - 1, _START, np.uint16)
    line = np.concatenate([x for u in units for x in (lead, u)]) if units else np.zeros(0, np.uint16)
    wide = line.astype(np.uint64)
    code = np.zeros(max(0, len(wide) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        code |= wide[k:k + len(code)] << np.uint64(16 * (ORDER - 1 - k))
    # the characters themselves, without the leads
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    own = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return code[own - (ORDER - 1)], sizes


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(first)
    return code[at], np.diff(np.append(at, len(code)))


def _runs(texts: list[str], sizes: list[int], most: int = tb.PIECE_BYTES // 2) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def _pack(rows: DataFrame) -> DataFrame:
    """``rows``: id, lang, text. Shards: shard, ids, langs, blob (texts), sizes (bytes of each), grams (distinct, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        base = TaskContext.get().partitionId() << 32
        ids, langs, texts, size, number = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            found = np.zeros(0, np.uint64)
            lengths = [len(t) for t in texts]
            for a, b in _runs(texts, lengths):
                own, _ = _distinct(grams([t.decode() for t in texts[a:b]])[0])
                found, _ = _distinct(np.concatenate([found, own]))
            steps = np.diff(found, prepend=np.uint64(0))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())),
                 pa.array([press(b"".join(texts))], pa.binary()), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([press(steps.tobytes())], pa.binary())],
                names=["shard", "ids", "langs", "blob", "sizes", "grams"])

        for piece in tb.pieces(batches):
            texts += [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
            ids += piece.column("id").to_pylist()
            langs += piece.column("lang").to_pylist()
            size = size + piece.column("text").nbytes
            if size >= SHARD_BYTES:
                yield shard()
                ids, langs, texts, size, number = [], [], [], 0, number + 1
        if texts:
            yield shard()

    return rows.mapInArrow(run, "shard long, ids array<long>, langs array<string>, blob binary, sizes array<long>, "
                                "grams binary")


def _texts(blob: bytes, sizes: list[int]) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n:e] for e, n in zip(ends, sizes, strict=True)]


def _write_shards(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    name = f"shelfwise_llm_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (_pack(rows).write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "uncompressed")
     .bucketBy(buckets, "shard").saveAsTable(name))
    return spark.table(name)


def _count_trusted(shards: DataFrame, trusted: DataFrame) -> DataFrame:
    """gram, n over the trusted documents. ``trusted``: shard, places (of documents in their shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = _texts(row["blob"], row["sizes"])
                mine = [texts[i] for i in sorted(row["places"])]
                found, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for a, b in _runs(mine, [len(t) for t in mine]):
                    own, n = _distinct(grams([t.decode() for t in mine[a:b]])[0])
                    found, back = np.unique(np.concatenate([found, own]), return_inverse=True)
                    count = np.bincount(back, np.concatenate([count, n]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["gram", "n"])

    joined = shards.select("shard", "blob", "sizes").join(trusted, "shard")
    return joined.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _units(gram: Column, n: int) -> Column:
    """The last n characters of a gram."""
    return gram.bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < 4 else gram


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the counts of counts; where those are
    too few to tell, 0.5."""
    n = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


class Model:
    """p: per order, gram and probability of each seen gram; back: per order above 1, history and its weight of the order
    below; floor: the probability of a character that was never seen."""

    def __init__(self, counts: DataFrame) -> None:
        by_order = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):  # how many different characters precede each shorter gram
            by_order[n] = (by_order[n + 1].groupBy(_units(F.col("gram"), n).alias("gram"))
                           .agg(F.count(F.lit(1)).alias("n")))
        by_order = {n: materialize(c) for n, c in by_order.items()}
        self.p: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        n = F.col("n")
        for order in range(1, ORDER + 1):
            counts = by_order[order]
            d = _discounts(counts)
            discount = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
            if order == 1:
                total, off, kinds = counts.agg(F.sum("n"), F.sum(discount), F.count(F.lit(1))).first()
                self.floor = (off / total if total else 1.0) / ((kinds or 0) + 1)
                self.p[1] = counts.select("gram", ((n - discount) / F.lit(total or 1) + F.lit(self.floor)).alias("p"))
            else:
                history = F.shiftrightunsigned("gram", 16)
                stats = counts.groupBy(history.alias("history")).agg(F.sum("n").alias("total"), F.sum(discount).alias("off"))
                self.back[order] = materialize(stats.select("history", (F.col("off") / F.col("total")).alias("weight"), "total"))
                lower = self.p[order - 1].select(F.col("gram").alias("lower"), F.col("p").alias("p_lower"))
                self.p[order] = (counts.withColumn("history", history).join(self.back[order], "history")
                                 .withColumn("lower", _units(F.col("gram"), order - 1)).join(lower, "lower")
                                 .select("gram", ((n - discount) / F.col("total")
                                                  + F.col("weight") * F.col("p_lower")).alias("p")))
            self.p[order] = materialize(self.p[order])

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """gram, logp (float) for distinct grams: of the longest seen order, times the weights of the histories that were
        seen but not with this character."""
        gram = F.col("gram")
        out = wanted.select("gram")
        for order in range(1, ORDER + 1):
            table = self.p[order].select(F.col("gram").alias(f"g{order}"), F.col("p").alias(f"p{order}"))
            # single characters are 65,536 at most
            table = F.broadcast(table) if order == 1 else table
            out = out.withColumn(f"g{order}", _units(gram, order)).join(table, f"g{order}", "left").drop(f"g{order}")
            if order > 1:
                back = self.back[order].select(F.col("history").alias("h"), F.col("weight").alias(f"w{order}"))
                back = F.broadcast(back) if order == 2 else back
                history = F.shiftrightunsigned(_units(gram, order), 16)
                out = out.withColumn("h", history).join(back, "h", "left").drop("h")
        p = F.coalesce("p1", F.lit(self.floor))
        for order in range(2, ORDER + 1):
            p = F.coalesce(f"p{order}", F.coalesce(f"w{order}", F.lit(1.0)) * p)
        return out.select("gram", F.log(p).cast("float").alias("logp"))


def _decode_grams(shards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                found = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard)), pa.array(found.view(np.int64))],
                                                 names=["shard", "gram"])

    return shards.select("shard", "grams").mapInArrow(run, "shard long, gram long")


class _Lookup:
    """Places of 64-bit keys in a sorted array, through a table of hash slots; keys that share a slot are searched."""

    _BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.slot = np.zeros(1 << self._BITS, np.int32)
        self.slot[self._hash(keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(x)]
        missed = np.flatnonzero(self.keys[at] != x)
        at[missed] = np.searchsorted(self.keys, x[missed])
        return at


def _score(shards: DataFrame, slices: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].values
                if part is None:  # the shard has empty texts only
                    part = pa.array([], batch.column("part").type.value_type)
                keys = part.field("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                logs = part.field("logp").to_numpy(zero_copy_only=False)
                order = np.argsort(keys)
                find, logs = _Lookup(keys[order]), logs[order].astype(np.float64)
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "langs", "blob", "sizes")}
                texts = _texts(row["blob"], row["sizes"])
                sums, counts = [], []
                for a, b in _runs(texts, row["sizes"]):
                    code, n = grams([t.decode() for t in texts[a:b]])
                    run_sums = np.concatenate([[0.0], np.cumsum(logs[find(code)])])
                    ends = np.cumsum(n)
                    sums.append(run_sums[ends] - run_sums[ends - n])
                    counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["langs"], pa.string()),
                     pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts))],
                    names=["id", "lang", "log_sum", "n"])

    joined = shards.select("shard", "ids", "langs", "blob", "sizes").join(slices, "shard", "left")
    return joined.mapInArrow(run, "id long, lang string, log_sum double, n long")


def _quantiles(scored: DataFrame, group: Column, qs: tuple[float, ...]) -> DataFrame:
    """grp, docs and q0, q1, ...: quantiles of log_ppl per group, exact to BIN. Documents are counted by bin before any
    shuffle, so a group's window has a row per bin and not per document."""
    bins = scored.groupBy(group.alias("grp"), F.round(F.col("log_ppl") / BIN).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("grp").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("c").over(w)).withColumn("docs", F.sum("c").over(Window.partitionBy("grp")))
    return upto.groupBy("grp").agg(F.max("docs").alias("docs"), *[
        (F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * F.lit(q)), F.col("bin"))) * BIN).alias(f"q{i}")
        for i, q in enumerate(qs)])


def classify(docs: DataFrame, labels: DataFrame, high: float = 0.99, doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_chars (UTF-16 units), perplexity, threshold, keep.

    Trusted are the documents that ``labels`` (doc_id, quality) marks 1 and never 0. Those whose crc32(doc_id) mod 3 is
    not 1 train the model, all of them; the others place the thresholds: a language's is the ``high`` quantile of their
    perplexity, and a document is kept if its own is at most that. A language with fewer than MIN_DOCS of those (a null
    language is one of its own) takes the quantile over all languages, or, if there are none either, has a null threshold
    and keeps all.

    A null or empty text has null perplexity and is not kept, as there is nothing to train on. Repeated rows get equal
    results. Texts are scored whole. Other columns are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), "lang", "text")
    shards = _write_shards(rows)
    trusted = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
               .agg(F.min("quality").alias("low"), F.max("quality").alias("top")).where("low = 1 and top = 1").select("id"))
    unseen = F.crc32(F.col("id").cast("string")) % 3 == 1
    places = (shards.select("shard", F.posexplode("ids").alias("place", "id")).join(trusted.where(~unseen), "id")
              .groupBy("shard").agg(F.collect_list("place").alias("places")))
    model = Model(materialize(_count_trusted(shards, places)))
    held = _decode_grams(shards)
    p = materialize(model.probabilities(held.select("gram").distinct()))
    slices = held.join(p, "gram").groupBy("shard").agg(F.collect_list(F.struct("gram", "logp")).alias("part"))
    scored = materialize(_score(shards, slices).withColumn("log_ppl", F.when(F.col("n") > 0, -F.col("log_sum") / F.col("n"))))
    judged = (scored.where(F.col("log_ppl").isNotNull()).join(trusted.where(unseen), "id")
              .select("lang", "log_ppl"))
    judged = materialize(judged)
    by_lang = (_quantiles(judged, F.col("lang"), (high,)).where(F.col("docs") >= MIN_DOCS)
               .select(F.col("grp").alias("limit_lang"), F.col("q0").alias("limit")))
    overall = _quantiles(judged, F.lit("all"), (high,)).select("q0").first()
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    limit = F.when(F.col("n") > 0, F.coalesce("limit", F.lit(overall[0] if overall else None).cast("double")))
    # quantiles are exact to BIN only, so perplexities are compared by bin
    inside = F.round(F.col("log_ppl") / BIN) <= F.round(limit / BIN)
    return out.select(F.col("id").alias(doc_id), "lang", F.col("n").alias("n_chars"), F.exp("log_ppl").alias("perplexity"),
                      F.exp(limit).alias("threshold"),
                      F.coalesce(F.when(limit.isNull(), F.col("n") > 0).otherwise(inside),
                                 F.lit(False)).alias("keep"))
