"""Operator 10, line dedup by pairwise alignment.

Places that occur in several documents tell which windows of min_words words can be repeats, and each such window
nominates a pair (later document, first document that has the window); each pair is aligned with patience diff, common
blocks are widened word by word at both ends, the rest is compared window by window, and the later document loses the
blocks that are long enough.

Places are chosen by winnowing: of every window of min_words words the least hash of GRAM_WORDS words. The choice depends on
nothing outside the window, so documents with a common run of min_words words have a common place, whatever stands before
the run and whether or not it has sentence ends. The grams at these places are the lines of patience diff.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from shelfwise.llm import textbytes as tb
from shelfwise.llm.membership import Members, members
from shelfwise.session import scratch_path

#: Words that a winnowed place is chosen by.
GRAM_WORDS = 8

#: Text bytes whose word arrays a task holds at once, and rows that it hands on at once.
_PIECE_BYTES = tb.PIECE_BYTES // 2
_ROWS = 1000

_SPACE = b" \t\r\n\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class Winnowed:
    """The words of all rows, and of every window of ``min_words`` words (in one row) the place of its least gram.

    starts, ends: bytes of each word. at: first word of every window. lo, hi: the first and the last window (places in at)
    of each group, a run of neighbouring windows with the same least gram. place: the word that gram begins with. row, number:
    the row of each group, and its number in the row.
    The least gram depends on the words of its window only, so equal windows have equal grams wherever they stand.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_words: int) -> None:
        self.starts, self.ends = starts, ends = tb.spans(~tb.SPACE[raw], offsets)
        self.min_words, n = min_words, len(starts)
        self.at = self.lo = self.hi = self.place = self.row = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        row = np.searchsorted(offsets, starts, "right")
        if n < min_words:
            return
        word = tb.PrefixHash(raw).of(starts, ends)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word * _powers(_BASE, n), out=self._sums[1:])
        self._back = _powers(_INVERSE, n)
        size = min(GRAM_WORDS, min_words)
        first = np.arange(n - size + 1)
        self.gram = least = self.hashes(first, first + size)
        place, have, want = first, 1, min_words - size + 1
        while have < want:  # the least of `have` grams from each place, the first of equal ones
            step = min(have, want - have)
            later = least[step:] < least[:-step]
            place = np.where(later, place[step:], place[:-step])
            least = np.where(later, least[step:], least[:-step])
            have += step
        self.at = np.flatnonzero(row[:n - min_words + 1] == row[min_words - 1:])
        if not len(self.at):
            return
        place, row = place[self.at], row[self.at]
        cut = np.flatnonzero((place[1:] != place[:-1]) | (row[1:] != row[:-1])) + 1
        self.lo, self.hi = np.append(0, cut), np.append(cut, len(self.at)) - 1
        self.place, self.row = place[self.lo], row[self.lo] - 1
        first = tb.rows_of(self.row, np.arange(len(offsets) - 1))
        self.number = (np.arange(len(self.lo)) - first[self.row]).astype(np.int32)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first (inclusive) to last (exclusive), whatever white space is between them."""
        return _mixed((self._sums[last] - self._sums[first]) * self._back[first])

    def windows(self) -> np.ndarray:
        return self.hashes(self.at, self.at + self.min_words) if len(self.at) else np.zeros(0, np.uint64)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder, in columns, and read from there."""
    path = scratch_path(df.sparkSession, f"lines-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs``: doc (long, not null), text. hash, doc: the least gram of every group of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, max_bytes=_PIECE_BYTES):
            w = Winnowed(*tb.utf8(piece.column("text")), min_words)
            if len(w.lo):
                yield pa.RecordBatch.from_arrays([pa.array(w.gram[w.place].view(np.int64)), piece.column("doc").take(pa.array(w.row))],
                                                 names=["hash", "doc"])

    return docs.select("doc", "text").mapInArrow(run, "hash long, doc long")


def line_table(docs: DataFrame, min_words: int, only: Members | None = None) -> DataFrame:
    """``docs``: doc (long, not null), text. One row per group of windows: hash of its least gram, extent (hash of all words
    of its windows), doc, number (of the group in its row). ``only``: hashes whose rows are wanted; a few others may come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, max_bytes=_PIECE_BYTES):
            w = Winnowed(*tb.utf8(piece.column("text")), min_words)
            if len(w.lo):
                line = w.gram[w.place].view(np.int64)
                at = np.arange(len(line)) if only is None else np.flatnonzero(only.may_have(line))
                extent = w.hashes(w.at[w.lo[at]], w.at[w.hi[at]] + min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[at]), pa.array(extent.view(np.int64)),
                     piece.column("doc").take(pa.array(w.row[at])), pa.array(w.number[at])],
                    names=["hash", "extent", "doc", "number"])

    return docs.select("doc", "text").mapInArrow(run, "hash long, extent long, doc long, number int")


def _window_table(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs``: doc, packed, numbers (of groups). One row per distinct window of these groups: window (hash), doc."""

    def found(texts: list[bytes], numbers: list[np.ndarray], doc: list[int]) -> pa.RecordBatch:
        w, _, group, _ = _winnowed(texts, min_words)
        wanted = np.zeros(len(w.lo), bool)
        for i, mine in enumerate(numbers):
            mine = mine + group[i]
            wanted[mine[mine < group[i + 1]]] = True  # another row of the same document may have more groups
        each = np.repeat(wanted, w.hi - w.lo + 1)
        window, row = w.windows()[each], np.repeat(w.row, w.hi - w.lo + 1)[each]
        order = np.lexsort((window, row))
        window, row = window[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (window[1:] != window[:-1]) | (row[1:] != row[:-1])
        return pa.RecordBatch.from_arrays([pa.array(window[new].view(np.int64)), pa.array(np.array(doc, np.int64)[row[new]])],
                                          names=["window", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                row = (_open(batch.column("packed")[i].as_py()), batch.column("numbers")[i].values.to_numpy(),
                       batch.column("doc")[i].as_py())
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                if sum(map(len, held[0])) >= _PIECE_BYTES:
                    yield found(*held)
                    held = ([], [], [])
            if held[0]:
                yield found(*held)

    return docs.select("doc", "packed", "numbers").mapInArrow(run, "window long, doc long")


def _first_holders(rows: DataFrame, key: str) -> DataFrame:
    """``key``, owner: the first document of each key that several documents have. Written out, so that a join deals both
    sides anew and the rows of a very common key can be split over tasks."""
    return _written(rows.groupBy(key).agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
                    .where(F.col("last") > F.col("owner")).select(key, "owner"), f"first-{key}")


def nominate(docs: DataFrame, min_words: int) -> DataFrame:
    """Pairs doc, owner such that every window of ``min_words`` words of doc that an earlier document has is in one of its
    owners. ``docs``: doc, text.

    Only groups whose gram several documents have can hold such a window. A group whose extent an earlier document has is
    done with the first of those. The windows of the other groups (at the ends of common runs, and in the first document
    that has a run) are looked up one by one. The first holder of a window is always among them: if an earlier
    document had the extent of its group, that one would hold the window too.
    """
    shared = _first_holders(lines_of(docs, min_words), "hash").drop("owner")
    lines = line_table(docs, min_words, members(shared))
    seen = _written(lines.join(shared, "hash").drop("hash"), "seen")
    whole = seen.join(_first_holders(seen, "extent"), "extent", "left")
    whole = _written(whole.withColumn("done", F.coalesce(F.col("owner") < F.col("doc"), F.lit(False))).drop("extent"), "whole")
    open_ = whole.where(~F.col("done")).select("doc", "number")
    left = open_.groupBy("doc").agg(F.collect_set("number").alias("numbers"))
    texts = _packed(docs.where(F.col("text").isNotNull()), "doc", members(open_.select("doc")))
    windows = _written(_window_table(texts.join(left, "doc"), min_words), "windows")
    held = windows.join(_first_holders(windows, "window"), "window").where(F.col("owner") < F.col("doc"))
    return whole.where("done").select("doc", "owner").unionByName(held.select("doc", "owner")).distinct()


def _winnowed(texts: list[bytes], min_words: int) -> tuple[Winnowed, np.ndarray, np.ndarray, np.ndarray]:
    """(the winnowed words of all texts together; the offset of each text, its first group and its first window, each with
    one more entry than texts)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    w = Winnowed(raw, offsets, min_words)
    group = np.searchsorted(w.row, np.arange(len(texts) + 1))
    return w, offsets, group, np.searchsorted(w.at, tb.rows_of(w.starts, offsets))


class _Lines:
    """A text cut into words and chosen grams, as patience diff wants it."""

    def __init__(self, text: bytes, min_words: int = 25) -> None:
        self._take(text, *_winnowed([text], min_words), 0, None)

    @classmethod
    def of(cls, texts: list[bytes], min_words: int) -> list[_Lines]:
        """All texts at once, which takes about as many array operations as one."""
        whole = _winnowed(texts, min_words)
        hashes, out = whole[0].windows(), []
        for i, text in enumerate(texts):
            out.append(cls.__new__(cls))
            out[-1]._take(text, *whole, i, hashes)
        return out

    def _take(self, text: bytes, w: Winnowed, offsets: np.ndarray, group: np.ndarray, window: np.ndarray, i: int,
              hashes: np.ndarray | None) -> None:
        a, b = np.searchsorted(w.starts, offsets[i:i + 2])
        self.text, self.words, self.min_words = text, text.split(), w.min_words
        self.start, self.end = w.starts[a:b] - offsets[i], w.ends[a:b] - offsets[i]
        place = np.unique(w.place[group[i]:group[i + 1]])
        self.first = (place - a).tolist()  # the first word of every chosen gram
        self.windows = (w.windows() if hashes is None else hashes)[window[i]:window[i + 1]]
        line, at, counts = np.unique(w.gram[place], return_index=True, return_counts=True)
        self.once = dict(zip(line[counts == 1].tolist(), at[counts == 1].tolist(), strict=True))


def _anchors(a: _Lines, b: _Lines) -> list[tuple[int, int]]:
    """The longest chain of chosen grams that occur once in both, in the order of both."""
    small, large = (a.once, b.once) if len(a.once) <= len(b.once) else (b.once, a.once)
    common = sorted((a.once[x], b.once[x]) for x in small if x in large)
    tails: list[int] = []
    at: list[int] = []
    back = [0] * len(common)
    for k, (_, j) in enumerate(common):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append(common[k])
        k = back[k]
    return chain[::-1]


def common_blocks(later: _Lines, earlier: _Lines) -> list[tuple[int, int, int]]:
    """(start, end, number of words) of the common blocks in the later text, by patience diff: each anchor that no block has
    yet, widened by the equal words before it, up to the block before, and from it on. Then every window of later that no
    such block has is looked up among all windows of earlier, and runs of those found are blocks too: repeated grams and
    blocks in another order have no anchor. So the blocks have every common run of min_words words."""
    x, y = later.words, earlier.words
    size = later.min_words
    blocks = []
    open_ = np.ones(len(later.windows), bool)  # windows of later without a block
    done_a = done_b = 0  # words before these belong to blocks that are finished
    for i, j in _anchors(later, earlier):
        a, b = end_a, end_b = later.first[i], earlier.first[j]
        if a < done_a or b < done_b:
            continue
        while a > done_a and b > done_b and x[a - 1] == y[b - 1]:
            a, b = a - 1, b - 1
        while end_a < len(x) and end_b < len(y) and x[end_a] == y[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        if end_a > a:
            blocks.append((a, end_a))
            open_[a:max(a, end_a - size + 1)] = False
            done_a, done_b = end_a, end_b
    rest = np.flatnonzero(open_)
    if len(rest) and len(earlier.windows):
        rest = rest[np.isin(later.windows[rest], earlier.windows)]
        for run in np.split(rest, np.flatnonzero(np.diff(rest) != 1) + 1):
            if len(run):
                blocks.append((int(run[0]), int(run[-1]) + size))
    return [(int(later.start[a]), int(later.end[b - 1]), b - a) for a, b in blocks]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans and without the white space before each; what is left is otherwise as it was."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a].rstrip(_SPACE))
        at = b
    rest = text[at:]
    out = b"".join(kept) + rest
    return out if any(kept) else out.lstrip(_SPACE)


def _split(batches: Iterator[pa.RecordBatch], key: str, only: Members, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose key may be a member (inside), or the others."""
    for batch in batches:
        yield batch.filter(pa.array(only.may_have(batch.column(key).to_numpy()) == inside))


def _packed(docs: DataFrame, key: str, only: Members) -> DataFrame:
    """``docs`` (any columns and text) with the text compressed in column packed, those whose key may be a member; a null
    text stays null."""
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*fields, StructField("packed", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for piece in tb.pieces(_split(batches, key, only, True), max_bytes=4 << 20):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(f.name) for f in fields),
                 pa.array([None if t is None else press(t) for t in texts], pa.binary())],
                names=[*(f.name for f in fields), "packed"])

    return docs.mapInArrow(run, schema)


def _open(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def delete_repeats(docs: DataFrame, min_words: int = 25, rare: int = 50, doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, text without the blocks that an earlier document has, then deleted_spans
    (array<struct<start,end>>, code points of the old text, end exclusive) and deleted_words (long).

    Earlier means a smaller doc_id; null ids are one last document, and rows that share an id are one document, so they
    are not compared with each other. Of two documents with a common block of at least ``min_words`` words the later
    one loses it, together with the white space before it; the first document that has a block keeps it. An exact copy
    is left with an empty text. Rows without repeats, null and empty texts come back as they were. An empty table gives
    an empty one. Columns of ``docs`` with the name of a result column are replaced. Equal rows get equal results. ``rare``
    is not used any more: the result does not depend on how common a line is.
    """
    docs = docs.drop("deleted_spans", "deleted_words")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(key.alias("doc"), "text")
    pairs = _written(nominate(keyed, min_words), "pairs")
    with_pairs = members(pairs.select("doc"))
    # the text of the earlier document of each pair goes to the later one
    owners = _packed(keyed, "doc", members(pairs.select("owner"))).withColumnRenamed("doc", "owner")
    sent = pairs.join(owners, "owner").select("doc", F.lit(1).alias("kind"), "packed")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(key.alias("__doc"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), "text")
    own = _packed(rows, "__doc", with_pairs).select(F.col("__doc").alias("doc"), F.lit(0).alias("kind"), "packed", "rest")
    both = own.unionByName(sent, allowMissingColumns=True)
    # the earlier texts of a document arrive before its own rows, one at a time
    lined_up = both.repartition("doc").sortWithinPartitions("doc", F.col("kind").desc())
    schema = StructType([StructField("rest", rows.schema["rest"].dataType, True), StructField("text", StringType()),
                         StructField("deleted_spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))),
                         StructField("deleted_words", LongType())])
    # documents without a pair stay where they are
    alone = rows.mapInArrow(lambda batches: _split(batches, "__doc", with_pairs, False), rows.schema)
    alone = alone.select("rest", "text", F.array().cast(schema["deleted_spans"].dataType).alias("deleted_spans"),
                         F.lit(0).cast("long").alias("deleted_words"))
    done = lined_up.mapInArrow(_align(min_words), schema).unionByName(alone)
    columns = [F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns, "deleted_spans", "deleted_words")


def _common(work: list[tuple[bytes, list[bytes]]], min_words: int) -> list[list[tuple[int, int]]]:
    """For each (text, earlier texts) the spans of the text that an earlier one has."""
    lines = iter(_Lines.of([t for later, earlier in work for t in (later, *earlier)], min_words))
    out = []
    for _, earlier in work:
        later = next(lines)
        out.append([(a, b) for _ in earlier for a, b, n in common_blocks(later, next(lines)) if n >= min_words])
    return out


def _align(min_words: int):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, earlier = None, []
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            docs, kinds, packed = (batch.column(c).to_pylist() for c in ("doc", "kind", "packed"))
            own, texts, found = [], [], []  # rows of the batch, their texts, and the spans that go
            work, which, size = [], [], 0  # texts to compare with earlier ones, and whose they are

            def compare() -> None:
                nonlocal size
                for k, spans in zip(which, _common(work, min_words) if work else [], strict=True):  # noqa: B023
                    found[k] += spans  # noqa: B023
                work.clear()  # noqa: B023
                which.clear()  # noqa: B023
                size = 0

            for i in range(batch.num_rows):
                if docs[i] != doc:
                    doc, earlier = docs[i], []
                if kinds[i] == 1:
                    if packed[i] is not None:
                        earlier.append(packed[i])
                    continue
                text = None if packed[i] is None else _open(packed[i])
                own.append(i)
                texts.append(text)
                found.append([])
                if text is None or not earlier:
                    continue
                if packed[i] in earlier and len(text.split()) >= min_words:  # an exact copy, compressed alike
                    found[-1].append((len(text) - len(text.lstrip(_SPACE)), len(text.rstrip(_SPACE))))
                    continue
                others: list[bytes] = []
                for other in earlier:  # very many earlier texts come in parts
                    others.append(_open(other))
                    size += len(others[-1])
                    if size + len(text) >= _PIECE_BYTES:
                        work.append((text, others))
                        which.append(len(own) - 1)
                        compare()
                        others = []
                if others:
                    work.append((text, others))
                    which.append(len(own) - 1)
                    size += len(text)
            compare()
            if own:
                spans, words = [], []
                for k, text in enumerate(texts):
                    gone = _merged(found[k])
                    spans.append([{"start": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in gone])
                    words.append(sum(len(text[a:b].split()) for a, b in gone))
                    texts[k] = without(text, gone) if gone else text
                kept = batch.column("rest").take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [kept, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span)),
                     pa.array(words, pa.int64())], names=["rest", "text", "deleted_spans", "deleted_words"])

    return run
