"""Operator 2, benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards, sorts the word suffixes of a shard into a suffix array and
binary-searches every suffix of the test items in it: the range that a search ends in gives all locations of
the suffix's window, and windows that continue each other are joined to the longest verbatim matches. Documents
with a match are contaminated.
No document leaves its task, so there is no shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from shelfwise.llm import textbytes as tb

#: Bytes of test text that are searched at once, and so the bound of what is broadcast at a time.
BLOCK_BYTES = 8 << 20

#: Word bytes: all but \x00-\x2F \x3A-\x60 \x7B-\x7F, after A-Z went to lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

_STATE = {"__n_words": "long", "__longest": "integer", "__hits": "binary", "__items": "array<string>"}


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, index of the first word of every row with the total appended)."""
    raw, offsets = tb.utf8(column)
    raw = _FOLD[raw]
    starts, ends = tb.spans(_WORD[raw], offsets)
    hashes = tb.PrefixHash(raw).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, tb.rows_of(starts, offsets)


@dataclass
class TestBlock:
    """Test items as one sequence of symbols 1..n; 0 stands for any word that no item has, and ends each item."""

    vocabulary: np.ndarray  # sorted hashes; the symbol of a word is its place here, counted from 1
    symbols: np.ndarray
    begin: np.ndarray  # of the suffixes that hold a whole window: where each begins in symbols,
    window: np.ndarray  # how many words must match,
    item: np.ndarray  # and the place of its item in names
    names: list[str]

    @classmethod
    def of(cls, ids: list, texts: list, window: int) -> TestBlock:
        hashes, first = words_of(pa.array(texts, pa.string()))
        vocabulary = np.unique(hashes)
        symbols = np.zeros(len(hashes) + len(texts), np.int64)
        begin, need, item = [], [], []
        for i in range(len(texts)):
            a, n = int(first[i]), int(first[i + 1] - first[i])
            symbols[a + i:a + i + n] = np.searchsorted(vocabulary, hashes[a:a + n]) + 1
            size = min(window, n)
            searched = n - size + 1 if n else 0
            begin.append(a + i + np.arange(searched))
            need.append(np.full(searched, size))
            item.append(np.full(searched, i))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(vocabulary, symbols, join(begin), join(need), join(item),
                   ["" if i is None else str(i) for i in ids])


class SuffixArray:
    """All suffixes of a sequence of symbols in lexicographic order of their first ``depth`` symbols.

    Suffixes that agree up to a symbol 0 are left in any order beyond it, as no search passes a 0.
    """

    def __init__(self, symbols: np.ndarray, depth: int, top: int) -> None:
        n = len(symbols)
        bits = max(1, int(top).bit_length())
        per_key = max(1, 62 // bits)
        padded = np.concatenate([symbols, np.zeros(per_key, np.int64)])
        key = np.zeros(n, np.int64)
        alive = np.ones(n, bool)
        for d in range(per_key):
            key = (key << bits) | padded[d:d + n]
            alive &= padded[d:d + n] > 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        sorted_to = per_key
        while sorted_to < depth:
            # groups of equal suffixes without a 0 so far are sorted by the rank of what follows
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            open_ = (sizes[group] > 1) & alive[order]
            if not open_.any():
                break
            rank = np.empty(n + 1, np.int64)
            rank[order] = group + 1
            rank[n] = 0
            at = np.flatnonzero(open_)
            suffix = order[at]
            follow = rank[np.minimum(suffix + sorted_to, n)]
            resorted = np.lexsort((follow, group[at]))
            suffix, follow = suffix[resorted], follow[resorted]
            order[at] = suffix
            differs = np.ones(len(at), bool)
            differs[1:] = (follow[1:] != follow[:-1]) | (group[at][1:] != group[at][:-1])
            new[at] = differs
            later = np.minimum(suffix + sorted_to, n - 1)
            alive[suffix] = alive[later] & (suffix + sorted_to < n)
            sorted_to *= 2
        self.symbols, self.order = padded, order
        self._n, self._pad = n, per_key

    def _symbol(self, places: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.symbols[np.minimum(self.order[places] + depth, self._n)]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all ranges at once: the first place whose symbol at ``depth`` is >= want (> want if after)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            busy = lo < hi
            if not busy.any():
                return lo
            mid = (lo + hi) >> 1
            found = self._symbol(np.minimum(mid, self._n - 1), depth)
            right = busy & ((found <= want) if after else (found < want))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(busy & ~right, mid, hi)

    def search(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """For every searched test suffix, the range of the suffixes here that begin with its window."""
        n = len(block.begin)
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.arange(n)
        lo, hi = np.zeros(n, np.int64), np.full(n, self._n, np.int64)
        depth = 0
        while len(active):
            want = block.symbols[block.begin[active] + depth]
            a = self._bound(lo, hi, depth, want, False)
            b = self._bound(a, hi, depth, want, True)
            depth += 1
            found = a < b
            active, lo, hi = active[found], a[found], b[found]
            whole = block.window[active] == depth
            first[active[whole]], last[active[whole]] = lo[whole], hi[whole]
            active, lo, hi = active[~whole], lo[~whole], hi[~whole]
        return first, last


def _search_piece(column: pa.Array, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Over the rows of a shard: number of words, longest verbatim match, hit words as a bool array over all words of the
    shard, and the names of the items of which a window occurs."""
    hashes, first = words_of(column)
    rows, total = len(first) - 1, len(hashes)
    n_words = np.diff(first)
    hit = np.zeros(total, bool)
    longest = np.zeros(rows, np.int64)
    items: list[list[str]] = [[] for _ in range(rows)]
    if not total or not len(block.begin):
        return n_words, longest, hit, items
    place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    known = np.where(block.vocabulary[place] == hashes, place + 1, 0)
    # a 0 after every document keeps matches within it
    row = np.repeat(np.arange(rows), n_words)
    symbols = np.zeros(total + rows, np.int64)
    symbols[np.arange(total) + row] = known
    row_at = np.repeat(np.arange(rows), n_words + 1)
    suffixes = SuffixArray(symbols, int(block.window.max()), len(block.vocabulary))
    lo, hi = suffixes.search(block)
    count = hi - lo
    suffix = np.repeat(np.arange(len(lo)), count)
    if not len(suffix):
        return n_words, longest, hit, items
    within = np.arange(len(suffix)) - np.repeat(np.cumsum(count) - count, count)
    at = suffixes.order[np.repeat(lo, count) + within]
    edge = np.bincount(at, minlength=total + rows + 1)
    edge -= np.bincount(at + block.window[suffix], minlength=total + rows + 1)
    hit = (np.cumsum(edge)[:-1] > 0)[np.arange(total) + row]
    for pair in np.unique(row_at[at] * len(block.names) + block.item[suffix]):
        items[pair // len(block.names)].append(block.names[pair % len(block.names)])
    # windows that follow each other in both the item and the document are one longer match
    diagonal = at - block.begin[suffix]
    order = np.lexsort((at, diagonal))
    at, diagonal, suffix = at[order], diagonal[order], suffix[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.flatnonzero(fresh)
    length = np.diff(np.append(run, len(at))) - 1 + block.window[suffix[run]]
    np.maximum.at(longest, row_at[at[run]], length)
    return n_words, longest, hit, items


def _pack(hit: np.ndarray, bounds: np.ndarray, old: list[bytes | None]) -> list[bytes]:
    """Per row the (start, end) pairs of its hit words as int32, together with those found before."""
    out = []
    for i in range(len(bounds) - 1):
        own = hit[bounds[i]:bounds[i + 1]]
        if old[i]:
            for a, b in np.frombuffer(old[i], np.int32).reshape(-1, 2):
                own[a:b] = True
        starts, ends = tb.spans(own, np.array([0, len(own)]))
        out.append(np.stack([starts, ends], 1).astype(np.int32).tobytes())
    return out


def _scan(docs: DataFrame, block, text: str) -> DataFrame:
    """Adds, or goes on with, the state columns by one block of test items (a broadcast TestBlock)."""
    keep = [c for c in docs.columns if c not in _STATE]
    again = "__hits" in docs.columns
    schema = StructType([f for f in docs.schema.fields if f.name in keep])
    for name, kind in _STATE.items():
        schema = schema.add(name, kind if "<" not in kind else ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, text):
            n_words, longest, hit, items = _search_piece(piece.column(text), block.value)
            old = piece.column("__hits").to_pylist() if again else [None] * piece.num_rows
            if again:
                longest = np.maximum(longest, piece.column("__longest").to_numpy())
                items = [a + b for a, b in zip(piece.column("__items").to_pylist(), items, strict=True)]
            bounds = np.concatenate([[0], np.cumsum(n_words)])
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(longest.astype(np.int32)),
                 pa.array(_pack(hit, bounds, old), pa.binary()), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "__n_words", "__longest", "__hits", "__items"])

    return docs.mapInArrow(run, schema)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """The test items in blocks of at most BLOCK_BYTES of text (a longer item stands alone)."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len((row["t"] or "").encode())
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs``, then n_words, n_hit, n_items (long), longest (int), hit_spans
    (array<struct<start,end>>, in words, end exclusive), items (array<string>, sorted), contaminated (boolean).

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z folded. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word of a
    document is hit if it lies in an occurrence of a window. n_items counts the items with an occurrence; items that
    share an id count once (a null id is an empty string). longest is the number of words of the longest verbatim match
    with an item among those that hold a window, 0 if there is none.

    Null and empty texts have no words and no hits. Repeated documents and items change nothing for the others. With
    no items nothing is contaminated; an empty table gives an empty one. Columns of ``docs`` that have the name of a
    result column are replaced. Long texts are searched whole: a document is never split over shards.
    """
    names = ("n_words", "n_hit", "n_items", "longest", "hit_spans", "items", "contaminated")
    docs = docs.drop(*names)
    out = _searched(docs, items, window, text, item_id, item_text)
    schema = StructType([*docs.schema.fields])
    for name in ("n_words", "n_hit", "n_items"):
        schema = schema.add(name, "long")
    span = StructType().add("start", "integer").add("end", "integer")
    schema = (schema.add("longest", "integer").add("hit_spans", ArrayType(span)).add("items", ArrayType(StringType()))
              .add("contaminated", "boolean"))
    return out.mapInArrow(_finish(docs.columns), schema)


def _searched(docs: DataFrame, items: DataFrame, window: int, text: str, item_id: str, item_text: str) -> DataFrame:
    """``docs`` with the state columns after all blocks of items."""
    context = docs.sparkSession.sparkContext
    searched = docs
    for ids, texts in _blocks(items, item_id, item_text):  # one block at a time is held here
        searched = _scan(searched, context.broadcast(TestBlock.of(ids, texts, window)), text)
    return searched if searched is not docs else _scan(docs, context.broadcast(TestBlock.of([], [], window)), text)


def _finish(columns: list[str]):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column("__hits").to_pylist()]
            n_hit = [int((p[:, 1] - p[:, 0]).sum()) for p in packed]
            items = [sorted(set(x)) for x in batch.column("__items").to_pylist()]
            spans = [[{"start": int(a), "end": int(b)} for a, b in p] for p in packed]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), batch.column("__n_words"), pa.array(n_hit, pa.int64()),
                 pa.array([len(x) for x in items], pa.int64()), batch.column("__longest"),
                 pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string())),
                 pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=[*columns, "n_words", "n_hit", "n_items", "longest", "hit_spans", "items", "contaminated"])

    return run


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of an item occurs."""
    searched = _searched(docs, items, window, "text", "item_id", "text")
    return searched.where(F.length("__hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
