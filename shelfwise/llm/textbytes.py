"""Numpy views of Arrow text columns, shared by the operators that work inside tasks.

A batch of texts is looked at as one UTF-8 byte buffer plus row offsets, so that word boundaries, word
hashes and counts are array operations over all rows of the batch at once.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; the arrays of one piece take about 40 times as much memory.
PIECE_BYTES = 2 << 20

#: The ASCII white space \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text. offsets has one more entry than rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with at most ``max_bytes`` of text (a longer row stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        i = 0
        while i < n:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(i, j - i)
            i = j


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True; no run crosses a row boundary."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    cut = offsets[:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = member[cut]
    last[cut - 1] = member[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the index of its first span; one more entry than rows, so differences are counts."""
    return np.searchsorted(starts, offsets, "left")


class PrefixHash:
    """64-bit polynomial hashes of any byte ranges of one buffer, from prefix sums (arithmetic modulo 2^64)."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self._sums = np.zeros(n + 1, np.uint64)
        np.multiply(_BYTE_VALUE[raw], self._power(_BASE, n), out=self._sums[1:])
        np.cumsum(self._sums, out=self._sums)
        self._n = n

    @staticmethod
    def _power(base: int, n: int) -> np.ndarray:
        have = _powers.get(base)
        if have is None or len(have) < n + 1:
            size = max(n + 1, PIECE_BYTES + 1)
            out = np.full(size, base, np.uint64)
            out[0] = 1
            have = np.cumprod(out, out=out)
            if size <= PIECE_BYTES + 1:
                _powers[base] = have
        return have[:n]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = self._power(_INVERSE, self._n + 1)
        h = (self._sums[ends] - self._sums[starts]) * back[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
