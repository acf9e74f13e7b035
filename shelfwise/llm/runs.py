"""Operator 11, periodic runs found with a dictionary of basic factors.

A basic factor is a stretch of 2^k words. Every level k names the factors of a text: equal stretches, equal names, each level
from the pairs of names of the level before. Where a factor occurs again within twice its length, the distance is a proposed
period; neighbouring positions with one distance form an arithmetic progression and are proposed once. A proposal is extended
to both sides through the names (as long as the words one period apart are equal), short ones go, and of equal stretches the
one with the least period stays.

No run is missed: let a run have smallest period q and at least 2q + 2^k words, where q <= 2^k < 2q. A factor of 2^k words that
begins in the run cannot occur again after fewer than q words, as the run would then have a smaller period, so the successor
is q words away, which is within twice the length. Runs of four periods have that many words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shelfwise.llm import textbytes as tb

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words only (the words are compared, not hashes of them)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = ends - starts
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class BasicFactors:
    """Names of the factors of 1, 2, 4, ... words of all rows of a piece.

    levels[k][i]: the name (0 or more) of the factor of 2^k words that begins with word i, if its row has it again; else a
    negative number that no other place has. Names of different rows differ, so nothing is compared across rows. Places
    whose factor is alone are left out of all longer levels, which makes these short in ordinary prose.
    """

    def __init__(self, codes: np.ndarray, row: np.ndarray) -> None:
        self.n = n = len(codes)
        self.levels: list[np.ndarray] = []
        self.repeated: list[np.ndarray] = []  # the places with a name, ascending
        at = np.arange(n)
        key = row * (int(codes.max()) + 1) + codes if n else codes
        while len(at):
            names = -1 - np.arange(n, dtype=np.int64)
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            at = at[again]
            names[at] = inverse[again]
            if not len(at):
                break
            self.levels.append(names)
            self.repeated.append(at)
            half = 1 << (len(self.levels) - 1)
            at = at[at + half < n]
            at = at[names[at + half] >= 0]
            key = names[at] * n + names[at + half]

    def successors(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distance to the next occurrence of the same factor of 2^k words), places ascending, those without a
        next one left out."""
        at = self.repeated[k]
        by_name = np.argsort(self.levels[k][at], kind="stable")
        sorted_at = at[by_name]
        name = self.levels[k][sorted_at]
        same = np.flatnonzero(name[1:] == name[:-1])
        places, distance = sorted_at[same], sorted_at[same + 1] - sorted_at[same]
        order = np.argsort(places, kind="stable")
        return places[order], distance[order]

    def _match(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a[j] and b[j] on (forward), or before them (backward), are equal."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, names = 1 << k, self.levels[k]
            open_ = np.arange(len(a))
            while len(open_):
                x, y = (a[open_] + far[open_], b[open_] + far[open_]) if forward else \
                       (a[open_] - far[open_] - step, b[open_] - far[open_] - step)
                inside = (x >= 0) & (y < self.n)
                open_, x, y = open_[inside], x[inside], y[inside]
                equal = names[x] == names[y]
                open_ = open_[equal]
                far[open_] += step
                if k < len(self.levels) - 1:
                    break  # below the highest level a second step would have been one step of the level above
        return far

    def runs(self, min_words: int, min_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, ordered by start, then period."""
        found = [np.zeros((0, 3), np.int64)]
        for k in range(len(self.levels)):
            at, distance = self.successors(k)
            near = distance <= 2 << k
            at, distance = at[near], distance[near]
            first = np.ones(len(at), bool)  # of a progression: the place before has another distance, or none
            first[1:] = (at[1:] != at[:-1] + 1) | (distance[1:] != distance[:-1])
            at, distance = at[first], distance[first]
            start = at - self._match(at, at + distance, False)
            end = at + distance + self._match(at, at + distance, True)
            long_ = end - start >= np.maximum(min_words, min_periods * distance)
            found.append(np.stack([start, end, distance], 1)[long_])
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
        every = every[new]
        every = every[np.lexsort((every[:, 2], every[:, 0]))]
        return every[:, 0], every[:, 1], every[:, 2]


def _collapsed(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray,
               row: np.ndarray) -> pa.Array:
    """The kept words of every row joined by one space."""
    starts, ends, row = starts[kept], ends[kept], row[kept]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    text = raw.copy()
    before = starts[1:][row[1:] == row[:-1]] - 1  # white space: a word is as long as it can be
    mask[before] = True
    text[before] = 0x20
    upto = np.append(0, np.cumsum(mask, dtype=np.int64))[offsets]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(upto), pa.py_buffer(text[mask])])


def periodic_runs(docs: DataFrame, min_words: int = 6, min_periods: int = 4) -> DataFrame:
    """All columns of ``docs`` (text at least), then n_words, runs (array of start, length, period in words, by start, then
    period) and collapsed (the text without the repetitions of each run, words joined by one space).

    Words are runs of characters other than \\x20 and \\x09-\\x0D, numbered from 0. A run is a stretch of words with smallest
    period q, at least max(min_words, min_periods * q) long, that no neighbouring word extends; min_periods is 3 or more. A
    word is left out of collapsed if a run has it after that run's first q words. A null text has no words: no runs, and an
    empty collapsed text. Rows do not depend on each other, so repeated rows give equal results and an empty table an empty
    one. Columns of ``docs`` with the name of a result column are replaced. A very long text is one piece of work of its own
    size times a constant (about 100 bytes a word and level).
    """
    if min_periods < 3:
        raise ValueError("min_periods below 3: a run of fewer periods may have no factor that proposes its period")
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()),
                         StructField("runs", ArrayType(StructType().add("start", "long").add("length", "long")
                                                       .add("period", "long"))),
                         StructField("collapsed", StringType())])
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches):
            raw, offsets = tb.utf8(piece.column("text"))
            starts, ends = tb.spans(~tb.SPACE[raw], offsets)
            first = tb.rows_of(starts, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            start, end, period = BasicFactors(word_codes(raw, starts, ends), row).runs(min_words, min_periods)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, end, -1)
            kept = np.cumsum(cover[:-1]) == 0
            of_row = row[start]
            bounds = np.searchsorted(of_row, np.arange(len(offsets))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(start - first[of_row]), pa.array(end - start), pa.array(period)],
                                                fields=list(span))
            columns = [*piece.columns, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), values),
                       _collapsed(raw, offsets, starts, ends, kept, row).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def strongest(runs):
    """Column: of an array of runs by start, then period, the one with the greatest length / period, compared exactly; the
    first of equal ones; null if there is none."""
    nothing = F.lit(None).cast(RUN)
    return F.aggregate(runs, nothing, lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
