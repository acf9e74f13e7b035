"""Leaf-wise boosted regression trees over histograms, with one category column.

Rows are binned once and packed into blocks of whole categories; a block holds the bins, targets and predictions of about
``block_rows`` training rows. A round is one job: every task follows the rows of its blocks through the tree so far and
returns sums of residuals and counts by node, feature and bin. These have a fixed size, and only they leave the tasks. Leaves
are split best first by what all rows say.

A tree grown that way takes as many rounds as it is deep, 300 of them some thousands, each with the latency of a job. But one
tree changes the residuals by a twentieth, so the next one is much like it. Each tree is therefore proposed to be the one before
again: the first round counts all rows in all nodes of the proposal at once. A proposed split stands if, over all rows, it lowers
the error as much as the best one there, up to ``slack``; where it does not, the best one is taken and a further round looks
below it, ``rounds`` in all. After the last one a leaf that nobody looked below can still be split, but its halves cannot. So
every split is judged by the sums of all rows. With ``slack`` 0 and no limit of rounds each tree is the exact best-first tree.

The category is ordered anew for every tree by the residual of its rows per row (smoothed): all rows of a category are in one
block, so the order needs no shuffle. Its scale is cut into bins of about equal numbers of rows. A tree remembers the place of
every category; these places grow with the data, and they stay a distributed table.

What a round does is numpy on whole blocks, in jobs over an RDD, which have a third of the latency of a DataFrame job. The leaf of
a row is found by a look into a small table for each group of features, and rows are added up by leaf and combination of bins, so
a round costs some 50 ns a row, about the same for any tree. The blocks are files of the shared folder (_Files): as a cached RDD
they would pass from the executor to its Python workers in every round, which takes longer than the sums.
"""
from __future__ import annotations

import dataclasses
import gc
import json
import math
import os
import pickle
import shutil
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.positions import value_ranks
from shelfwise.session import ensure_checkpoint_dir, materialize, scratch_path, written

#: Steps of the category scale for one doubling, and steps on each side of zero.
_FINE_PER_DOUBLING, _FINE_SIDE = 16, 512

#: A later choice must be better than an earlier one by this part to be taken, so that sums in another order change nothing.
TIE = 1e-9


@dataclasses.dataclass(frozen=True)
class Settings:
    """``l2`` and ``smooth`` are those of the category (its splits and its order); the numeric features have none. ``slack``:
    the part of the best gain that a proposed split may fall short by. ``rounds``: most jobs of a tree, None for no limit."""
    trees: int = 300
    rate: float = 0.05
    leaves: int = 31
    bins: int = 64
    min_rows: int = 20
    max_depth: int = 12
    l2: float = 10.0
    smooth: float = 10.0
    block_rows: int = 1 << 16
    slack: float = 0.2
    rounds: int | None = 4


def exact(**settings) -> Settings:
    """Settings for exact best-first trees."""
    return Settings(slack=0.0, rounds=None, **settings)


@dataclasses.dataclass
class Tree:
    """Nodes in the order in which they were made, the root first. feature is -1 for a leaf; a row goes left if its bin of the
    feature (the last one is the category) is at most ``bin``. cuts: the bins of the category scale of this tree."""
    feature: list[int] = dataclasses.field(default_factory=lambda: [-1])
    bin: list[int] = dataclasses.field(default_factory=lambda: [0])
    left: list[int] = dataclasses.field(default_factory=lambda: [-1])
    right: list[int] = dataclasses.field(default_factory=lambda: [-1])
    value: list[float] = dataclasses.field(default_factory=lambda: [0.0])
    rows: list[int] = dataclasses.field(default_factory=lambda: [0])
    cuts: list[int] = dataclasses.field(default_factory=list)

    def add(self) -> int:
        for name in ("feature", "bin", "left", "right", "value", "rows"):
            getattr(self, name).append(-1 if name in ("feature", "left", "right") else 0)
        return len(self.feature) - 1

    def places(self, bins: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(node, numbers of its rows) for all leaves; ``bins`` is features x rows."""
        out, todo = [], [(0, np.arange(bins.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out.append((node, rows))
            else:
                goes_left = bins[self.feature[node]][rows] <= self.bin[node]
                todo += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for node, rows in self.places(bins):
            out[rows] = self.value[node]
        return out


def fine_step(ratio: np.ndarray) -> np.ndarray:
    """The place of a smoothed residual on a fixed scale with equal steps per doubling, 0 to 2 * _FINE_SIDE."""
    far = np.floor(_FINE_PER_DOUBLING * np.log2(1 + 1024 * np.abs(ratio)))
    return (np.sign(ratio) * np.minimum(far, _FINE_SIDE)).astype(np.int64) + _FINE_SIDE


def scale_cuts(counts: np.ndarray, bins: int) -> list[int]:
    """Steps that end a bin, so that bins have about equal numbers of rows: the first step at which the running count reaches
    k / bins of all, for each k below bins."""
    upto, total = np.cumsum(counts), counts.sum()
    return sorted({int(np.searchsorted(upto, total * k / bins, "left")) for k in range(1, bins)}) if total else []


#: Most cells of a joint count of features, and how many rows a cell must stand for so that it pays.
_JOINT_CELLS, _ROWS_PER_CELL = 1 << 13, 2


def joint_features(widths: Sequence[int]) -> list[list[int]]:
    """Neighbouring features that are counted together: one pass over the rows then serves all of a group."""
    groups: list[list[int]] = []
    cells = 0
    for f, width in enumerate(widths):
        if groups and cells * width <= _JOINT_CELLS:
            groups[-1].append(f)
            cells *= width
        else:
            groups.append([f])
            cells = width
    return groups


@dataclasses.dataclass
class Group:
    """Numeric features that are counted together. code: for each row the number of the combination of its bins; bins: features x
    combinations, only those that the rows have."""
    features: list[int]
    code: np.ndarray
    bins: np.ndarray


def grouped(numeric: np.ndarray, widths: Sequence[int]) -> list[Group]:
    """The features (features x rows) in groups. Neighbours are one group as long as their bins make few combinations: by the
    widths whatever the rows have, beyond that by the combinations that the rows have."""
    out: list[Group] = []
    for features in joint_features(widths):
        code = np.zeros(numeric.shape[1], np.intp)
        for f in features:
            code *= widths[f]
            code += numeric[f]
        code, met = _renumbered(code, math.prod(widths[f] for f in features))
        new = Group(features, code, np.vstack(np.unravel_index(met, [widths[f] for f in features])).astype(np.uint8))
        if out:
            last, width = out[-1], new.bins.shape[1]
            code, met = _renumbered(last.code.astype(np.intp) * width + new.code, last.bins.shape[1] * width)
            if len(met) <= min(_JOINT_CELLS, len(code) // _ROWS_PER_CELL):
                out[-1] = Group(last.features + features, code, np.vstack([last.bins[:, met // width], new.bins[:, met % width]]))
                continue
        out.append(new)
    return out


def _renumbered(code: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(the codes numbered without gaps, the old code of each number); all are below ``cells``."""
    there = np.zeros(cells, bool)
    there[code] = True
    met = np.flatnonzero(there)
    return (np.cumsum(there) - 1)[code].astype(np.uint16 if len(met) <= 1 << 16 else np.intp), met


#: Rows that are worked on at a time, so that what is made of them stays in the cache of a core; leaves that one mask can hold.
_CHUNK, _MASK = 1 << 16, 64


def masks(tree: Tree, wanted: Sequence[int], widths: Sequence[int]) -> list[np.ndarray]:
    """By feature and bin the ``wanted`` leaves (at most _MASK, a bit each) that rows of the bin can be in. A row is in the leaf
    that all its bins have left, so the leaves of many rows are found by a look into a table for each feature."""
    kind = np.uint32 if len(wanted) <= 32 else np.uint64
    below = [0] * len(tree.feature)
    for i, node in enumerate(wanted):
        below[node] = 1 << i
    for node in range(len(below) - 1, -1, -1):  # children have higher numbers than their parent
        if tree.feature[node] >= 0:
            below[node] = below[tree.left[node]] | below[tree.right[node]]
    out = [np.full(width, below[0], kind) for width in widths]
    for node, f in enumerate(tree.feature):
        if f >= 0:
            out[f][:tree.bin[node] + 1] &= kind(below[0] & ~below[tree.right[node]])
            out[f][tree.bin[node] + 1:] &= kind(below[0] & ~below[tree.left[node]])
    return out


@dataclasses.dataclass
class Block:
    """``rows``: the number of rows of each category in ``names``, whose rows stand one after the other; ``groups``: their numeric
    features; ``residual``: target less prediction; ``past``: the place of every category on the scale of each tree so far."""
    names: list[str]
    rows: np.ndarray
    groups: list[Group]
    residual: np.ndarray
    past: list[np.ndarray] = dataclasses.field(default_factory=list)

    def steps(self, smooth: float) -> np.ndarray:
        """The place on the scale of every category of the block."""
        return fine_step(np.add.reduceat(self.residual, np.cumsum(self.rows) - self.rows) / (self.rows + smooth))

    def scale(self, smooth: float) -> np.ndarray:
        """Rows by step of the category scale."""
        return np.bincount(self.steps(smooth), self.rows, 2 * _FINE_SIDE + 1)

    def counted(self, cuts: Sequence[int], smooth: float, bins: int) -> list[Group]:
        """The groups, and the category as the last one."""
        category = np.searchsorted(cuts, self.steps(smooth), "left").astype(np.uint8)
        last = sum(len(g.features) for g in self.groups)
        return [*self.groups, Group([last], np.repeat(category, self.rows), np.arange(bins, dtype=np.uint8)[None, :])]

    def after(self, tree: Tree, smooth: float, bins: int) -> Block:
        """The block with the residuals after one more tree."""
        leaves = [node for node, f in enumerate(tree.feature) if f < 0]
        values = np.append(0.0, [tree.value[node] for node in leaves])
        residual = self.residual - values[numbers(self.counted(tree.cuts, smooth, bins), tree, leaves)]
        return dataclasses.replace(self, residual=residual, past=[*self.past, self.steps(smooth).astype(np.int16)])


def numbers(groups: list[Group], tree: Tree, leaves: Sequence[int]) -> np.ndarray:
    """For each row the place of its leaf in ``leaves``, from 1; 0 where its leaf is not there."""
    n = len(groups[0].code)
    widths = [0] * sum(len(g.features) for g in groups)
    for g in groups:
        for f, bins in zip(g.features, g.bins, strict=True):
            widths[f] = int(bins.max()) + 1
    out = np.zeros(n, np.uint8 if len(leaves) <= _MASK else np.intp)
    for first in range(0, len(leaves), _MASK):
        by_feature = masks(tree, leaves[first:first + _MASK], widths)
        tables = []
        for g in groups:
            table = by_feature[g.features[0]][g.bins[0]]
            for f, bins in zip(g.features[1:], g.bins[1:], strict=True):
                table = table & by_feature[f][bins]
            tables.append(table)
        for at in range(0, n, _CHUNK):
            rows = slice(at, at + _CHUNK)
            left = tables[0][groups[0].code[rows]]
            for g, table in zip(groups[1:], tables[1:], strict=True):
                left &= table[g.code[rows]]
            # one bit at most is left: the exponent of the mask as a float is its place (the bits of 0.0 are 0)
            place = np.maximum((left.astype(np.float32).view(np.int32) >> 23) - 126, 0)
            out[rows] = np.where(place, place + first, out[rows]) if first else place
    return out


def histogram(bins: np.ndarray, rows: np.ndarray | None, residual: np.ndarray, width: int,
              widths: Sequence[int] | None = None) -> np.ndarray:
    """2 x features x width: sums of residuals and counts. ``widths``: numbers of bins of the features where they are known;
    several features are then counted by their bins together, if the rows are many, and the sums of each are read off that."""
    out = np.zeros((2, len(bins), width))
    if rows is not None:
        residual = residual[rows]
    for group in joint_features(widths) if widths else [[f] for f in range(len(bins))]:
        shape = [widths[f] for f in group] if widths else [width]
        cells = math.prod(shape)
        if len(group) == 1 or cells * _ROWS_PER_CELL > len(residual):
            for f in group:
                b = (bins[f] if rows is None else bins[f][rows]).astype(np.intp)
                out[0, f] = np.bincount(b, residual, width)[:width]
                out[1, f] = np.bincount(b, minlength=width)[:width]
            continue
        code = np.zeros(len(residual), np.intp)
        for f in group:
            code *= widths[f]
            code += bins[f] if rows is None else bins[f][rows]
        both = np.stack([np.bincount(code, residual, cells), np.bincount(code, minlength=cells)]).reshape(2, *shape)
        for i, f in enumerate(group):
            out[:, f, :widths[f]] = both.sum(tuple(k for k in range(1, len(group) + 1) if k != i + 1))
    return out


class _Leaf:
    """A node that may be split. ``proposed``: a split and two leaves below it that others suggest."""

    def __init__(self, depth: int, proposed: tuple | None = None) -> None:
        self.depth, self.proposed = depth, proposed
        self.hist: np.ndarray | None = None
        self.gain, self.split, self.children = 0.0, None, None

    def seen(self, hist: np.ndarray, s: Settings) -> None:
        """Takes the sums of all rows; a proposal that they bear out brings its children."""
        self.hist = hist
        if self.depth < s.max_depth:
            self.gain, self.split = best_split(hist, s)
        if self.proposed and self.split is not None:
            split, children = self.proposed
            gain = self.gain if split == self.split else gains(hist, s)[split] if s.slack else 0.0
            if gain > 0 and gain >= self.gain * (1 - s.slack):
                self.gain, self.split, self.children = gain, split, children

    @property
    def rows(self) -> float:
        return float(self.hist[1, 0].sum())

    @property
    def total(self) -> float:
        return float(self.hist[0, 0].sum())


def gains(hist: np.ndarray, s: Settings) -> np.ndarray:
    """By feature and bin, by how much a split there lowers the squared error; 0 where it leaves less than min_rows on a side."""
    g, n = hist[0, 0].sum(), hist[1, 0].sum()
    left_g, left_n = np.cumsum(hist[0], 1)[:, :-1], np.cumsum(hist[1], 1)[:, :-1]
    l2 = np.zeros((len(hist[0]), 1))
    l2[-1] = s.l2
    allowed = (left_n >= s.min_rows) & (n - left_n >= s.min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_n + l2) + (g - left_g) ** 2 / (n - left_n + l2) - g ** 2 / (n + l2)
    return np.where(allowed, gain, 0.0)


def best_split(hist: np.ndarray, s: Settings) -> tuple[float, tuple[int, int] | None]:
    """(gain, (feature, bin)) of a leaf: the split that lowers the squared error most; of equal ones the first feature and the
    lowest bin. None if no split leaves min_rows on both sides or lowers the error."""
    gain, (g, n) = gains(hist, s), hist[:, 0].sum(1)
    top = gain.max(initial=0.0)
    if not top > 1e-12 * max(1.0, abs(g)):
        return 0.0, None
    f, b = np.argwhere(gain >= top - TIE * (top + g * g / n))[0]  # a gain is a small difference of terms of that size
    return float(gain[f, b]), (int(f), int(b))


def chosen(root: _Leaf, s: Settings, last: bool = False) -> tuple[list[_Leaf], list[_Leaf]]:
    """(the leaves to split, best first; the leaves that must be looked below before it can go on, none if it is done).
    ``last``: goes on without looking, so that what is below those leaves stays whole."""
    frontier, splits = [root], []
    while len(splits) < s.leaves - 1:
        able = [x for x in frontier if x.split is not None]
        if not able:
            break
        top = max(x.gain for x in able)
        leaf = next(x for x in able if x.gain >= top * (1 - TIE))  # the one made first among equals
        known = leaf.children is not None and leaf.children[0].hist is not None
        if not known and not last and len(splits) < s.leaves - 2:
            room = s.leaves - 1 - len(splits)
            unseen = [x for x in able if x.children is None or x.children[0].hist is None]
            return splits, sorted(unseen, key=lambda x: -x.gain)[:room]
        splits.append(leaf)
        frontier.remove(leaf)
        frontier += leaf.children if known else ()
    return splits, []


def drawn(root: _Leaf, splits: list[_Leaf], cuts: list[int], s: Settings) -> Tree:
    """The tree of the chosen splits, its nodes numbered in the order of the splits."""
    tree, number, last = Tree(cuts=list(cuts)), {id(root): 0}, root.hist.shape[1] - 1

    def value(total: float, rows: float, by_category: bool) -> float:
        return float(s.rate * total / (rows + (s.l2 if by_category else 0.0))) if rows else 0.0

    tree.value[0], tree.rows[0] = value(root.total, root.rows, False), round(root.rows)
    for leaf in splits:
        at, (f, b) = number[id(leaf)], leaf.split
        tree.feature[at], tree.bin[at] = f, b
        part = leaf.hist[:, f, :b + 1].sum(1)
        sides = (part, np.array([leaf.total, leaf.rows]) - part)
        for side, child, (total, rows) in zip(("left", "right"), leaf.children or (None, None), sides, strict=True):
            node = tree.add()
            getattr(tree, side)[at] = node
            tree.value[node], tree.rows[node] = value(total, rows, f == last), round(float(rows))
            if child is not None:
                number[id(child)] = node
    return tree


def sketch(root: _Leaf, cuts: list[int]) -> tuple[Tree, list[_Leaf]]:
    """(the nodes below a leaf with the splits that they have or are proposed to have; the leaf of each node)."""
    tree, leaves = Tree(cuts=list(cuts)), [root]
    at = 0
    while at < len(leaves):
        leaf = leaves[at]
        split, children = (leaf.split, leaf.children) if leaf.children else (leaf.proposed or (None, None))
        if leaf.hist is not None and not leaf.children:
            children = None
        if children:
            tree.feature[at], tree.bin[at] = split
            tree.left[at], tree.right[at] = tree.add(), tree.add()
            leaves += children
        at += 1
    return tree, leaves


def proposed(tree: Tree, node: int = 0, depth: int = 0) -> _Leaf:
    """A root whose splits are suggested by another tree."""
    if tree.feature[node] < 0:
        return _Leaf(depth)
    children = tuple(proposed(tree, child, depth + 1) for child in (tree.left[node], tree.right[node]))
    return _Leaf(depth, ((tree.feature[node], tree.bin[node]), children))


def leaf_histograms(block: Block, tree: Tree, s: Settings, leaves: Sequence[int]) -> np.ndarray:
    """Sums and counts of the rows in the given leaves of ``tree``: leaves x 2 x features x bins. Rows are added up by the
    combinations of a group; the sums of each feature are read off those."""
    groups = block.counted(tree.cuts, s.smooth, s.bins)
    out = np.zeros((len(leaves), 2, sum(len(g.features) for g in groups), s.bins))
    number, residual, rows = numbers(groups, tree, leaves), block.residual, None
    here = np.count_nonzero(number)
    if here < len(number):
        rows = np.flatnonzero(number)
        number, residual = number[rows], residual[rows]
    key = np.empty(here, np.intp)
    for g in groups:
        code, cells = g.code if rows is None else g.code[rows], g.bins.shape[1]
        for at in range(0, here, _CHUNK):
            part = slice(at, at + _CHUNK)
            np.multiply(number[part], cells, out=key[part], dtype=np.intp)
            key[part] += code[part]
            key[part] -= cells
        sums = np.bincount(key, residual, len(leaves) * cells)
        counts = np.bincount(key, minlength=len(leaves) * cells)
        met = np.flatnonzero(counts)
        sums, counts, (leaf, cell) = sums[met], counts[met], np.divmod(met, cells)
        for f, bins in zip(g.features, g.bins, strict=True):
            at = leaf * s.bins + bins[cell]
            out[:, 0, f] = np.bincount(at, sums, len(leaves) * s.bins).reshape(-1, s.bins)
            out[:, 1, f] = np.bincount(at, counts, len(leaves) * s.bins).reshape(-1, s.bins)
    return out


def add_up(blocks: RDD, per_block, n_tasks: int) -> np.ndarray:
    """The sum over all blocks of an array of a fixed shape. A task adds up its own blocks; where there are many tasks, others
    add up their sums before the driver sees them."""
    def run(part):
        if not gc.get_freeze_count():
            gc.freeze()  # a worker collects garbage after each task, which looks through all loaded modules
        total = None
        for block in part:
            x = per_block(block)
            total = x if total is None else total + x
        return [] if total is None else [total]

    parts = blocks.mapPartitions(run)
    return parts.treeReduce(np.add, 3) if n_tasks > 64 else sum(parts.collect())


def grow(blocks: RDD, n_tasks: int, cuts: list[int], s: Settings, like: Tree) -> tuple[Tree, np.ndarray]:
    """(a tree of up to ``leaves`` leaves, grown best first; rows by step of the category scale). ``like``: the proposal.
    A round after the first looks only at the rows of leaves that no round has counted."""
    root, steps, rounds = proposed(like), None, 0
    while True:
        rounds += 1
        tree, leaves = sketch(root, cuts)
        first = steps is None
        new = [i for i, leaf in enumerate(leaves) if leaf.hist is None and tree.feature[i] < 0]

        def count(block: Block, tree: Tree = tree, first: bool = first, new: list[int] = new) -> np.ndarray:
            out = leaf_histograms(block, tree, s, new).ravel()
            return np.append(out, block.scale(s.smooth)) if first else out

        got = add_up(blocks, count, n_tasks)
        if first:
            got, steps = got[:-(2 * _FINE_SIDE + 1)], got[-(2 * _FINE_SIDE + 1):]
        hists = [leaf.hist for leaf in leaves]
        for i, hist in zip(new, got.reshape(len(new), 2, -1, s.bins), strict=True):
            hists[i] = hist
        for i in range(len(leaves) - 1, -1, -1):  # a node has the rows of its children, which have higher numbers
            if hists[i] is None:
                hists[i] = hists[tree.left[i]] + hists[tree.right[i]]
        for leaf, hist in zip(leaves, hists, strict=True):
            if leaf.hist is None:
                leaf.seen(hist, s)
        splits, unseen = chosen(root, s, rounds == s.rounds)
        if not unseen:
            return drawn(root, splits, cuts, s), steps
        for leaf in unseen:
            leaf.children = (_Leaf(leaf.depth + 1), _Leaf(leaf.depth + 1))


# ---------------------------------------------------------------- data
def feature_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature the values that end a bin; bin = number of edges below a value.

    The most common value of a feature is a bin of its own. The other rows are cut at the values where the k-th part of
    bins - 2 of them is reached. Rows are counted by value first, so most rows may share one.
    """
    ranks = value_ranks(rows, features)
    mode = ranks.groupBy("_name").agg(F.max_by(F.struct(F.col("_v").alias("m"), F.col("_c").alias("mc")),
                                               F.struct("_c", -F.col("_v"))).alias("_mode")).select("_name", "_mode.*")
    rest = ranks.join(F.broadcast(mode), "_name")
    before = F.col("_before") - F.when(F.col("_v") > F.col("m"), F.col("mc")).otherwise(0)
    n = F.col("_n") - F.col("mc")
    ends = F.floor((before + F.col("_c")) * (bins - 2) / n) > F.floor(before * (bins - 2) / n)
    edge = (F.col("_v") == F.col("m")) | (F.col("_v") < F.col("m")) & (F.col("_before") + F.col("_c") == F.col("_below")) | ends
    rest = rest.join(F.broadcast(ranks.join(F.broadcast(mode), "_name").where(F.col("_v") == F.col("m"))
                                 .select("_name", F.col("_before").alias("_below"))), "_name")
    last = F.col("_before") + F.col("_c") == F.col("_n")
    found = rest.where(edge & ~last).groupBy("_name").agg(F.array_sort(F.collect_list("_v")).alias("edges")).collect()
    by_name = {r["_name"]: list(r["edges"]) for r in found}
    return [by_name.get(f, []) for f in features]


def pack(rows: DataFrame, features: Sequence[str], category: str, target: str, edges: list[list[float]], start: float,
         block_rows: int) -> tuple[DataFrame, int]:
    """(a block of whole categories for each partition, dealt by a hash, of about 16 times ``block_rows`` rows at most (a
    category with more makes a larger one): names, rows, bins, residual; number of tasks for them). Rows are binned before they
    are dealt out, so a byte for each feature moves. A task has up to 16 blocks, and holds one at a time."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = -(-rows.count() // (16 * block_rows))
    n_tasks = cores * max(1, -(-n // (16 * cores)))
    n_blocks = n_tasks * max(1, -(-n // n_tasks))
    cast = [F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
    wide = rows.select(F.col(category).cast("string").alias("_category"), F.col(target).cast("double").alias("_y"), *cast)
    width = len(features)

    def binned(batches):
        for batch in batches:
            bins = np.empty((batch.num_rows, width), np.uint8)
            for i, e in enumerate(edges):
                bins[:, i] = np.searchsorted(e, batch.column(f"_{i}").to_numpy(zero_copy_only=False), "left")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column("_category"), batch.column("_y"), packed], names=["_category", "_y", "_bins"])

    def block(batches):
        names: dict[str | None, int] = {}
        parts = []
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("_category").dictionary_encode(null_encoding="encode")
            number = np.array([names.setdefault(name, len(names)) for name in coded.dictionary.to_pylist()], np.int32)
            column = batch.column("_bins").cast(pa.binary())
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:]
            bins = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[batch.num_rows]]
            parts.append((number[coded.indices.to_numpy()], bins.reshape(-1, width).copy(), batch.column("_y").to_numpy() - start))
        if parts:
            at, bins, residual = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(at, kind="stable")
            values = [[list(names)], [np.bincount(at).tobytes()], [bins[order].T.tobytes()], [residual[order].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.list_(pa.string())] + [pa.binary()] * 3,
                                                                             strict=True)], names=["names", "rows", "bins", "residual"])

    slim = wide.mapInArrow(binned, "_category string, _y double, _bins binary").repartition(n_blocks, "_category")
    return slim.mapInArrow(block, "names array<string>, rows binary, bins binary, residual binary"), n_tasks


def _unpacked(row, widths: Sequence[int]) -> Block:
    residual = np.frombuffer(row["residual"], np.float64)
    numeric = np.frombuffer(row["bins"], np.uint8).reshape(-1, len(residual))
    return Block(row["names"], np.frombuffer(row["rows"], np.int64), grouped(numeric, widths), residual)


@dataclasses.dataclass
class Boosted:
    """A fitted model. steps: category (string), steps (binary, an int16 per tree: its place on the scale of that tree)."""
    features: list[str]
    category: str
    start: float
    edges: list[list[float]]
    trees: list[Tree]
    steps: DataFrame
    name: str = "gbt_global"

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` and prediction (double). A category that was not trained on, and a null one, counts as one without any
        residual (the middle of every scale); a null feature goes with the lowest values."""
        known = self.steps.select(F.col("category").alias("__category"), "steps")
        data = rows.join(known, F.col(self.category).cast("string") == F.col("__category"), "left").drop("__category")
        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias(f"__{i}") for i, f in enumerate(self.features)]
        kept = rows.columns
        slim = data.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "steps", *inputs)
        trees, edges, start = self.trees, self.edges, self.start

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                numeric = [np.searchsorted(e, batch.column(f"__{i}").to_numpy(zero_copy_only=False), "left")
                           for i, e in enumerate(edges)]
                bins = np.zeros((len(edges) + 1, n), np.int64)
                bins[:-1] = numeric
                step = np.full((len(trees), n), _FINE_SIDE, np.int64)
                column = batch.column("steps")
                for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
                    step[:, i] = np.frombuffer(column[int(i)].as_buffer(), np.int16)
                out = np.full(n, start)
                for k, tree in enumerate(trees):
                    bins[-1] = np.searchsorted(tree.cuts, step[k], "left")
                    out += tree.predict(bins)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "prediction"])

        done = slim.mapInArrow(run, slim.select("row").withColumn("prediction", F.lit(0.0)).schema)
        return done.select("row.*", "prediction")

    def save(self, path: str) -> None:
        spark = self.steps.sparkSession
        self.steps.write.mode("overwrite").parquet(f"{path}/steps")
        about = {"features": self.features, "category": self.category, "start": self.start, "edges": self.edges,
                 "name": self.name}
        lines = [json.dumps(about)] + [json.dumps(dataclasses.asdict(t)) for t in self.trees]
        numbered = spark.createDataFrame(list(enumerate(lines)), "no int, line string")
        numbered.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        lines = [r["line"] for r in spark.read.parquet(f"{path}/model").orderBy("no").collect()]
        return cls(**json.loads(lines[0]), trees=[Tree(**json.loads(x)) for x in lines[1:]],
                   steps=spark.read.parquet(f"{path}/steps"))


class _Cached:
    """Blocks as an RDD that the executors keep. Every ``cut_lineage`` trees it is written to spark.checkpoint.dir, so that a lost
    executor costs that many updates of its blocks at most."""

    def __init__(self, blocks: RDD, n_tasks: int, s: Settings, cut_lineage: int) -> None:
        self.s, self.n_tasks, self.cut_lineage = s, n_tasks, cut_lineage
        self.trees, self.before, self.blocks = 0, None, blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def add(self, tree: Tree) -> None:
        """From now on the blocks are those after one more tree; the next job makes them."""
        self.free()
        self.before, s = self.blocks, self.s
        self.blocks = self.before.map(lambda block: block.after(tree, s.smooth, s.bins)).persist(StorageLevel.MEMORY_AND_DISK)
        self.trees += 1
        if self.trees % self.cut_lineage == 0:
            self.blocks.checkpoint()

    def free(self) -> None:
        """Lets go of what the blocks were made from."""
        if self.before is not None:
            self.before.unpersist()

    def close(self) -> None:
        self.free()
        self.blocks.unpersist()


#: Bytes that make more than two packets of the loopback device.
_PACKETS = 1 << 17


class _Files:
    """Blocks as files of spark.checkpoint.dir, where that is a folder that all tasks can open. A task reads them as it reads
    memory, while a cached RDD comes to it through a pipe, which takes longer than the sums. A block has a file of what never
    changes, and one of its residuals after each tree: the first job that asks for it makes it from the one before and puts it
    there as a whole, so a repeated task changes nothing and a lost executor costs nothing. Two of them are kept."""

    def __init__(self, blocks: RDD, folder: str, s: Settings) -> None:
        self.s, self.folder, self.trees = s, folder, 0

        def write(task: int, part: Iterator[Block]) -> list[list[str]]:
            names = []
            for block in part:
                names.append(f"{folder}/{task}-{len(names)}")
                _dump((block.names, block.rows, block.groups), names[-1])
                _dump((block.residual, block.past), f"{names[-1]}-0")
            return [names] if names else []

        os.makedirs(folder, exist_ok=True)
        names = blocks.mapPartitionsWithIndex(write).collect()
        self.n_tasks = len(names)
        # with so little data a worker would wait 40 ms for it (the pipe holds a second small packet back until the first is
        # acknowledged); one that is larger than a packet goes at once
        self.names = blocks.context.parallelize([(x, bytes(_PACKETS)) for x in names], self.n_tasks)
        self.blocks = self._after(None)

    def _after(self, tree: Tree | None) -> RDD:
        trees, s = self.trees, self.s

        def read(task: tuple[list[str], bytes]) -> Iterator[Block]:
            for name in task[0]:
                if not os.path.exists(f"{name}-{trees}"):
                    block = Block(*_load(name), *_load(f"{name}-{trees - 1}")).after(tree, s.smooth, s.bins)
                    _dump((block.residual, block.past), f"{name}-{trees}")
                    if os.path.exists(old := f"{name}-{trees - 2}"):
                        os.remove(old)
                    yield block
                else:
                    yield Block(*_load(name), *_load(f"{name}-{trees}"))

        return self.names.flatMap(read)

    def add(self, tree: Tree) -> None:
        """From now on the blocks are those after one more tree; the next job makes them."""
        self.trees += 1
        self.blocks = self._after(tree)

    def free(self) -> None:
        pass

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def _dump(x, path: str) -> None:
    """Writes a file that is there as a whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        pickle.dump(x, f, pickle.HIGHEST_PROTOCOL)
    os.replace(part, path)


def _load(path: str):
    with open(path, "rb") as f:
        return pickle.load(f)


def open_folder(uri: str) -> str | None:
    """The path of a folder that Python can open; None for any other store."""
    at = urlsplit(uri)
    return unquote(at.path) if at.scheme in ("", "file") and at.netloc in ("", "localhost") else None


def fit(rows: DataFrame, features: Sequence[str], category: str, target: str, s: Settings | None = None,
        cut_lineage: int = 25) -> Boosted:
    """Fits boosted trees to ``rows`` (features and target without nulls). The blocks go from tree to tree with their residuals:
    as files of spark.checkpoint.dir, or where tasks cannot open that, kept by the executors (see _Files and _Cached)."""
    s = s or Settings()
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = written(rows.select(category, *features, target), "gbt-rows")
    start = rows.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if start is None:
        raise ValueError("no rows to fit")
    edges = feature_edges(rows, features, s.bins)
    packed, n_tasks = pack(rows, features, category, target, edges, start, s.block_rows)
    packed = materialize(packed)
    widths = [len(e) + 1 for e in edges]
    unpacked = packed.rdd.coalesce(n_tasks).map(lambda row: _unpacked(row, widths))
    folder = open_folder(scratch_path(spark, "gbt-blocks"))
    held = _Cached(unpacked, n_tasks, s, cut_lineage) if folder is None else _Files(unpacked, folder, s)
    counts = add_up(held.blocks, lambda block: block.scale(s.smooth), held.n_tasks)
    cuts, trees, tree = scale_cuts(counts, s.bins), [], Tree()
    while len(trees) < s.trees:
        limits = s if trees else dataclasses.replace(s, rounds=None)  # nothing is proposed for the first one
        tree, steps = grow(held.blocks, held.n_tasks, cuts, limits, tree)  # its first job makes the held blocks
        held.free()
        trees.append(tree)
        cuts = scale_cuts(steps, s.bins)  # the next tree's scale is cut by the counts at this one
        held.add(tree)
    names = held.blocks.flatMap(lambda block: zip(block.names, (x.tobytes() for x in np.stack(block.past, 1)), strict=True))
    table = materialize(spark.createDataFrame(names, "category string, steps binary"))
    held.close()
    return Boosted(list(features), category, float(start), edges, trees, table)
