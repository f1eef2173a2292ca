"""A random forest on sparse vectors, which grows each tree where its rows are.

Columns are cut into at most ``BINS`` ranges, as MLlib's forest does, and rows become blocks that name only the cells outside the range
of 0. A node that holds more than ``UNIT`` cells is split by a job over all blocks, which adds up the sums of its drawn columns. Every
smaller node is a unit, whose whole subtree is grown by one task from the unit's rows. A task grows several units one after another and is
sent each row that any of them has once: all rows of a small table, ``HELD`` cells of a large one, whose trees go in batches.

Node by node the rules are MLlib's: a Poisson draw of each row per tree, the root of the number of columns drawn per node, Gini gain,
leaves that are pure, at the last level or without gain, siblings of one prediction merged. Draws are hashes of tree and node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.operators.network import Rows, entries, sparse_rows

#: Ranges of a column at most; rows from which they are found, as many as MLlib takes.
BINS, SAMPLE = 32, 10_000
#: Rows and cells of a block at most; cells of a unit; cells that a task is sent; cells of larger tables sent at a time; numbers of a job's sums.
BLOCK_ROWS, BLOCK_CELLS, UNIT, HELD, SENT, SUMS = 4096, 1 << 18, 1 << 24, 1 << 26, 1 << 30, 1 << 23
#: Cells looked at in one step; numbers of a table of nodes and columns.
STEP, TABLE = 1 << 20, 1 << 24
#: Share of rows that a draw takes at least once; a gain that counts as none.
DRAWN, NONE = 1 - np.exp(-1), 1e-14
BLOCK_SCHEMA = "place long, offsets binary, indices binary, bins binary, label binary, weight binary"


def kinds(width: int) -> tuple:
    """Of a block's offsets, columns, ranges, labels and weights."""
    return np.int32, np.uint16 if width <= 1 << 16 else np.int32, np.uint8, np.int32, np.float64


# ---- ranges of columns -------------------------------------------------------------------------------------------
def bounds_of(values: np.ndarray, weights: np.ndarray, total: float) -> list[float]:
    """Upper bounds of a column's ranges but the last, from its non-zero values; the rest of the ``total`` weight are zeros."""
    value, place = np.unique(values, return_inverse=True)
    count = np.bincount(place, weights, len(value))
    rest = total - count.sum()
    if rest > 1e-9 * total:
        at = int(np.searchsorted(value, 0.0))
        value, count = np.insert(value, at, 0.0), np.insert(count, at, rest)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) < BINS:
        return middle.tolist()
    stride, out, upto = total / BINS, [], np.cumsum(count)
    target = stride
    for before, now, bound in zip(upto, upto[1:], middle):
        if abs(before - target) < abs(now - target):
            out.append(float(bound))
            target += stride
    return out[: BINS - 1]


def bounds(sample: pa.Table, width: int, flags: list[int]) -> np.ndarray:
    """(width x (BINS - 1)) upper bounds, filled up with infinity. ``flags``: columns known to hold 0 and 1 only."""
    rows, weight = Rows(sample.combine_chunks().to_batches()[0]), sample.column("weight").to_numpy()
    out, n = np.full((width, BINS - 1), np.inf), np.diff(rows.at)
    own = np.repeat(weight, n)
    order = np.argsort(rows.indices, kind="stable")
    order = order[rows.values[order] != 0]
    index = rows.indices[order]
    for c, some in zip(np.unique(index), np.split(order, np.flatnonzero(np.diff(index)) + 1)):
        found = bounds_of(rows.values[some], own[some], weight.sum())
        out[c, : len(found)] = found
    for c in flags:
        out[c] = [0.5, *[np.inf] * (BINS - 2)]
    return out


def bins_of(cuts: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The range of each value: how many of its column's bounds lie below it."""
    flat, first, out = cuts.ravel(), index.astype(np.int64) * (BINS - 1) - 1, np.zeros(len(index), np.int64)
    step = BINS // 2
    while step:
        out += step * (flat[first + out + step] < value)
        step //= 2
    return out.astype(np.uint8)


# ---- rows --------------------------------------------------------------------------------------------------------
def places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of several ranges, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Cells:
    """Rows of cells (column, range) outside the range of 0, by row and by column."""

    def __init__(self, offsets: np.ndarray, indices: np.ndarray, bins: np.ndarray, width: int):
        self.at, self.indices, self.bins, self.width = offsets.astype(np.int64), indices, bins, width
        order = np.argsort(indices, kind="stable")  # two bytes are sorted by digits
        self.column_row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[order]
        self.column_bin = bins[order]
        self.column_at = np.r_[0, np.cumsum(np.bincount(indices, minlength=width))]

    def of_nodes(self, node: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the cells that the nodes' drawn columns have; ``node`` of each row is -1 for none, key is (node, place drawn, range).

        A node with many rows looks into its columns, one with few into its rows.
        """
        nodes, m = drawn.shape
        inside = np.flatnonzero(node >= 0)
        size = np.bincount(node[inside], minlength=nodes)
        many = size * self.width > len(node) * m
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in np.flatnonzero(many):
            n = self.column_at[drawn[k] + 1] - self.column_at[drawn[k]]
            at = places(self.column_at[drawn[k]], n)
            row = self.column_row[at]
            own = node[row] == k
            out.append((row[own], ((k * m + np.repeat(np.arange(m), n)) * BINS + self.column_bin[at])[own]))
        rows = inside[~many[node[inside]]]
        rows = rows[np.argsort(node[rows], kind="stable")]
        n, first = self.at[rows + 1] - self.at[rows], 0
        upto, held = np.cumsum(n), node[rows]
        while first < len(rows):
            k = held[first]
            last = min(int(np.searchsorted(upto, upto[first] - n[first] + STEP, "right")), int(np.searchsorted(held, k + max(1, TABLE // self.width))))
            last = max(last, first + 1)
            table = np.full((held[last - 1] - k + 1, self.width), -1, np.int32)
            table[np.arange(len(table))[:, None], drawn[k : k + len(table)]] = np.arange(m)
            at = places(self.at[rows[first:last]], n[first:last])
            row = np.repeat(rows[first:last], n[first:last])
            j = table[node[row] - k, self.indices[at]]
            own = np.flatnonzero(j >= 0)
            row, j = row[own], j[own].astype(np.int64)
            out.append((row, (node[row].astype(np.int64) * m + j) * BINS + self.bins[at[own]]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*out))


def block_rows(rows: DataFrame, cuts: np.ndarray, places_of_two: int) -> RDD:
    """(place in the table, offsets, columns, ranges, label, weight) of each block, the latter five as bytes.

    Weights become multiples of a power of two, so that all sums of them are exact, in any order.
    """
    zero = bins_of(cuts, np.arange(len(cuts)), np.zeros(len(cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            table, first = Rows(batch), 0
            label = batch.column("label").to_numpy().astype(np.int32)
            weight = np.ldexp(np.rint(np.ldexp(batch.column("weight").to_numpy(), places_of_two)), -places_of_two)
            while first < len(table):
                last = int(np.searchsorted(table.at, table.at[first] + BLOCK_CELLS, "right")) - 1
                last = min(max(last, first + 1), first + BLOCK_ROWS, len(table))
                own = slice(table.at[first], table.at[last])
                index = table.indices[own]
                bins = bins_of(cuts, index, table.values[own])
                kept = bins != zero[index]
                offsets = np.r_[0, np.cumsum(kept)][table.at[first : last + 1] - table.at[first]]
                parts = (offsets, index[kept], bins[kept], label[first:last], weight[first:last])
                cells = [pa.array([p.astype(kind).tobytes()], pa.binary()) for p, kind in zip(parts, kinds(len(cuts)))]
                yield pa.record_batch([pa.array([place], pa.int64()), *cells], names=["place", "offsets", "indices", "bins", "label", "weight"])
                place, first = place + 1, last

    return rows.mapInArrow(run, BLOCK_SCHEMA).rdd.map(tuple)


def read(cells: Iterable[bytes], width: int) -> list[np.ndarray]:
    return [np.frombuffer(c, kind) for c, kind in zip(cells, kinds(width))]


def draws(seed: int, tree: int, place: int, rows: int) -> np.ndarray:
    """How often a tree takes each row of a block."""
    return np.random.default_rng([seed, tree, place]).poisson(1.0, rows)


# ---- nodes -------------------------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64 bits (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn_columns(seed: int, tree: int, names: np.ndarray, width: int, m: int) -> np.ndarray:
    """(nodes x m) different columns of each node, by the hash of the tree and the node's name: 1 for the root, 2 n and 2 n + 1 below n."""
    if m >= width:
        return np.tile(np.arange(width), (len(names), 1))
    own = mixed(mixed(mixed(np.array([seed], np.uint64)) + np.uint64(tree)) + names.astype(np.uint64))[:, None]
    if width < 8 * m:
        return np.argsort(mixed(own + np.arange(width, dtype=np.uint64)), axis=1, kind="stable")[:, :m]
    n = 2 * m + 8
    while True:  # the first m different ones of many draws
        found = (mixed(own + np.arange(n, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)
        order = np.argsort(found, axis=1, kind="stable")
        same = np.zeros(found.shape, bool)
        same[:, 1:] = np.diff(np.take_along_axis(found, order, 1), axis=1) == 0
        new = np.empty(found.shape, bool)
        np.put_along_axis(new, order, ~same, 1)
        rank = np.cumsum(new, axis=1)
        if (rank[:, -1] >= m).all():
            return found[new & (rank <= m)].reshape(-1, m)
        n *= 2


def best_splits(keys: np.ndarray, sums: np.ndarray, totals: np.ndarray, drawn: np.ndarray, zero: np.ndarray, classes: int):
    """(gain, place drawn, last range of the left side) of each node; the gain is 0 where nothing is gained.

    ``keys``: sorted, each once, of cells outside the range of 0; ``sums`` of each and ``totals`` of each node: weight of each class, then rows.
    """
    nodes, m = drawn.shape
    gain, place, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    if not len(keys):
        return gain, place, cut
    starts = np.flatnonzero(np.diff(keys // BINS, prepend=-1))
    own = keys[starts] // BINS
    rest = totals[own // m] - np.add.reduceat(sums, starts, axis=0)
    some = rest[:, classes] > 0
    keys = np.concatenate([keys, (own * BINS + zero[drawn.ravel()[own]])[some]])
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], np.concatenate([sums, rest[some]])[order]
    group, run = keys // BINS, np.cumsum(sums, axis=0)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    left = run - np.repeat(run[starts] - sums[starts], np.diff(np.r_[starts, len(keys)]), axis=0)
    inner = np.flatnonzero(group[:-1] == group[1:])
    if not len(inner):
        return gain, place, cut
    node, left = group[inner] // m, left[inner, :classes]
    whole = totals[node, :classes]
    right = whole - left
    total, a, b = whole.sum(axis=1), left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        made = ((left**2).sum(axis=1) / a + (right**2).sum(axis=1) / b) / total - (whole**2).sum(axis=1) / total**2
    made = np.where((a > 0) & (b > 0), made, 0.0)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    high = np.maximum.reduceat(made, first)
    top = np.flatnonzero(made == np.repeat(high, np.diff(np.r_[first, len(node)])))
    found, at = np.unique(node[top], return_index=True)
    at = top[at]
    good = made[at] > NONE
    found, at = found[good], at[good]
    gain[found], place[found], cut[found] = made[at], group[inner[at]] % m, keys[inner[at]] % BINS
    return gain, place, cut


def summed(keys: np.ndarray, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(each key once, sorted; weight of each class and rows)."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(starts):
        return keys, np.zeros((0, classes + 1))
    parts = [np.add.reduceat(np.where(label[rows] == c, weight[rows], 0.0), starts) for c in range(classes)]
    return keys[starts], np.column_stack([*parts, np.diff(np.r_[starts, len(keys)])]).astype(float)


def grow(cells: Cells, label: np.ndarray, weight: np.ndarray, classes: int, zero: np.ndarray, m: int, depth: int, seed: int, tree: int, name: int) -> tuple:
    """(column or -1, last range of the left side, left child, weight of each class) of the nodes under the node ``name``, from its rows.

    The right child follows the left one. ``depth``: levels that may still be added.
    """
    n = len(label)
    node, names, at = np.zeros(n, np.int32), np.array([name]), np.zeros(1, np.int64)
    totals = np.array([[*np.bincount(label, weight, classes), n]])
    parts, count = [totals], 1  # (totals) of each level, then what the splits were
    column, cut, below = [], [], []
    for level in range(depth + 1):
        # rows of one class are not split, nor are those at the last level
        going = ((totals[:, :classes] > 0).sum(axis=1) > 1) & (level < depth)
        level_column, level_cut, level_below = np.full(len(names), -1, np.int32), np.zeros(len(names), np.uint8), np.zeros(len(names), np.int32)
        column.append(level_column), cut.append(level_cut), below.append(level_below)
        if not going.any():
            break
        slot = np.where(going, np.cumsum(going) - 1, -1).astype(np.int32)
        node = np.where(node >= 0, slot[node], -1).astype(np.int32)
        names, own = names[going], np.flatnonzero(going)
        drawn = drawn_columns(seed, tree, names, cells.width, m)
        row, key = cells.of_nodes(node, drawn)
        gain, place, last = best_splits(*summed(key, row, label, weight, classes), totals[going], drawn, zero, classes)
        split = gain > 0
        chosen = drawn[np.arange(len(names)), place]
        new = np.where(split, np.cumsum(split) - 1, -1).astype(np.int32)
        level_column[own[split]], level_cut[own[split]], level_below[own[split]] = chosen[split], last[split], count + 2 * new[split]
        if not split.any():
            break
        inside = np.flatnonzero(node >= 0)
        right = np.zeros(n, bool)
        right[inside] = (zero[chosen] > last)[node[inside]]
        hit = key // BINS % m == place[node[row]]
        right[row[hit]] = (key[hit] % BINS) > last[node[row[hit]]]
        node[inside] = np.where(split[node[inside]], 2 * new[node[inside]] + right[inside], -1)
        names = (2 * names[split][:, None] + np.arange(2)).ravel()
        inside = np.flatnonzero(node >= 0)
        per = [np.bincount(node[inside], np.where(label[inside] == c, weight[inside], 0.0), len(names)) for c in range(classes)]
        totals = np.column_stack([*per, np.bincount(node[inside], minlength=len(names))]).astype(float)
        parts.append(totals)
        count += len(names)
    return pruned(np.concatenate(column), np.concatenate(cut), np.concatenate(below), np.concatenate(parts)[:, :classes])


def pruned(column: np.ndarray, cut: np.ndarray, below: np.ndarray, weights: np.ndarray) -> tuple:
    """Sibling leaves of one prediction become one leaf; nodes are numbered anew, children behind their parent."""
    best = weights.argmax(axis=1)
    column, inner = column.copy(), np.flatnonzero(column >= 0)
    while len(inner):
        a = below[inner]
        same = (column[a] < 0) & (column[a + 1] < 0) & (best[a] == best[a + 1])
        if not same.any():
            break
        column[inner[same]] = -1
        inner = inner[~same]
    order, level = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
    while len(level):
        inner = level[column[level] >= 0]
        level = (below[inner].astype(np.int64)[:, None] + np.arange(2)).ravel()
        order.append(level)
    order = np.concatenate(order)
    number = np.zeros(len(column), np.int32)
    number[order] = np.arange(len(order))
    column = column[order]
    return column, cut[order], np.where(column >= 0, number[below[order]], 0).astype(np.int32), weights[order]


# ---- the top of trees ---------------------------------------------------------------------------------------------
class Top:
    """The nodes of a tree that are split by jobs, as lists; ``open`` ones are still to be split, ``units`` are grown by a task."""

    def __init__(self):
        self.column, self.cut, self.below, self.names, self.level = [-1], [0], [0], [1], [0]
        self.weights: list = [None]
        self.open: list[int] = []
        self.units: dict[int, float] = {}

    def settle(self, at: int, cells: float, weights: np.ndarray | None, depth: int) -> None:
        """A new node with about so many cells: a leaf, a unit or open."""
        if weights is not None and ((weights > 0).sum() < 2 or self.level[at] >= depth):
            return
        if cells > UNIT:
            self.open.append(at)
        else:
            self.units[at] = cells

    def split(self, at: int, column: int, cut: int, sides: np.ndarray, depth: int) -> None:
        """``sides``: weight of each class, rows and cells on the left and on the right."""
        self.column[at], self.cut[at], self.below[at] = column, cut, len(self.column)
        for k in range(2):
            self.column.append(-1), self.cut.append(0), self.below.append(0)
            self.names.append(2 * self.names[at] + k), self.level.append(self.level[at] + 1), self.weights.append(sides[k, :-2])
            self.settle(len(self.column) - 1, float(sides[k, -1]), sides[k, :-2], depth)

    def walk(self, cells: Cells, zero: np.ndarray, rows: int) -> np.ndarray:
        """The node of each row."""
        node = np.zeros(rows, np.int32)
        for at, column in enumerate(self.column):
            if column >= 0:
                inside = node == at
                some = slice(cells.column_at[column], cells.column_at[column + 1])
                right = np.full(rows, zero[column] > self.cut[at])
                right[cells.column_row[some]] = cells.column_bin[some] > self.cut[at]
                node[inside] = self.below[at] + right[inside]
        return node


def top_sums(blocks: RDD, tops: dict[int, Top], zero: np.ndarray, classes: int, m: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sums of each open node, place drawn and range; totals of each open node) by tree: weight of each class, rows and cells."""
    width, most = len(zero), classes + 2

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        whole = {t: np.zeros((len(top.open) * (m * BINS + 1), most)) for t, top in tops.items()}
        drawn = {t: drawn_columns(seed, t, np.array([top.names[a] for a in top.open]), width, m) for t, top in tops.items()}
        for place, *raw in part:
            offsets, indices, bins, label, weight = read(raw, width)
            cells = Cells(offsets, indices, bins, width)
            for t, top in tops.items():
                times = draws(seed, t, place, len(label))
                slot = np.full(len(top.column), -1, np.int32)
                slot[top.open] = np.arange(len(top.open))
                node = np.where(times * weight > 0, slot[top.walk(cells, zero, len(label))], -1)
                inside, (row, key) = np.flatnonzero(node >= 0), cells.of_nodes(node, drawn[t])
                keys, rows = np.r_[key, len(top.open) * m * BINS + node[inside]], np.r_[row, inside]
                own, heavy = label[rows], (times * weight)[rows]
                for c in range(most):
                    value = np.where(own == c, heavy, 0.0) if c < classes else np.ones(len(rows)) if c == classes else np.diff(offsets)[rows]
                    whole[t][:, c] += np.bincount(keys, value, len(whole[t]))
        yield np.concatenate([w.ravel() for w in whole.values()])

    made, out, first = blocks.mapPartitions(run).treeReduce(np.add), {}, 0
    for t, top in tops.items():
        size = len(top.open) * (m * BINS + 1)
        own = made[first : first + size * most].reshape(size, most)
        first += size * most
        out[t] = own[: len(top.open) * m * BINS], own[len(top.open) * m * BINS :]
    return out


def grow_tops(blocks: RDD, trees: int, cells: int, zero: np.ndarray, classes: int, m: int, depth: int, seed: int) -> list[Top]:
    """All trees down to their units."""
    tops = [Top() for _ in range(trees)]
    for top in tops:
        top.settle(0, cells * DRAWN, None, depth)
    while any(top.open for top in tops):
        some, numbers = {}, 0
        for t, top in enumerate(tops):  # as many trees as a job's sums have room for
            if top.open and (not some or numbers + len(top.open) * m * BINS * (classes + 2) <= SUMS):
                some[t] = top
                numbers += len(top.open) * m * BINS * (classes + 2)
        for t, (sums, totals) in top_sums(blocks, some, zero, classes, m, seed).items():
            top, filled = tops[t], np.flatnonzero(sums[:, classes] > 0)
            ats, top.open = top.open, []
            drawn = drawn_columns(seed, t, np.array([top.names[a] for a in ats]), len(zero), m)
            gain, place, cut = best_splits(filled, sums[filled, : classes + 1], totals[:, : classes + 1], drawn, zero, classes)
            for k, at in enumerate(ats):
                top.weights[at] = totals[k, :classes]
                if gain[k] <= 0 or (totals[k, :classes] > 0).sum() < 2 or top.level[at] >= depth:
                    continue
                own = sums[(k * m + place[k]) * BINS : (k * m + place[k] + 1) * BINS].copy()
                own[zero[drawn[k, place[k]]]] = totals[k] - own.sum(axis=0)
                sides = np.array([own[: cut[k] + 1].sum(axis=0), own[cut[k] + 1 :].sum(axis=0)])
                top.split(at, int(drawn[k, place[k]]), int(cut[k]), sides, depth)
    return tops


def dealt_units(tops: dict[int, Top], cells: float, cores: int) -> dict[tuple[int, int], int]:
    """The task of each unit. A task is sent each row that its units have once: the table at most, or ``HELD`` cells of a larger one."""
    units = [(t, at, n) for t, top in tops.items() for at, n in top.units.items()]
    share = sum(n for *_, n in units) / (2 * cores)
    share = share if cells <= HELD else min(share, HELD)
    task, tasks, held = {}, 0, 0.0
    for t, at, n in units:
        if held and held + n > share:
            tasks, held = tasks + 1, 0.0
        task[t, at], held = tasks, held + n
    return task


def grow_units(blocks: RDD, tops: dict[int, Top], cells: float, zero: np.ndarray, classes: int, m: int, depth: int, seed: int) -> dict[tuple[int, int], tuple]:
    """The subtrees of all units, by (tree, node)."""
    spark, width = SparkSession.active(), len(zero)
    task = dealt_units(tops, cells, spark.sparkContext.defaultParallelism)
    if not task:
        return {}

    def sent(block: tuple) -> Iterator[tuple]:
        place, *raw = block
        offsets, indices, bins, label, weight = read(raw, width)
        columns = Cells(offsets, indices, bins, width) if any(len(top.column) > 1 for top in tops.values()) else None
        n, wanted = np.diff(offsets), {}
        for t, top in tops.items():
            times = draws(seed, t, place, len(label))
            node = top.walk(columns, zero, len(label)) if len(top.column) > 1 else np.zeros(len(label), np.int32)
            for at in top.units:
                rows = np.flatnonzero((node == at) & (times * weight > 0))
                if len(rows):
                    wanted.setdefault(task[t, at], []).append((t, at, rows, times[rows]))
        for k, found in wanted.items():
            has = np.zeros(len(label), bool)
            for *_, rows, _ in found:
                has[rows] = True
            own, number = np.flatnonzero(has), np.cumsum(has) - 1
            some = places(offsets[own].astype(np.int64), n[own])
            parts = (np.r_[0, np.cumsum(n[own])], indices[some], bins[some], label[own], weight[own])
            units = [[t, at, len(rows)] for t, at, rows, _ in found]
            drawn = (units, np.concatenate([number[rows] for *_, rows, _ in found]), np.concatenate([times for *_, times in found]))
            yield k, place, *[p.astype(kind).tobytes() for p, kind in zip(parts, kinds(width))], *[np.asarray(x, np.int32).tobytes() for x in drawn]

    def grown(part: Iterator[tuple]) -> Iterator[tuple]:
        held, wanted = [], {}
        for _, place, *raw in sorted(part, key=lambda r: r[1]):
            units, rows, times = (np.frombuffer(x, np.int32) for x in raw[5:])
            held.append(read(raw[:5], width))
            first = 0
            for t, at, count in units.reshape(-1, 3).tolist():
                wanted.setdefault((t, at), []).append((len(held) - 1, rows[first : first + count], times[first : first + count]))
                first += count
        for (t, at), found in wanted.items():
            sizes, parts = [], []
            for k, rows, times in found:
                offsets, indices, bins, label, weight = held[k]
                sizes.append(np.diff(offsets)[rows])
                some = places(offsets[rows].astype(np.int64), sizes[-1])
                parts.append((indices[some], bins[some], label[rows], times * weight[rows]))
            indices, bins, label, weight = (np.concatenate(x) for x in zip(*parts))
            own = Cells(np.r_[0, np.cumsum(np.concatenate(sizes))], indices, bins, width)
            yield t, at, *[x.tobytes() for x in grow(own, label, weight, classes, zero, m, depth - tops[t].level[at], seed, t, tops[t].names[at])]

    schema = "task int, place long, offsets binary, indices binary, bins binary, label binary, weight binary, units binary, rows binary, times binary"
    rows = spark.createDataFrame(blocks.flatMap(sent), schema, verifySchema=False).repartitionById(max(task.values()) + 1, F.col("task"))
    out = {}
    for t, at, *raw in rows.rdd.map(tuple).mapPartitions(grown).collect():
        *nodes, weights = [np.frombuffer(x, kind) for x, kind in zip(raw, (np.int32, np.uint8, np.int32, np.float64))]
        out[t, at] = (*nodes, weights.reshape(-1, classes))
    return out


def joined(top: Top, subtrees: dict[int, tuple], classes: int) -> tuple:
    """One tree of its top and the subtrees of its units; the last of its arrays are the class shares."""
    column, cut, below = (np.array(x) for x in (top.column, top.cut, top.below))
    weights = np.array([np.ones(classes) if w is None else w for w in top.weights])  # a root that is a unit is replaced
    parts, count = [(column, cut, below, weights)], len(column)
    for at, (c, k, b, w) in subtrees.items():
        # the subtree's root takes the place of the unit, its other nodes come behind
        moved = b + count - 1
        column[at], cut[at], below[at], weights[at] = c[0], k[0], moved[0], w[0]
        parts.append((c[1:], k[1:], moved[1:], w[1:]))
        count += len(c) - 1
    whole = [np.concatenate(x) for x in zip(*parts)]
    *nodes, weights = pruned(whole[0].astype(np.int32), whole[1].astype(np.uint8), whole[2].astype(np.int32), whole[3])
    return *nodes, weights / weights.sum(axis=1, keepdims=True)


# ---- estimator -----------------------------------------------------------------------------------------------------
class _Settings(Params):
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "a column of row weights; empty for none", TypeConverters.toString)


class SparseForest(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fit on (label, features and, if ``weightCol`` names one, a weight). Columns are numbers or 0 and 1."""

    @keyword_only
    def __init__(self, *, classes: int = 2, numTrees: int = 20, maxDepth: int = 5, seed: int = 42, weightCol: str = ""):
        super().__init__()
        self._setDefault(classes=2, numTrees=20, maxDepth=5, seed=42, weightCol="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, data: DataFrame) -> SparseForestModel:
        classes, trees, depth, seed, name = (self.getOrDefault(p) for p in ("classes", "numTrees", "maxDepth", "seed", "weightCol"))
        label = F.col("label").cast("double")
        label = F.when(label.isin([float(k) for k in range(classes)]), label).otherwise(
            F.raise_error(F.lit(f"Labels MUST be whole numbers from 0 below {classes}, not null")).cast("double"))
        weight = F.col(name).cast("double") if name else F.lit(1.0)
        rows = sparse_rows(data, label.alias("label"), weight.alias("weight"))
        first = data.select(F.size(vector_to_array("features"))).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = first[0]
        n, total, cells = rows.agg(F.count("label"), F.sum("weight"), F.sum(F.size("values"))).first()
        attributes = data.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
        sample = (rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed)).toArrow()
        cuts = bounds(sample, width, [a["idx"] for a in attributes.get("binary", [])])
        zero = bins_of(cuts, np.arange(width), np.zeros(width)).astype(np.int64)
        m = width if trees == 1 else int(np.ceil(np.sqrt(width)))
        # sums run over all drawn columns of a tree's rows, which are drawn less than twice in all
        blocks = block_rows(rows, cuts, 52 - int(np.ceil(np.log2(2 * (m + 1) * max(total, 1))))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tops = grow_tops(blocks, trees, cells, zero, classes, m, depth, seed)
            grown, size = [], trees if cells <= HELD else max(1, int(SENT / (cells * DRAWN)))
            for first in range(0, trees, size):
                some = {t: tops[t] for t in range(first, min(trees, first + size))}
                subtrees = grow_units(blocks, some, cells, zero, classes, m, depth, seed)
                grown += [joined(top, {at: subtrees[t, at] for at in top.units if (t, at) in subtrees}, classes) for t, top in some.items()]
        finally:
            blocks.unpersist()
        return SparseForestModel(classes=classes)._with(cuts, grown)


class SparseForestModel(Model, _Settings, MLWritable, MLReadable):
    """Adds ``rawPrediction`` (sum of the trees' class shares), ``probability`` and ``prediction``."""

    @keyword_only
    def __init__(self, *, classes: int | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _with(self, cuts: np.ndarray, trees: list[tuple]) -> SparseForestModel:
        """Nodes of all trees in one numbering; a leaf has column -1 and names its class shares where others name their left child."""
        self.cuts, self.roots = cuts, np.cumsum([0, *[len(t[0]) for t in trees]])[:-1]
        leaf = np.concatenate([t[0] for t in trees]) < 0
        below = np.concatenate([t[2].astype(np.int64) + first for t, first in zip(trees, self.roots)])
        self.column, self.cut = np.concatenate([t[0] for t in trees]).astype(np.int32), np.concatenate([t[1] for t in trees]).astype(np.uint8)
        self.below = np.where(leaf, np.cumsum(leaf) - 1, below).astype(np.int32)
        self.shares = np.concatenate([t[3][t[0] < 0] for t in trees])
        return self

    def _transform(self, data: DataFrame) -> DataFrame:
        cuts, roots, column, cut, below, shares = self.cuts, self.roots, self.column, self.cut, self.below, self.shares
        width = len(cuts)
        zero = bins_of(cuts, np.arange(width), np.zeros(width))
        step = max(1, min(1024, (1 << 24) // max(1, width)))

        @F.arrow_udf("array<double>")
        def votes(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for indices, values in parts:
                table, out = Rows(pa.record_batch([indices, values], names=["indices", "values"])), [np.zeros((0, shares.shape[1]))]
                for first in range(0, len(table), step):
                    n = min(step, len(table) - first)
                    row, index, value = table.take(np.arange(first, first + n))
                    filled = np.tile(zero, (n, 1))
                    filled[row, index] = bins_of(cuts, index, value)
                    made = np.zeros((n, shares.shape[1]))
                    for root in roots:
                        at, going = np.full(n, root), np.arange(n)
                        while len(going := going[column[at[going]] >= 0]):
                            now = at[going]
                            at[going] = below[now] + (filled[going, column[now]] > cut[now])
                        made += shares[below[at]]
                    out.append(made)
                yield pa.array(list(np.concatenate(out)), pa.list_(pa.float64()))

        made = data.withColumn("__votes", votes(*entries()))
        total = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v)
        best = F.array_position("__votes", F.array_max("__votes")) - 1
        return made.withColumn("__total", total).withColumns({
            "rawPrediction": array_to_vector("__votes"),
            "probability": array_to_vector(F.transform("__votes", lambda v: v / F.col("__total"))),
            "prediction": best.cast("double"),
        }).drop("__votes", "__total")

    def write(self) -> DefaultParamsWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _ForestReader(cls)


#: The arrays of a model, and the bytes of one row of them on disk.
ARRAYS, ROW_BYTES = ("cuts", "roots", "column", "cut", "below", "shares"), 1 << 20


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        parts = []
        for name in ARRAYS:
            array = getattr(self.instance, name)
            raw = array.tobytes()
            parts += [(name, array.dtype.str, list(array.shape), k, raw[at : at + ROW_BYTES]) for k, at in enumerate(range(0, max(len(raw), 1), ROW_BYTES))]
        table = self.sparkSession.createDataFrame(parts, "name string, kind string, shape array<long>, number int, bytes binary")
        table.write.mode("overwrite").parquet(f"{path}/data")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> SparseForestModel:
        model, found = super().load(path), {}
        for r in self.sparkSession.read.parquet(f"{path}/data").orderBy("name", "number").collect():
            kind, shape, raw = found.setdefault(r["name"], (r["kind"], r["shape"], []))
            raw.append(bytes(r["bytes"]))
        for name, (kind, shape, raw) in found.items():
            setattr(model, name, np.frombuffer(b"".join(raw), kind).reshape(shape))
        return model
