"""Gradient-boosted trees and forests over binned features.

Trees grow best first: a queue of leaves by gain, split until ``leaves`` leaves
exist, ``depth`` binding only where a leaf is that deep.  The histograms of a pass
are those of the children of all leaves that may still be split, so a tree takes
about as many passes as it has levels.  ``l1`` shrinks the gradient sums of gains
and leaf values.  A fit of many rounds gives the scores of all smaller round
counts on the way (``stages``).

Everything that decides (bin bounds, histograms, sums) is exchanged between the
row shards of ``lockstep``; row and column samples come from hashes, so the trees
are the same for any number of shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .lockstep import Joint

MOST_BINS = 255          # bins of a feature: a byte each
LEAST_GAIN = 1e-8
HISTOGRAM_CELLS = 8_000_000  # cells of the histograms in work at a time
JOINT_CELLS, ENTRIES = 64_000, 100_000  # cells and entries of rows in work at a time, if steps of several models are


@dataclass(frozen=True)
class Growth:
    """How a model grows.  ``loss``: logistic, squared, or forest (averaged
    trees on bootstrapped rows).  ``leaves`` 0 and ``depth`` below 0: no limit.
    ``patience``: rounds without a better validation loss before it stops;
    ``holdout``: share of the training rows that validates instead.
    ``split_columns``: share of columns a split may use, below 0 their square root."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = -1
    min_rows: int = 20
    min_hess: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    split_columns: float = 1.0
    loss: str = "logistic"
    patience: int = 0
    holdout: float = 0.0
    seed: int = 42


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(key: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key, fixed by key and salt (arrays of salts
    are broadcast against the keys)."""
    h = key.astype(np.uint64)
    for s in salt:
        s = s if isinstance(s, np.ndarray) else np.array([s & (1 << 64) - 1], np.uint64)
        h = _mix(h + (s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


class Rows:
    """Rows of a shard: sparse entries (row, column, value), key, weight, labels
    (rows x targets), and which rows train, validate and test (part 0, 1, 2)."""

    def __init__(self, table: pa.Table | None):
        n = table.num_rows if table is not None else 0
        self.n = n
        features = table.column("features") if n else None
        self.features = features  # in chunks, which may be mapped from a file
        self.width = max(map(_width, features.chunks)) if n else 0
        self.key = np.asarray(table.column("key")).view(np.uint64) if n else np.zeros(0, np.uint64)
        part = np.asarray(table.column("part")) if n else np.zeros(0, np.int64)
        self.train, self.valid, self.test = part == 0, part == 1, part == 2
        self.weight = np.asarray(table.column("weight")).astype(np.float64) if n else np.zeros(0)
        self.labels = np.asarray(table.column("labels").combine_chunks().flatten()).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _entries(_whole(self.features)) if self.n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    @property
    def row(self) -> np.ndarray:
        return self._flat[0]

    @property
    def column(self) -> np.ndarray:
        return self._flat[1]

    @property
    def value(self) -> np.ndarray:
        return self._flat[2]

    def blocks(self, width: int, size: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
        """(place, dense rows from there on), some rows at a time; the entries of
        all rows are not spread out for it."""
        for a in range(0, self.n, size):
            row, column, value = _entries(_whole(self.features.slice(a, size)))
            x = np.zeros((min(size, self.n - a), width))
            x[row, column] = value
            yield a, x

    def label(self, target: int) -> np.ndarray:
        return self.labels[:, target] if self.n else np.zeros(0)


def _whole(features: pa.ChunkedArray) -> pa.StructArray:
    return features.chunk(0) if features.num_chunks == 1 else features.combine_chunks()


def _lengths(features: pa.StructArray) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.list_value_length(features.field("values")), 0)).astype(np.int64)


def _width(features: pa.StructArray) -> int:
    size = np.asarray(pa.compute.fill_null(features.field("size"), 0))
    return int(max(size.max(initial=0), _lengths(features)[np.asarray(features.field("type")) == 1].max(initial=0)))


def _entries(features: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzero entries of vectors, sparse or dense, as (row, column, value)."""
    kind = np.asarray(features.field("type"))
    values, indices = features.field("values"), features.field("indices")
    length = _lengths(features)
    flat = np.asarray(values.flatten()).astype(np.float64)
    row = np.repeat(np.arange(len(kind)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    dense = kind[row] == 1
    column = place.copy()
    column[~dense] = np.asarray(indices.flatten())
    keep = flat != 0
    return row[keep], column[keep], flat[keep]


class Binned:
    """Rows with each entry's cell; the cells of a column lie side by side."""

    def __init__(self, rows: Rows, width: int, column: np.ndarray, value: np.ndarray):
        """``column``, ``value``: the distinct values of all columns, zero included, sorted."""
        self.rows = rows
        inner = column[1:] == column[:-1]
        self.bound_column, self.bound = column[1:][inner], ((value[1:] + value[:-1]) / 2)[inner]
        self.bins = np.bincount(self.bound_column, minlength=width) + 1
        self.start = np.cumsum(self.bins) - self.bins
        self.bound_start = self.start - np.arange(width)
        self.cells, self.width = int(self.bins.sum()), width
        self.zero = self.start + self._bin(np.arange(width), np.zeros(width))
        self.cell = self.start[rows.column] + self._bin(rows.column, rows.value)
        self.column_of = np.repeat(np.arange(width), self.bins)
        self.splits = self._inner()
        self.original = np.arange(width)
        self.narrowed_to = {}

    def _inner(self) -> np.ndarray:
        last = np.zeros(self.cells, bool)
        last[self.start + self.bins - 1] = True
        return ~last

    def narrowed(self, least: int) -> Generator[np.ndarray, list, Narrowed]:
        """The columns that some bound splits into two sides of ``least`` training
        rows: as leaves only get smaller, no other column can ever split."""
        if least in self.narrowed_to:
            return self.narrowed_to[least]
        train = self.rows.train
        counts = np.bincount(self.cell[train[self.rows.row]], minlength=self.cells).astype(np.float64)
        shards = yield np.append(counts, train.sum())
        if least in self.narrowed_to:  # another program was here meanwhile
            return self.narrowed_to[least]
        every = np.sum(shards, axis=0)
        hist, total = every[:-1], every[-1]
        hist[self.zero] += total - np.add.reduceat(hist, self.start)
        left = np.cumsum(hist)
        left -= np.concatenate([[0.0], left[self.start[1:] - 1]])[self.column_of]
        fine = (np.minimum(left, total - left) >= least) & self.splits
        keep = np.bincount(self.column_of[fine], minlength=self.width) > 0
        if not keep.any():
            keep[:1] = True  # a tree then has no split, as it should
        out = self.narrowed_to[least] = Narrowed(self, keep)
        return out

    def _bin(self, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many bounds of its column lie under each value."""
        bounds = self.bound_column + 1j * self.bound
        return np.searchsorted(bounds, column + 1j * value) - self.bound_start[column]


class Narrowed:
    """Some columns of binned rows, by their bounds.  A column has a cell without
    zero for each bound: a cell has the place of the bound between it and zero.  The
    sides of several cells come last, each from the outermost cell on, so that the
    rows of a split's side without zero are those of a few cells in a row.  Entries
    in the cell of zero are left out, as that side is what the others leave."""

    def __init__(self, data: Binned, keep: np.ndarray):
        self.rows, self.width, self.original = data.rows, int(keep.sum()), np.flatnonzero(keep)
        self.bins, under = data.bins[keep], (data.zero - data.start)[keep]  # under: bounds below zero
        number, own = np.cumsum(keep) - 1, keep[data.bound_column]
        column, bound = number[data.bound_column[own]], data.bound[own]
        self.cells = len(bound)
        first, at = np.cumsum(self.bins - 1) - (self.bins - 1), np.arange(self.cells)
        below = at - first[column] < under[column]
        side = column * 2 + ~below
        several = np.bincount(side, minlength=2 * self.width)[side] > 1
        stored = np.lexsort((np.where(below, at, -at), side, several))
        self.column, self.bound, self.below = column[stored], bound[stored], below[stored]
        self.place = np.argsort(stored)  # of the bounds of all columns in their order
        begins = np.append(True, side[stored][1:] != side[stored][:-1])[:self.cells]
        self.outer_from = np.maximum.accumulate(np.where(begins, at, 0)) if self.cells else at
        self.outer_to = at + 1
        self.long = self.cells - int(several.sum())
        mine = keep[data.rows.column] & (data.cell != data.zero[data.rows.column])
        column = data.rows.column[mine]
        row, off = data.rows.row[mine], data.cell[mine] - data.start[column]
        cell = self.place[first[number[column]] + off - (off > under[number[column]])]
        self.table = _beside(row, cell, self.rows.n, self.cells)
        self.listed, self.listed_from = _by_cell(row, cell, self.cells)
        trains = self.rows.train[row]
        self.trained, self.trained_from = _by_cell(row[trains], cell[trains], self.cells)

    def outer(self, hist: np.ndarray) -> None:
        """Turns the sums of cells (in the last axis) into those of the sides without zero, in place."""
        if self.long < self.cells:
            upto = np.zeros((*hist.shape[:-1], self.cells - self.long + 1))
            np.cumsum(hist[..., self.long:], axis=-1, out=upto[..., 1:])
            np.subtract(upto[..., 1:], upto.take(self.outer_from[self.long:] - self.long, axis=-1), out=hist[..., self.long:])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of every cell over all training rows."""
        out = np.zeros(self.cells)
        some = self.trained_from[1:] > self.trained_from[:-1]
        if some.any():
            out[some] = np.add.reduceat(x.take(self.trained), self.trained_from[:-1][some])
        return out


def _by_cell(row: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each cell, cell by cell, and where each cell begins."""
    return row[np.argsort(cell, kind="stable")].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=cells))])


def _beside(row: np.ndarray, cell: np.ndarray, n: int, cells: int) -> np.ndarray:
    """(most entries of a row x rows): the cells of each row's entries, filled up with ``cells``."""
    count = np.bincount(row, minlength=n)
    out = np.full((max(1, int(count.max(initial=0))), n), cells, np.int32)
    out[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), row] = cell
    return out


def _thin(column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (column, value), evenly thinned to MOST_BINS a column."""
    pairs = np.unique(column + 1j * value)
    column, value = pairs.real.astype(np.int64), pairs.imag
    count = np.bincount(column)
    if count.max(initial=0) <= MOST_BINS:
        return column, value
    first = np.cumsum(count) - count
    keep = np.ones(len(column), bool)
    for c in np.flatnonzero(count > MOST_BINS).tolist():
        keep[first[c]:first[c] + count[c]] = False
        keep[first[c] + np.unique(np.linspace(0, count[c] - 1, MOST_BINS).astype(np.int64))] = True
    return column[keep], value[keep]


def binned(rows: Rows) -> Generator[np.ndarray, list, Binned]:
    """Bins from the values of the training rows of all shards."""
    width = int(max(x[0] for x in (yield np.array([rows.width]))))
    trains = rows.train[rows.row]
    column, value = _thin(rows.column[trains], rows.value[trains])
    shards = yield np.stack([column.astype(np.float64), value])
    column = np.concatenate([*[s[0] for s in shards], np.arange(width)]).astype(np.int64)
    value = np.concatenate([*[s[1] for s in shards], np.zeros(width)])
    return Binned(rows, width, *_thin(column, value))


class Tree:
    """Nodes: column (-1: leaf), bound (up to it: left), children, value."""

    def __init__(self):
        self.column, self.bound, self.left, self.right, self.value = [], [], [], [], []

    def add(self) -> int:
        for field, empty in ((self.column, -1), (self.bound, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            field.append(empty)
        return len(self.column) - 1

    def pruned(self, used: list[int]) -> dict:
        """The nodes in use, numbered anew in their order."""
        at = np.array(used)
        number = np.zeros(len(self.column), np.int64)
        number[at] = np.arange(len(at))
        return {"feature": np.array(self.column)[at].tolist(), "bound": np.array(self.bound)[at].tolist(),
                "left": [int(number[x]) if x >= 0 else -1 for x in np.array(self.left)[at]], "right": [int(number[x]) if x >= 0 else -1 for x in np.array(self.right)[at]],
                "value": np.array(self.value)[at].tolist()}


def _gains(g, h, l1, l2):
    g = np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g
    return g * g / (h + l2 + 1e-300)


class Sums(Joint):
    """Sums of cells and totals (3 x nodes x (cells, total)) of the rows of some nodes;
    None: of all training rows."""

    def __init__(self, data: Narrowed, inside: list[np.ndarray | None], g: np.ndarray, h: np.ndarray, c: np.ndarray, plain: bool):
        self.key = ("sums", id(data), plain, inside[0] is None)
        self.data, self.inside, self.of, self.plain = data, inside, (g, h, c), plain

    @staticmethod
    def run(steps: list[Sums]) -> list[np.ndarray]:
        if steps[0].inside[0] is None:
            return [np.stack([np.append(s.data.sums(x), x.sum()) for x in s.of])[:, None] for s in steps]
        out = []
        for some in _bounded(steps, lambda s: (len(s.inside), sum(map(len, s.inside)) * len(s.data.table))):
            data, plain = some[0].data, some[0].plain
            cells, most = data.cells, len(data.table)
            of = [np.concatenate(s.inside) if len(s.inside) > 1 else s.inside[0] for s in some]
            size = [len(x) for s in some for x in s.inside]
            m, inside = len(size), np.concatenate(of) if len(of) > 1 else of[0]
            slot = np.repeat(np.arange(m), size)
            place = data.table.take(inside, axis=1).astype(np.intp)
            if m > 1:
                place += slot * (cells + 1)
            place = place.ravel()
            own = np.empty((3, m, cells + 1))
            for i in range(3):
                x = np.concatenate([s.of[i].take(x) for s, x in zip(some, of, strict=True)])
                own[i] = np.bincount(place, None if i == 2 and plain else np.broadcast_to(x, (most, len(x))).ravel(), m * (cells + 1)).reshape(m, cells + 1)
                own[i, :, -1] = np.bincount(slot, x, m)
            ends = np.cumsum([len(s.inside) for s in some]).tolist()
            out += [own[:, b - len(s.inside):b] for s, b in zip(some, ends, strict=True)]
        return out


class Splits(Joint):
    """Best splits of some nodes.  ``shards``: the sums of all row shards; ``after``:
    for each node with a sibling its parent's histogram and total, which give the
    sibling's; ``seen``: which nodes, siblings last, are looked at."""

    def __init__(self, data: Narrowed, p: Growth, salt: int, shards: list, after: list, seen: list[bool], paths: list[int], open_columns: np.ndarray | None):
        self.key = ("splits", id(data), p.l1, p.l2, p.min_rows, p.min_hess, p.split_columns)
        self.data, self.p, self.salt, self.shards, self.after, self.seen, self.paths, self.open_columns = data, p, salt, shards, after, seen, paths, open_columns

    @staticmethod
    def run(steps: list[Splits]) -> list[Found]:
        return [x for some in _bounded(steps, lambda s: (sum(s.seen), 0)) for x in Splits._run(some)]

    @staticmethod
    def _run(some: list[Splits]) -> list[Found]:
        data, p = some[0].data, some[0].p
        k = sum(sum(s.seen) for s in some)
        hist, tot, totals, looked = np.empty((3, k, data.cells)), np.empty((3, k)), [], []
        every = [np.sum(s.shards, axis=0) if len(s.shards) > 1 else s.shards[0] for s in some]
        every = np.concatenate(every, axis=1) if len(every) > 1 else every[0]
        data.outer(every[:, :, :-1])
        at = read = 0
        for s in some:
            sums = every[:, read:read + len(s.after)]
            own, read = sums[:, :, :-1], read + len(s.after)
            total = [sums[:, i, -1] for i in range(len(s.after))]
            held = [(i, x) for i, x in enumerate(s.after) if x is not None]  # whose siblings come after all nodes that were read
            total += [x[1] - total[i] for i, x in held]
            begin = at
            for i, seen in enumerate(s.seen):
                if seen:
                    if i < len(s.after):
                        hist[:, at] = own[:, i]
                    else:
                        np.subtract(held[i - len(s.after)][1][0], own[:, held[i - len(s.after)][0]], out=hist[:, at])
                    tot[:, at] = total[i]
                    at += 1
            totals.append(total)
            looked.append(range(begin, at))
        gain, cell, left = Splits._judge(some, looked, data, p, hist, tot)
        return [Found(total, gain[mine.start:mine.stop], cell[mine.start:mine.stop], left[mine.start:mine.stop], hist, mine, len(some) > 1)
                for total, mine in zip(totals, looked, strict=True)]

    @staticmethod
    def _judge(some: list[Splits], looked: list[range], data: Narrowed, p: Growth, hist: np.ndarray, tot: np.ndarray) -> tuple[list, list, list]:
        cells, m = data.cells, hist.shape[1]
        least = max(p.min_rows - 1e-9, 1e-300)
        fine = hist[2] >= least
        fine &= hist[2] <= tot[2][:, None] - least
        for s, mine in zip(some, looked, strict=True):
            if s.open_columns is not None and mine:
                fine[mine.start:mine.stop] &= s.open_columns[data.column]
            if p.split_columns < 1 and mine:
                paths = [x for x, seen in zip(s.paths, s.seen, strict=True) if seen]
                many = max(1, int(data.width ** 0.5 if p.split_columns < 0 else p.split_columns * data.width))
                draw = uniform(data.original, s.p.seed, s.salt, np.array([x & (1 << 64) - 1 for x in paths], np.uint64)[:, None], 2)
                draw[:, data.bins < 2] = 2.0
                drawn = np.zeros((len(paths), data.width), bool)
                np.put_along_axis(drawn, np.argsort(draw, axis=1, kind="stable")[:, :many], True, axis=1)
                fine[mine.start:mine.stop] &= drawn[:, data.column]
        place = np.flatnonzero(fine.take(data.place, axis=1))  # most bounds leave too few rows: gains of the others only
        node = place // max(cells, 1)
        place += data.place.take(place - node * cells) - (place - node * cells)
        outer = hist.reshape(3, -1).take(place, axis=1)
        every = tot.take(node, axis=1)
        inner = every - outer
        gain = _gains(outer[0], outer[1], p.l1, p.l2)
        gain += _gains(inner[0], inner[1], p.l1, p.l2)
        gain -= _gains(tot[0], tot[1], p.l1, p.l2).take(node)
        gain = np.round(gain, 8)  # rounded: the order of summing must not decide
        gain[np.minimum(outer[1], inner[1]) < p.min_hess] = -1.0
        best, cell, sums = [-1.0] * m, [0] * m, [None] * m
        ends = np.searchsorted(node, np.arange(m + 1)).tolist()
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                top = a + int(gain[a:b].argmax())
                best[i], cell[i] = gain.item(top), place.item(top) - i * cells
                sums[i] = (outer if data.below.item(cell[i]) else inner)[:, top].copy()
        return best, cell, sums


class Found:
    """What ``Splits`` found: totals of all nodes; gain, cell and left sums of the best split of those looked at."""

    def __init__(self, total: list, gain: list, cell: list, left: list, hist: np.ndarray, place: range, shared: bool):
        self.total, self.gain, self.cell, self.left, self._hist, self._place, self.shared = total, gain, cell, left, hist, place, shared

    def histogram(self, i: int) -> np.ndarray:
        own = self._hist[:, self._place[i]]
        return own.copy() if self.shared else own  # a view would hold the histograms of all


def _bounded(steps: list, size: Callable) -> Iterator[list]:
    """Steps a few at a time, so that what they work on stays in a CPU's cache."""
    some, nodes, entries = [], 0, 0
    for s in steps:
        n, e = size(s)
        if some and ((nodes + n) * s.data.cells > JOINT_CELLS or entries + e > ENTRIES):
            yield some
            some, nodes, entries = [], 0, 0
        some.append(s)
        nodes, entries = nodes + n, entries + e
    if some:
        yield some


def grow(data: Narrowed, g: np.ndarray, h: np.ndarray, c: np.ndarray, p: Growth, salt: int, bound: set, joint: bool = False) -> Generator[np.ndarray | Joint, list, tuple[dict, np.ndarray]]:
    """One tree from gradients, hessians and counts of the rows (zero outside of
    the sample): its nodes, and what it adds to every row.  ``bound`` gets the
    limits (leaves, depth) without which it might have grown on."""
    rows, tree = data.rows, Tree()
    cells, table, most = data.cells, data.table, len(data.table)
    open_columns = None
    plain = bool((c <= 1).all())  # a row counts once: its cells need no weights
    used = c > 0
    if joint:  # of a row: the leaf it is in, by its label; of a leaf that was split off: its rows in the sample
        leaf, label, off = np.zeros(rows.n, np.int16), {0: 0}, {}
    else:  # of a node: its rows, those of the sample first
        members, sampled = {0: np.concatenate([np.flatnonzero(used), np.flatnonzero(~used)])}, {0: int(used.sum())}
    if p.column_share < 1:
        draw = uniform(data.original, p.seed, salt, 1)
        open_columns = np.zeros(data.width, bool)
        open_columns[np.argsort(draw, kind="stable")[:max(1, round(p.column_share * data.width))]] = True
    total, depth, best, path, held = {}, {0: 0}, {}, {0: 1}, {}
    mark, shared = np.zeros(rows.n, bool), False

    def inside(x: int) -> np.ndarray | None:
        if not joint:
            return members[x][:sampled[x]]
        if not x:
            return None
        return off.pop(x) if x in off else np.flatnonzero((leaf == label[x]) & used)

    def histograms(pairs: list[tuple[int, int | None, int | None]], look: set[int]) -> Generator:
        """Looks at the nodes of ``look`` among (node, sibling, parent).  Only the
        node's rows are read: its sibling has what its parent's histogram leaves."""
        nonlocal shared
        step = max(1, HISTOGRAM_CELLS // (6 * cells))
        keep = 2 * len(pairs) <= step  # else both of a pair are read, so that no histogram has to wait for its children
        for k in range(0, len(pairs), step):
            part = pairs[k:k + step]
            sums = Sums(data, [inside(x) for x, _, _ in part], g, h, c, plain)
            own = (yield sums) if joint else Sums.run([sums])[0]
            shards = yield own
            nodes = [x for x, _, _ in part] + [y for _, y, _ in part if y is not None]
            after = [(held[z], total[z]) if y is not None else None for _, y, z in part]
            seen = [x in look for x in nodes]
            splits = Splits(data, p, salt, shards, after, seen, [path[x] for x in nodes], open_columns)
            found = (yield splits) if joint else Splits.run([splits])[0]
            shared = found.shared and len(shards) == 1
            for x, tot in zip(nodes, found.total, strict=True):
                total[x] = tot
            for i, x in enumerate([x for x in nodes if x in look]):
                if found.gain[i] > LEAST_GAIN:
                    best[x] = (found.gain[i], found.cell[i], found.left[i])
                    if keep:
                        held[x] = found.histogram(i)

    def sides(parents: list[int]) -> tuple[list, list, list | np.ndarray]:
        """The rows that go left and right, and how many of the sample go left."""
        size = [len(members[x]) for x in parents]
        cuts = np.array([best[x][1] for x in parents])
        low, high, zeros = data.outer_from[cuts], data.outer_to[cuts], ~data.below[cuts]  # the cells of the side without zero, and whether zero is left
        begin, end = data.listed_from[low].tolist(), data.listed_from[high].tolist()
        if sum(end) - sum(begin) <= most * sum(size):  # few rows have these cells: they are marked, a parent at a time
            to_left, to_right, left_sampled = [], [], []
            for x, a, b, zero in zip(parents, begin, end, zeros.tolist(), strict=True):
                own, there = members[x], data.listed[a:b]
                mark[there] = True
                side = mark.take(own)
                mark[there] = False
                other = ~side
                if zero:
                    side, other = other, side
                to_left.append(own[side])
                to_right.append(own[other])
                left_sampled.append(int(np.count_nonzero(side[:sampled[x]])))
            return to_left, to_right, left_sampled
        moved = np.concatenate([members[x] for x in parents])
        slot = np.repeat(np.arange(len(parents)), size)
        off = table.take(moved, axis=1)
        off -= low.astype(np.int32)[slot]
        inside = off.view(np.uint32) < (high - low).astype(np.uint32)[slot]
        side = np.logical_or.reduce(inside, axis=0) != zeros[slot]
        counted = np.concatenate([np.arange(n) < sampled[x] for x, n in zip(parents, size, strict=True)]) & side
        lefts, left_sampled = np.bincount(slot[side], minlength=len(parents)), np.bincount(slot[counted], minlength=len(parents))
        return np.split(moved[side], np.cumsum(lefts)[:-1]), np.split(moved[~side], np.cumsum(np.array(size) - lefts)[:-1]), left_sampled

    def expand(parents: list[int]) -> Generator:
        """Children of ``parents``: rows move on, and what may be split is looked at."""
        if not joint:
            to_left, to_right, left_sampled = sides(parents)
        look, pairs = set(), []
        for i, x in enumerate(parents):
            a, b = children[x] = (tree.add(), tree.add())
            if joint:  # the rows without zero leave, those with it keep the label
                cut = best[x][1]
                there = data.listed[data.listed_from[data.outer_from[cut]]:data.listed_from[data.outer_to[cut]]]
                there = there[leaf.take(there) == label[x]]
                out, stay = (a, b) if data.below[cut] else (b, a)
                label[out], label[stay] = 1 + len(label) // 2, label[x]
                leaf[there] = label[out]
                off[out] = there[used.take(there)]
            else:
                members[a], members[b] = to_left[i], to_right[i]
                sampled[a] = int(left_sampled[i])
                sampled[b] = sampled[x] - sampled[a]
            total[a], total[b] = best[x][2], total[x] - best[x][2]
            own = []
            for k, y in enumerate((a, b)):
                depth[y], path[y] = depth[x] + 1, path[x] * 2 + k
                if total[y][2] >= 2 * p.min_rows - 1e-9 and total[y][2] > 1:
                    if p.depth < 0 or depth[y] < p.depth:
                        own.append(y)
                    else:
                        bound.add("depth")
            look.update(own)
            if x in held and own:
                pairs.append((a, b, x) if total[a][2] <= total[b][2] else (b, a, x))
            else:
                pairs += [(y, None, None) for y in own]
        if pairs:
            yield from histograms(pairs, look)
        for x in parents:
            held.pop(x, None)

    tree.add()
    yield from histograms([(0, None, None)], {0})
    children, applied, leaves = {}, [0], 1
    queue = [(-best[0][0], 0)] if 0 in best and p.depth != 0 else []
    if p.depth == 0:
        bound.add("depth")
    while queue and (not p.leaves or leaves < p.leaves):
        _, x = heapq.heappop(queue)
        if x not in children:
            left = (p.leaves - leaves if p.leaves else len(queue) + 1)
            # a pass costs more than a split that is not used in the end, unless other models share the pass
            ahead = left > 1 and not (p.leaves and shared)
            also = heapq.nsmallest(left - 1, ((k, y) for k, y in queue if y not in children)) if ahead else []
            yield from expand([x, *[y for _, y in also]])
        a, b = children[x]
        tree.column[x], tree.bound[x], tree.left[x], tree.right[x] = data.original.item(data.column.item(best[x][1])), data.bound.item(best[x][1]), a, b
        if not joint:
            del members[x]  # its children have them
        applied += [a, b]
        leaves += 1
        for y in (a, b):
            if y in best:
                heapq.heappush(queue, (-best[y][0], y))
    if queue:
        bound.add("leaves")
    step, said = np.zeros(rows.n), np.zeros(1 + (len(label) // 2 if joint else 0))
    for x in applied:
        gs, hs = total[x][0], total[x][1]
        gs = np.sign(gs) * max(abs(gs) - p.l1, 0.0)
        tree.value[x] = float(-gs / (hs + p.l2 + 1e-300) * p.rate)
        if p.loss == "forest":  # shares that are added up and held against a half: see above
            tree.value[x] = round(tree.value[x], 12)
        if tree.left[x] < 0 and joint:
            under = [x]  # also the children that were made ahead and not used
            for y in under:
                under += children.get(y, ())
                said[label[y]] = tree.value[x]
        elif tree.left[x] < 0:
            step[members[x]] = tree.value[x]
    return tree.pruned(applied), said.take(leaf) if joint else step


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def loss_of(loss: str, y: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, score) - y * score if loss == "logistic" else (y - score) ** 2 / 2


def fit(data: Binned, target: int, p: Growth, stages: tuple[int, ...] = (), keep: bool = True, joint: bool = False) -> Generator[np.ndarray | Joint, list, dict]:
    """One model: {base, trees, stages, bound}, where stages has (rounds, sum of the
    measure, rows) over the test rows: right answers, or absolute errors.
    ``joint``: histograms and splits are yielded as steps that models share."""
    rows = data.rows
    data = yield from data.narrowed(1 if p.loss == "forest" else max(p.min_rows, 1))
    y, n = rows.label(target), rows.n
    held = rows.train & (uniform(rows.key, p.seed, 5) < p.holdout) if p.holdout else np.zeros(n, bool)
    train, valid = rows.train & ~held, rows.valid | held
    w = np.where(train, rows.weight, 0.0)
    sums = np.sum((yield np.array([np.dot(w, y), w.sum()])), axis=0)
    mean = sums[0] / sums[1] if sums[1] else 0.0
    if p.loss == "logistic":
        mean = min(max(mean, 1e-12), 1 - 1e-12)
        base = float(np.log(mean / (1 - mean)))
    else:
        base = 0.0 if p.loss == "forest" else float(mean)
    score = np.full(n, base)
    trees, scored, lowest, since, at, bound = [], [], np.inf, 0, 0, set()
    seen = sorted(set(stages))

    def measure() -> np.ndarray:
        s, t = score[rows.test], y[rows.test]
        if p.loss == "squared":
            return np.array([np.abs(t - s).sum(), len(t)])
        middle = 0.5 * len(trees) if p.loss == "forest" else 0.0
        return np.array([((s > middle) == (t > 0.5)).sum(), len(t)], float)

    for r in range(p.rounds):
        c = train.astype(np.float64)
        if p.loss == "forest":  # a bootstrap sample: Poisson(1) copies of each row
            c *= np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720.0])), uniform(rows.key, p.seed, r, 3))
            g, h = -y * w * c, w * c
        else:
            if p.row_share < 1:
                c *= uniform(rows.key, p.seed, r, 3) < p.row_share
            q = sigmoid(score) if p.loss == "logistic" else score
            g = (q - y) * w * c
            h = (q * (1 - q) if p.loss == "logistic" else 1.0) * w * c
        tree, step = yield from grow(data, g, h, c, p, r, bound, joint)
        trees.append(tree)
        score = score + step
        while at < len(seen) and seen[at] == r + 1:
            scored.append(measure())
            at += 1
        if p.patience:
            v = np.sum((yield np.array([loss_of(p.loss, y[valid], score[valid]).sum(), valid.sum()])), axis=0)
            now = v[0] / v[1] if v[1] else 0.0
            lowest, since = (now, 0) if now < lowest - 1e-7 else (lowest, since + 1)
            if since >= p.patience:
                break
        if len(tree["feature"]) == 1 and p.loss != "forest" and p.row_share >= 1 and p.column_share >= 1:
            break  # no split is left, and no later round can find one
    scored += [measure()] * (len(seen) - at)
    if seen:
        scored = np.sum((yield np.array(scored)), axis=0).tolist()
    return {"base": base, "trees": trees if keep else [], "bound": bound, "stages": [(s, *m) for s, m in zip(seen, scored, strict=True)] if seen else []}


def fit_family(data: Binned, target: int, hows: dict[object, Growth], stages: tuple[int, ...] = (), keep: bool = True, joint: bool = False) -> Generator[np.ndarray | Joint, list, dict]:
    """Models (name -> result) that differ in their limits of leaves and depth
    only, the tightest first: a looser limit gives the model of a tighter one that
    never bound, so it is not fitted again."""
    def tightness(name):
        return (hows[name].leaves or np.inf, hows[name].depth if hows[name].depth >= 0 else np.inf)

    out = {}
    for name in sorted(hows, key=tightness):
        for other, got in out.items():
            if all(a <= b and (a == b or limit not in got["bound"]) for a, b, limit in zip(tightness(other), tightness(name), ("leaves", "depth"), strict=True)):
                out[name] = got
                break
        else:
            out[name] = yield from fit(data, target, hows[name], stages, keep, joint)
    return out


class Scorer:
    """Scores dense rows (rows x columns) by a fitted model's trees, laid out
    side by side: all trees of a row walk at once, a level a step."""

    def __init__(self, base: float, trees: list[dict], loss: str):
        self.base, self.loss, self.n = base, loss, len(trees)
        size = np.array([len(t["feature"]) for t in trees], np.int64)
        self.root = np.cumsum(size) - size
        shift = np.repeat(self.root, size)

        def flat(name, kind):
            return np.concatenate([np.asarray(t[name], kind) for t in trees]) if trees else np.zeros(0, kind)

        self.feature, self.bound, self.value = flat("feature", np.int32), flat("bound", np.float64), flat("value", np.float64)
        self.left, self.right = flat("left", np.int64) + shift, flat("right", np.int64) + shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a in range(0, len(x) if self.n else 0, 1024):
            part = x[a:a + 1024]
            node = np.broadcast_to(self.root, (len(part), self.n)).copy()
            while True:
                f = self.feature[node]
                i, j = np.nonzero(f >= 0)
                if not len(i):
                    break
                at = node[i, j]
                node[i, j] = np.where(part[i, f[i, j]] <= self.bound[at], self.left[at], self.right[at])
            out[a:a + 1024] += self.value[node].sum(1)
        return out / max(self.n, 1) if self.loss == "forest" else out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class, or the predicted value."""
        raw = self.raw(x)
        return sigmoid(raw) if self.loss == "logistic" else raw
