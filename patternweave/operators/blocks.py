"""Wedges, triangles and squares inside blocks of the graph, without a row for each wedge.

Vertices have colours, ranges of ids of about equal sums of degrees.  The block
of two colours holds the lists of neighbours of these colours, so that all
wedges whose ends have them, and the edges between them, meet in one task's
numpy arrays.  A list goes to the blocks of its own colours only: where
neighbours have near ids it is sent once or twice, never more often than there
are colours or neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertex import ID_MASK

#: Sums of degrees: a colour's at most (a vertex of more stands alone), and the least worth a colour of its own.
MOST, LEAST = 6_000_000, 100_000
#: Neighbours that a task deals out at a time, wedges it looks at, and neighbours in a row that is sent.
DEALT, WEDGES, SENT = 1_500_000, 2_000_000, 400_000
#: Ranges of ids whose degrees are summed.
RANGES = 8192


@dataclass(frozen=True)
class Colours:
    """``first[i] + hash % parts[i]`` is the colour of an id in range i; ranges are of ``1 << shift`` ids."""

    shift: int
    first: np.ndarray
    parts: np.ndarray
    number: int
    ends: int

    @classmethod
    def of(cls, degrees: DataFrame) -> Colours:
        top = degrees.agg(F.max("v"), F.sum("deg")).first()
        largest, ends = int(top[0] or 0), int(top[1] or 0)
        shift = max(0, largest.bit_length() - (RANGES.bit_length() - 1))
        sums = np.zeros((largest >> shift) + 1, np.int64)
        for i, n in degrees.groupBy(F.shiftright("v", shift).alias("i")).agg(F.sum("deg")).collect():
            sums[i] = n
        return cls.cut(shift, sums, ends, min(MOST, max(LEAST, ends // 8)))

    @classmethod
    def cut(cls, shift: int, sums: np.ndarray, ends: int, most: int) -> Colours:
        first, parts = np.zeros(len(sums), np.int64), np.ones(len(sums), np.int64)
        at, held = 0, 0
        for i, n in enumerate(sums.tolist()):
            if held and held + n > most:
                at, held = at + 1, 0
            first[i], parts[i] = at, max(1, -(-n // most))
            if parts[i] > 1:
                at, held = at + int(parts[i]), 0
            else:
                held += n
        return cls(shift, first, parts, at + 1, ends)

    def __call__(self, packed: np.ndarray) -> np.ndarray:
        ids = packed & ID_MASK
        i = ids >> self.shift
        parts = self.parts[i]
        if (parts == 1).all():
            return self.first[i]
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[i] + mixed.astype(np.int64) % parts


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for all j in ``starts[i] .. starts[i] + counts[i] - 1``."""
    left = np.repeat(np.arange(len(counts)), counts)
    right = np.arange(len(left)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return left, right


def cuts(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices whose counts sum to ``most`` at most (or of a single element)."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def _deal(colours: Colours, batches: Iterator[pa.RecordBatch], valued: bool) -> Iterator[pa.RecordBatch]:
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    z, n, t = (np.concatenate([b.column(c).to_numpy() for b in read]) if c < 2 or valued else None for c in range(3))
    order = np.lexsort((n, z))
    z, n, p = z[order], n[order], colours.number
    t = t[order] if valued else None
    new = np.r_[True, z[1:] != z[:-1]]
    at = np.cumsum(new) - 1
    own = colours(n)
    # the colours met at each vertex, and its own, whose block holds its edges
    met = np.unique(np.r_[at * p + own, np.arange(at[-1] + 1) * p + colours(z[new])])
    starts = np.searchsorted(met // p, np.arange(at[-1] + 2))
    lo, count = starts[at], np.diff(starts)[at]
    for a, b in cuts(count, 4 * DEALT):
        i, j = ranges(lo[a:b], count[a:b])
        i += a
        other = met[j] % p
        task = np.minimum(own[i], other) * p + np.maximum(own[i], other)
        order = np.argsort(task, kind="stable")
        i, task = i[order], task[order]
        bounds = np.r_[np.flatnonzero(np.r_[True, task[1:] != task[:-1]]), len(task)]
        bounds = np.unique(np.concatenate([np.r_[np.arange(s, e, SENT), e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lists = [pa.array([c[i[s:e]]]) for c in (z, n, *([t] if valued else []))]
            yield pa.RecordBatch.from_arrays([pa.array([task[s]], pa.int64()), *lists], names=["task", "z", "n", "t"][: 2 + len(lists) - 1])


class Block:
    """One task's lists: ``v`` the vertices ascending, (z, n) the entries as places in ``v``, sorted, ``t`` their values."""

    def __init__(self, z: np.ndarray, n: np.ndarray, t: np.ndarray | None = None, colours: Colours | None = None, task: int = 0):
        self.v = np.unique(np.concatenate([np.unique(z), np.unique(n)]))
        self.size = len(self.v)
        self.z, self.n = np.searchsorted(self.v, z), np.searchsorted(self.v, n)
        key = self.z * self.size + self.n
        order = np.argsort(key)
        self.key, self.z, self.n = key[order], self.z[order], self.n[order]
        self.t = None if t is None else t[order]
        self.colour, self.pair = (colours(self.v), divmod(task, colours.number)) if colours else (np.zeros(self.size, np.int64), (0, 0))

    @classmethod
    def of(cls, colours: Colours, task: int, table: pa.Table) -> Block:
        flat = lambda c: np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in table.column(c).chunks])
        return cls(flat("z"), flat("n"), flat("t") if "t" in table.column_names else None, colours, task)

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries that may be the lesser and the greater end of a wedge, as places."""
        own, (a, b) = self.colour[self.n], self.pair
        if a == b:
            every = np.arange(len(self.n))
            yield every, every
        else:
            one, other = np.flatnonzero(own == a), np.flatnonzero(own == b)
            yield from ((one, other), (other, one))

    def wedges(self, top: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(l, r): entries of one z with n[l] < n[r], all with equal ends at once; ``top``: n[r] > z."""
        for lesser, greater in self.sides():
            if top:
                greater = greater[self.n[greater] > self.z[greater]]
            greater = greater[np.argsort(self.n[greater], kind="stable")]
            keys = self.key[lesser]
            yield from self._between(lesser, keys, greater, 0, self.size)

    def _between(self, lesser: np.ndarray, keys: np.ndarray, greater: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The wedges whose lesser end is in ``low .. high - 1``; ``greater`` is sorted by n."""
        z, y = self.z[greater] * self.size, self.n[greater]
        starts = np.searchsorted(keys, z + low)
        counts = np.searchsorted(keys, z + np.minimum(y, high)) - starts
        counts = np.maximum(counts, 0)
        keep = np.flatnonzero(counts)
        greater, starts, counts = greater[keep], starts[keep], counts[keep]
        first = np.flatnonzero(np.r_[True, np.diff(self.n[greater]) != 0]) if len(greater) else keep
        sums = np.add.reduceat(counts, first) if len(greater) else counts
        bounds = np.r_[first, len(greater)]
        for a, b in cuts(sums, WEDGES):
            at, to = bounds[a], bounds[b]
            if b == a + 1 and sums[a] > WEDGES and high - low > 1:
                mid = (low + high) // 2
                yield from self._between(lesser, keys, greater[at:to], low, mid)
                yield from self._between(lesser, keys, greater[at:to], mid, high)
            else:
                i, j = ranges(starts[at:to], counts[at:to])
                yield lesser[j], greater[at + i]

    def triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(z, x, y) ascending, as places."""
        a, b = self.pair
        cz, cn = self.colour[self.z], self.colour[self.n]
        closing = self.key[(np.minimum(cz, cn) == a) & (np.maximum(cz, cn) == b)]
        if not len(closing):
            return
        bits = max(16, min(27, int(len(closing)).bit_length() + 3))
        place = lambda k: ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        known = np.zeros(1 << bits, bool)
        known[place(closing)] = True
        for lesser, greater in self.wedges(top=True):
            key = self.n[lesser] * self.size + self.n[greater]
            may = np.flatnonzero(known[place(key)])
            key = key[may]
            hit = may[closing[np.minimum(np.searchsorted(closing, key), len(closing) - 1)] == key]
            if len(hit):
                yield self.z[lesser[hit]], self.n[lesser[hit]], self.n[greater[hit]]


def _met(g, ups: bool, values: DataFrame | None = None) -> tuple[Colours, DataFrame]:
    """(task, z, n): the lists of larger (``ups``) or all neighbours by block; ``values`` (x, y, n) of edges stand beside as t."""
    colours = g.colours
    if values is None:
        near = g.oriented.select(F.col("u").alias("z"), F.col("w").alias("n")) if ups else g.adjacent.select(F.col("v").alias("z"), "n")
    else:
        edges = g.oriented.toDF("x", "y").join(values.select("x", "y", F.col("n").alias("t")), ["x", "y"], "left").select("x", "y", F.coalesce("t", F.lit(0)).cast("long").alias("t"))
        near = edges.selectExpr("stack(2, x, y, t, y, x, t) as (z, n, t)")
    valued = values is not None
    kind = "task long, z array<long>, n array<long>" + ", t array<long>" * valued
    parts = max(8, -(-colours.ends // DEALT))
    dealt = near.repartition(parts, "z").mapInArrow(lambda batches: _deal(colours, batches, valued), kind)
    return colours, dealt.repartition(min(2000, colours.number * (colours.number + 1) // 2), "task")


def _each(g, ups: bool, rows, kind: str, values: DataFrame | None = None) -> DataFrame:
    """Rows of ``rows(block)``, a table or columns for each block."""
    colours, dealt = _met(g, ups, values)
    names = [c.split()[0] for c in kind.split(", ")]

    def made(key: tuple, table: pa.Table) -> pa.Table:
        found = rows(Block.of(colours, key[0].as_py(), table))
        return found if isinstance(found, pa.Table) else pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    return dealt.groupBy("task").applyInArrow(made, kind)


def triangles(g) -> DataFrame:
    """(v1, v2, v3), ascending."""

    def rows(b: Block) -> list[np.ndarray]:
        found = list(b.triangles())
        return [b.v[np.concatenate([f[c] for f in found])] if found else np.empty(0, np.int64) for c in range(3)]

    return _each(g, True, rows, "v1 long, v2 long, v3 long")


def apex_counts(g) -> DataFrame:
    """(x, y, n): triangles on each edge, added up in blocks first."""

    def rows(b: Block) -> list[np.ndarray]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            k, n = np.concatenate([keys, k]), np.concatenate([counts, n])
            once, at = np.unique(k, return_inverse=True)
            return once, np.bincount(at, n, len(once)).astype(np.int64)

        for z, x, y in b.triangles():
            waiting += [z * b.size + x, z * b.size + y, x * b.size + y]
            if sum(map(len, waiting)) > 4 * WEDGES:
                (keys, counts), waiting = added(), []
        keys, counts = added()
        return [b.v[keys // b.size], b.v[keys % b.size], counts]

    found = _each(g, True, rows, "x long, y long, n long")
    return found if g.colours.number == 1 else found.groupBy("x", "y").agg(F.sum("n").alias("n"))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, counts) of equal keys."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.empty(0, np.int64)
    return order, starts, np.diff(np.r_[starts, len(key)])


def squares_in(b: Block) -> int:
    """Squares of a block, or if edges have values the sum over squares of their sides' values.

    A square has two wedges on its greatest vertex and the one opposite; each of
    n wedges on the same ends is in n - 1 squares.
    """
    out = 0
    for l, r in b.wedges(top=True):
        x, y = b.n[l], b.n[r]
        low, span = int(y.min()), int(y.max() - y.min()) + 1
        weight = None if b.t is None else b.t[l] + b.t[r]
        if span * b.size <= 16 * len(y):
            key = (y - low) * b.size + x
            n = np.bincount(key, minlength=span * b.size)
            s = n if weight is None else np.bincount(key, weight, span * b.size).astype(np.int64)
        else:
            order, starts, n = _groups((y - low) * b.size + x)
            s = n if weight is None else np.add.reduceat(weight[order], starts)
        out += int(((n - 1) * s)[n > 1].sum())
    return out if b.t is not None else out // 2


def square_sums(g, values: DataFrame | None = None) -> DataFrame:
    """(k): by block the number of squares, or with ``values`` (x, y, n) of edges the sum over squares of their sides' values."""
    return _each(g, False, lambda b: [[squares_in(b)]], "k long", values)


def met_wedges(g) -> DataFrame:
    """(x, y, mids): all common neighbours of x < y, sorted, of pairs that have two or more."""

    def rows(b: Block) -> pa.Table:
        xs, ys, sizes, mids = ([np.empty(0, np.int64)] for _ in range(4))
        for l, r in b.wedges(top=False):
            order, starts, n = _groups(b.n[r] * b.size + b.n[l])
            keep = np.flatnonzero(n > 1)
            if not len(keep):
                continue
            first = order[starts[keep]]
            xs.append(b.v[b.n[l[first]]])
            ys.append(b.v[b.n[r[first]]])
            sizes.append(n[keep])
            z = b.z[l[order[ranges(starts[keep], n[keep])[1]]]]
            # ascending within each list
            of = np.repeat(np.arange(len(keep)), n[keep])
            mids.append(b.v[z[np.lexsort((z, of))]])
        offsets = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)
        return pa.table([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(mids)))], names=["x", "y", "mids"])

    return _each(g, False, rows, "x long, y long, mids array<long>")
