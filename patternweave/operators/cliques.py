"""Cliques: listing, counting, factorised and encoded forms, covers, maximal cliques."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertex import degree, vertex_id
from ..graph import Graph
from . import blocks


def cliques(g: Graph, k: int) -> DataFrame:
    """(v1 .. vk), ascending.

    The larger neighbours of v1 and the edges among them are the triangles that
    have v1 for their least vertex, so triangles are dealt once for any k.  In a
    task's arrays a clique grows by those that differ from it in the last vertex.
    """
    if k < 2:
        raise ValueError("a clique has 2 vertices at least")
    if k == 2:
        return g.oriented.select(F.col("u").alias("v1"), F.col("w").alias("v2"))
    if k == 3:
        return g.triangles
    names = [f"v{i}" for i in range(1, k + 1)]
    return by_least(g, lambda v, a, b: (pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names) for found in grown(v, a, b, k)), ", ".join(f"{n} long" for n in names))


def clique_counts(g: Graph, k: int) -> DataFrame:
    """(v, cnt): k-cliques by their least vertex; none is listed for k over 3."""
    if k < 4:
        return cliques(g, k).groupBy(F.col("v1").alias("v")).agg(F.count("*").alias("cnt"))

    def rows(v, a, b):
        once, at = np.unique(v, return_inverse=True)
        sums = np.zeros(len(once), np.int64)
        for found in grown(v, a, b, k):
            sums += np.bincount(np.searchsorted(once, found[0]), minlength=len(once))
        some = sums > 0
        yield pa.RecordBatch.from_arrays([pa.array(once[some]), pa.array(sums[some])], names=["v", "cnt"])

    return by_least(g, rows, "v long, cnt long")


def edges_of_4_cliques(g: Graph) -> DataFrame:
    """(x, y, k): the number of 4-cliques on each edge that is in any, added up in local graphs first."""

    def rows(v, a, b):
        ids = np.unique(np.concatenate([v, a, b]))
        keys = [np.empty(0, np.int64)]
        counts = [np.empty(0, np.int64)]
        for found in grown(v, a, b, 4):
            at = [np.searchsorted(ids, c) for c in found]
            once, n = np.unique(np.concatenate([at[i] * len(ids) + at[j] for i, j in combinations(range(4), 2)]), return_counts=True)
            keys.append(once)
            counts.append(n)
        once, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(once)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[once // len(ids)]), pa.array(ids[once % len(ids)]), pa.array(n)], names=["x", "y", "k"])

    return by_least(g, rows, "x long, y long, k long").groupBy("x", "y").agg(F.sum("k").alias("k"))


def cliques_compressed(g: Graph, k: int) -> DataFrame:
    """(v1 .. v(k-1), last): cliques that differ in the greatest vertex alone, as one row."""
    keys = [f"v{i}" for i in range(1, k)]
    return cliques(g, k).groupBy(*keys).agg(F.array_sort(F.collect_list(f"v{k}")).alias("last"))


# --- local graphs: one vertex's larger neighbours and the edges among them


def local_graphs(g: Graph) -> DataFrame:
    """(v, a, b): the edges among the larger neighbours of v.  The order by degree bounds a local graph's vertices."""
    return g.triangles.select(F.col("v1").alias("v"), F.col("v2").alias("a"), F.col("v3").alias("b"))


#: Edges of local graphs that a task takes at a time, and pairs of cliques.
TAKEN, PAIRS = 200_000, 1_000_000


def whole_groups(batches: Iterable[pa.RecordBatch], least: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that come sorted by the first, in runs of about ``least`` rows (0: ``TAKEN``) that cut no group."""
    held, size = [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate([h[c] for h in held]) for c in range(len(held[0]))]

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= (least or TAKEN):
            columns = joined()
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in columns)
            held, size = [[c[cut:] for c in columns]], size - cut
            if not cut:
                size = 0  # a group of more rows than a run; wait for as many again
    if held and sum(len(h[0]) for h in held):
        yield tuple(joined())


def by_least(g: Graph, rows: Callable[..., Iterable[pa.RecordBatch]], kind: str, edges: DataFrame | None = None) -> DataFrame:
    """``rows(v, a, b)`` of whole local graphs, many at a time, as arrays sorted by v, a, b."""
    local = local_graphs(g) if edges is None else edges
    parts = max(8, -(-g.colours.ends // blocks.DEALT))

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, a, b in whole_groups(batches):
            order = np.lexsort((b, a, v))
            yield from rows(v[order], a[order], b[order])

    return local.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(made, kind)


def each_least(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """A local graph's vertex and edges at a time."""
    bounds = np.r_[np.flatnonzero(np.r_[True, v[1:] != v[:-1]]), len(v)].tolist()
    a, b = a.tolist(), b.tolist()
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(v[s]), list(zip(a[s:e], b[s:e], strict=True))


def grown(v: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> Iterator[list[np.ndarray]]:
    """Columns of the k-cliques (k over 3) of local graphs sorted by v, a, b, some at a time."""
    ids, own = np.unique(np.concatenate([a, b])), np.unique(v)
    size = len(ids)
    la, lb, lv = np.searchsorted(ids, a), np.searchsorted(ids, b), np.searchsorted(own, v)
    # an edge of a local graph by its place among (v, a), then b
    new = np.r_[True, (lv[1:] != lv[:-1]) | (la[1:] != la[:-1])]
    group = np.cumsum(new) - 1
    starts = lv[new] * size + la[new]
    known = group * size + lb

    def grow(columns: list[np.ndarray], same: np.ndarray) -> Iterator[list[np.ndarray]]:
        """``same``: equal for cliques that differ in the last vertex alone, which stand together."""
        place = np.arange(len(same))
        after = np.searchsorted(same, same, "right") - 1 - place
        for at, to in blocks.cuts(after, PAIRS):
            i, j = blocks.ranges(place[at:to] + 1, after[at:to])
            i += at
            last, more = columns[-1][i], columns[-1][j]
            edge = columns[0][i] * size + last
            of = np.minimum(np.searchsorted(starts, edge), len(starts) - 1)
            key = of * size + more
            hit = np.flatnonzero((starts[of] == edge) & (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key))
            if not len(hit):
                continue
            found = [*[c[i[hit]] for c in columns], more[hit]]
            if len(found) == k:
                yield [own[found[0]], *[ids[c] for c in found[1:]]]
            else:
                yield from grow(found, i[hit])

    yield from grow([lv, la, lb], group)


def _near(edges: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def greedy_clique(near: dict[int, set[int]], among: set[int]) -> list[int]:
    """A clique grown from vertices of most neighbours first, the least of equals."""
    left, out = set(among), []
    while left:
        v = max(left, key=lambda x: (len(near[x] & left), -x))
        out.append(v)
        left &= near[v]
    return sorted(out)


def encode_cliques(near: dict[int, set[int]], size: int) -> tuple[list[int], list[tuple[list[int], list[int]]]]:
    """The cliques of ``size`` vertices of a local graph: a core, all whose subsets count, and (prefix, common) rows.

    A clique not inside the core is a prefix, with one vertex of the row's common list for its greatest.
    """
    core = greedy_clique(near, set(near))
    inside = set(core)
    rows: list[tuple[list[int], list[int]]] = []

    def grow(prefix: list[int], left: set[int], outside: bool) -> None:
        above = sorted(x for x in left if not prefix or x > prefix[-1])
        if len(prefix) == size - 1:
            common = above if outside else [x for x in above if x not in inside]
            if common:
                rows.append((list(prefix), common))
            return
        for v in above:
            grow([*prefix, v], left & near[v], outside or v not in inside)

    grow([], set(near), False)
    return core, rows


def cliques_encoded(g: Graph, k: int) -> DataFrame:
    """(v, k, core, partial): the k-cliques with least vertex v as an encoded set.

    Each subset of k - 1 vertices of ``core`` with v is a clique; ``partial``
    holds (prefix, common) rows for the others.
    """
    kind = "v long, k int, core array<long>, partial array<struct<prefix:array<long>,common:array<long>>>"

    def encode(v, a, b):
        made = [(u, k, *encode_cliques(_near(ties), k - 1)) for u, ties in each_least(v, a, b)]
        partial = [[{"prefix": p, "common": c} for p, c in rows] for *_, rows in made]
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([k] * len(made), pa.int32()), pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array(partial, pa.list_(pa.struct([("prefix", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])))], names=["v", "k", "core", "partial"])

    return by_least(g, encode, kind)


def encoded_counts(encoded: DataFrame, k: int) -> DataFrame:
    """(v, cnt) of encoded k-cliques: a binomial of the core and the lengths of common lists."""
    from ..functions.arrays import binomial

    inside = binomial(F.size("core"), k - 1)
    listed = F.aggregate("partial", F.lit(0).cast("long"), lambda n, p: n + F.size(p["common"]))
    return encoded.select("v", (inside + listed).alias("cnt")).where("cnt > 0")


def expand_encoded(encoded: DataFrame, k: int) -> DataFrame:
    """(v1 .. vk) of encoded cliques."""
    kind = ", ".join(f"v{i} long" for i in range(1, k + 1))

    def rows(batches):
        for pdf in batches:
            out = []
            for v, core, partial in zip(pdf["v"], pdf["core"], pdf["partial"], strict=True):
                out += [(v, *c) for c in combinations(core, k - 1)]
                out += [(v, *p["prefix"], x) for p in partial for x in p["common"]]
            yield pd.DataFrame(out, columns=[f"v{i}" for i in range(1, k + 1)], dtype="int64")

    return encoded.mapInPandas(rows, kind)


# --- covers and maximal cliques


def cover(near: dict[int, set[int]], least: int) -> list[list[int]]:
    """Disjoint cliques of at least ``least`` vertices, grown greedily from vertices of fewest neighbours."""
    left, out = set(near), []
    for v in sorted(near, key=lambda x: (len(near[x]), x)):
        if v not in left:
            continue
        found, near_left = [v], near[v] & left
        while near_left:
            w = min(near_left, key=lambda x: (-len(near[x] & near_left), x))
            found.append(w)
            near_left &= near[w]
        if len(found) >= least:
            out.append(sorted(found))
            left -= set(found)
    return out


def clique_cover(g: Graph, threshold: int) -> DataFrame:
    """(clique, member): disjoint cliques of at least ``threshold`` vertices.

    Each local graph is covered greedily, each vertex then takes the largest
    clique that it is in (the least id of equals), and cliques that keep
    ``threshold`` members stay.  A clique's id is unique, so two never merge.
    """

    def covered(v, a, b):
        rows = [(f"{u}:{k}", len(c) + 1, m) for u, ties in each_least(v, a, b) for k, c in enumerate(cover(_near(ties), threshold - 1)) for m in [u, *c]]
        yield pa.RecordBatch.from_pylist([{"clique": c, "size": n, "member": m} for c, n, m in rows], pa.schema([("clique", pa.string()), ("size", pa.int64()), ("member", pa.int64())]))

    dense = local_graphs(g).where((degree(F.col("v")) >= threshold - 1) & (degree(F.col("a")) >= threshold - 1) & (degree(F.col("b")) >= threshold - 1))
    found = by_least(g, covered, "clique string, size long, member long", dense)
    chosen = found.groupBy("member").agg(F.min_by("clique", F.struct(-F.col("size"), "clique")).alias("clique"))
    kept = chosen.groupBy("clique").agg(F.count("*").alias("members"), F.collect_list("member").alias("all")).where(F.col("members") >= threshold)
    return kept.select(F.array_min("all").alias("clique"), F.explode("all").alias("member"))


def collapse(g: Graph, clique_members: DataFrame) -> DataFrame:
    """(p, q): distinct edges after each covered clique is one vertex, named by its least member."""
    of = clique_members.select(F.col("member"), F.col("clique"))
    edges = g.oriented.join(of.withColumnsRenamed({"member": "u", "clique": "cu"}), "u", "left").join(of.withColumnsRenamed({"member": "w", "clique": "cw"}), "w", "left")
    ends = edges.select(F.coalesce("cu", "u").alias("p"), F.coalesce("cw", "w").alias("q")).where("p <> q")
    return ends.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def bron_kerbosch(near: dict[int, set[int]], base: set[int], left: set[int], done: set[int]) -> Iterable[set[int]]:
    """Maximal cliques that hold ``base``, with a pivot."""
    if not left and not done:
        yield base
        return
    pivot = max(left | done, key=lambda x: (len(near.get(x, set()) & left), -x))
    for v in sorted(left - near.get(pivot, set())):
        own = near.get(v, set())
        yield from bron_kerbosch(near, base | {v}, left & own, done & own)
        left = left - {v}
        done = done | {v}


def maximal_cliques(g: Graph, least: int = 2) -> DataFrame:
    """(members): all maximal cliques of at least ``least`` vertices (2 or more), ascending ids.

    Each is found at its least vertex among the larger neighbours, whose number
    the order by degree bounds.  A smaller vertex shows that one isn't maximal
    if it makes a triangle with the least member and each other one: that is
    looked up by joins, so no group holds a hub's smaller neighbours.
    """

    def found(v, a, b):
        rows = []
        for u, ties in each_least(v, a, b):
            near = _near(t for t in ties if t[1] >= 0)
            rows += [sorted(c) for c in bron_kerbosch(near, {u}, {x for t in ties for x in t if x >= 0}, set()) if len(c) >= max(2, least)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["members"])

    # edges in no triangle are cliques of two, which only matter where these count
    larger = g.oriented.select(F.col("u").alias("v"), F.col("w").alias("a"), F.lit(-1).cast("long").alias("b"))
    made = by_least(g, found, "members array<long>", local_graphs(g) if least > 2 else larger.union(local_graphs(g)))
    pairs = made.select("members", F.col("members")[0].alias("v2"), F.explode(F.slice("members", 2, F.size("members") - 1)).alias("v3"))
    seen = pairs.join(g.triangles, ["v2", "v3"]).groupBy("members", "v1").agg(F.count("*").alias("ties")).where("ties = size(members) - 1")
    kept = made.join(seen.select("members").distinct(), "members", "left_anti")
    return kept.select(F.array_sort(F.transform("members", vertex_id)).alias("members"))


def largest_clique(g: Graph) -> DataFrame:
    """(members, size): the largest clique, the first of equals in the order of members."""
    found = maximal_cliques(g).select("members", F.size("members").cast("long").alias("size"))
    return found.agg(F.min_by("members", F.struct(-F.col("size"), "members")).alias("members"), F.max("size").alias("size"))


def disjoint_cliques(g: Graph, least: int) -> DataFrame:
    """(members): maximal cliques of at least ``least`` vertices that share none with a larger (or earlier) one.

    Rounds of local decisions: a clique stays if it comes first for each of its
    vertices.  Each round is a table in the shared folder, so plans don't grow.
    """
    from functools import reduce

    from ..sources.tables import materialize

    left = materialize(maximal_cliques(g, least).withColumn("rank", F.struct(-F.size("members"), "members")), "cliques-left")
    out = [left.select("members").limit(0)]
    while not left.isEmpty():
        spread = left.select("rank", "members", F.explode("members").alias("v"))
        first = spread.groupBy("v").agg(F.min("rank").alias("best"))
        stays = spread.join(first, "v").groupBy("rank", "members").agg(F.every(F.col("rank") == F.col("best")).alias("ok")).where("ok").select("members")
        out.append(materialize(stays, "cliques-kept"))
        used = out[-1].select(F.explode("members").alias("v"))
        gone = spread.join(used, "v", "left_semi").select("rank").distinct()
        left = materialize(left.join(gone, "rank", "left_anti"), "cliques-left")
    return reduce(DataFrame.union, out)


def compare_counts(g: Graph, k: int, over: int = 0) -> DataFrame:
    """(v, joined, encoded): the k-cliques by least vertex as joins and as encoded sets count them, where either has more than ``over``."""
    a = clique_counts(g, k).withColumnRenamed("cnt", "joined")
    b = encoded_counts(cliques_encoded(g, k), k).withColumnRenamed("cnt", "encoded")
    both = a.join(b, "v", "full").select("v", F.coalesce("joined", F.lit(0)).cast("long").alias("joined"), F.coalesce("encoded", F.lit(0)).cast("long").alias("encoded"))
    return both.where(F.greatest("joined", "encoded") > over)
