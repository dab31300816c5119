"""SimHash near-dedup with vantage-point trees.

Fingerprints that differ in at most ``RADIUS`` bits are linked.  In a single
tree over 64 bits a ball of radius 4 overlaps both sides of two thirds of all
splits, so a query would visit about N^0.75 leaves; the shards are therefore
first divided without loss: the 64 bits are cut into ``B`` bands, and two
fingerprints within 4 bits agree on some ``B - 4`` bands.  Each choice of bands
is a table; equal bands are a shard.  B grows with the number of fingerprints,
so a shard stays small.

Within a shard a vantage-point tree splits fingerprints by their Hamming
distance to a vantage point and prunes branches through the triangle bounds.
A shard of over ``HOT_ROWS`` rows (a dense group of near copies) is split over
tasks by the leaves of a tree built from a bounded sample: each fingerprint is
at home in one leaf, and copies of it query all leaves whose boundary its ball
overlaps.  A leaf that still has more is dealt in pairs of blocks, so the rows
of a search have a bound whatever the table's size.  All pairs found are exact;
a task returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .components import connected, spanning
from .groups import blocked
from .words import Words, mix, not_blank

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that the tree of hot shards is built from, its leaves' depth at most, homes of a leaf searched whole.
SAMPLE, DEPTH, LEAF = 1 << 14, 12, 512
#: Rows of a shard before it is split over tasks; mean rows of a shard that B is chosen for.
HOT_ROWS, SHARD_ROWS = 1 << 16, 64

_TABLE = not_blank()
#: For each byte, its bits in eight lanes of one byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def fingerprint_batch(texts: list[bytes | None]) -> np.ndarray:
    """SimHash of each text's word shingles, unsigned 64 bits."""
    words = Words(texts, _TABLE)
    raw = words.raw.copy()
    raw[words.end] = 0x20
    keep = _TABLE[raw]
    keep[words.end] = True
    place = np.cumsum(keep) - 1
    joined = raw[keep].tobytes()
    start, end = place[words.start], place[words.end]
    counts = np.diff(words.first)
    # a text of n words has n - 3 shingles, or one if it has 1 to 3 words
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.cumsum(n) - n
    first = np.arange(int(n.sum())) - np.repeat(at, n) + np.repeat(words.first[:-1], n)
    last = np.minimum(first + SHINGLE, np.repeat(words.first[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(words.n, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = majority(h, at[some], n[some])
    return out


def majority(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of ``n`` hashes (one at least) from place ``at`` on, the bits that over half of them have."""
    groups = -(-n // 255)
    owner = np.cumsum(groups) - groups
    begin = (np.arange(int(groups.sum())) - np.repeat(owner, groups)) * 255 + np.repeat(at, groups)
    sums = np.empty((len(n), 64), np.int64)
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], begin).view(np.uint8).reshape(-1, 8)
        sums[:, 8 * j : 8 * j + 8] = np.add.reduceat(lanes, owner, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def wide_codes(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """SimHash codes of ``lanes`` times 64 bits, a row for each set of hashes; none is empty."""
    out = np.zeros((len(sets), lanes), np.uint64)
    if sets:
        every, n = np.concatenate(sets), np.array([len(s) for s in sets])
        for k in range(lanes):
            out[:, k] = majority(mix(every + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), np.cumsum(n) - n, n)
    return out


@dataclass
class Node:
    """A split by distance to ``point``: up to ``radius`` inside, else outside; a leaf has a number instead."""

    point: int = 0
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1


def _split(fp: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """A vantage point whose distances spread most, of a few tried, its splitting radius, the distances."""
    best = None
    for k in np.linspace(0, len(fp) - 1, 5).astype(int):
        d = np.bitwise_count(fp ^ fp[k]).astype(np.int64)
        if best is None or d.var() > best[1].var():
            best = (int(fp[k]), d)
    point, d = best
    radius = int(np.median(d))
    if (d > radius).any():
        return point, radius, d
    radius = int(d.max()) - 1
    return (point, radius, d) if (d <= radius).any() else None


def build_tree(sample: np.ndarray, depth: int = DEPTH) -> tuple[Node, int]:
    """A vantage-point tree and the number of its leaves."""
    leaves = 0

    def grow(fp: np.ndarray, left: int) -> Node:
        nonlocal leaves
        if left and len(fp) > 1 and (s := _split(fp)) is not None:
            point, radius, d = s
            return Node(point, radius, grow(fp[d <= radius], left - 1), grow(fp[d > radius], left - 1))
        leaves += 1
        return Node(leaf=leaves - 1)

    return grow(sample, depth), leaves


def route(tree: Node, fp: np.ndarray, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``fp``, leaf, at home): the home leaf of each and the leaves it has to query so that each near pair meets once."""
    out: list[tuple[np.ndarray, int, bool]] = []

    def down(node: Node, homes: np.ndarray, queries: np.ndarray) -> None:
        if not len(homes) and not len(queries):
            return
        if node.leaf >= 0:
            out.extend(((homes, node.leaf, True), (queries, node.leaf, False)))
            return
        d = np.bitwise_count(fp[homes] ^ np.uint64(node.point)).astype(np.int64)
        q = np.bitwise_count(fp[queries] ^ np.uint64(node.point)).astype(np.int64)
        down(node.inside, homes[d <= node.radius], np.concatenate((queries[q <= node.radius + reach], homes[(d > node.radius) & (d <= node.radius + reach)])))
        down(node.outside, homes[d > node.radius], queries[q > node.radius - reach])

    none = np.zeros(0, np.int64)
    down(tree, np.arange(len(fp)), none)
    return np.concatenate([none, *(i for i, _, _ in out)]), np.concatenate([none, *(np.full(len(i), k) for i, k, _ in out)]), np.concatenate([none.astype(bool), *(np.full(len(i), h) for i, _, h in out)])


def near_pairs(fp: np.ndarray, homes: np.ndarray, queries: np.ndarray, reach: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within ``reach`` among homes, and between queries and homes."""
    if len(homes) > LEAF and (s := _split(fp[homes])) is not None:
        point, radius, d = s
        q = np.bitwise_count(fp[queries] ^ np.uint64(point)).astype(np.int64)
        near = homes[(d > radius) & (d <= radius + reach)]
        yield from near_pairs(fp, homes[d <= radius], np.concatenate((queries[q <= radius + reach], near)), reach)
        yield from near_pairs(fp, homes[d > radius], queries[q > radius - reach], reach)
        return
    for k in range(0, len(homes), LEAF):
        own = homes[k : k + LEAF]
        rest = np.concatenate((homes[k:], queries))
        for j in range(0, len(rest), 4096):
            a, b = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[rest[j : j + 4096]][None, :]) <= reach)
            a, b = own[a], rest[j + b]
            some = a != b
            if some.any():
                yield a[some], b[some]


def bands(n: int) -> int:
    """Least number of bands for which a shard of ``n`` fingerprints in all has few rows."""
    b = RADIUS + 1
    while b < 8 and n >> (64 * (b - RADIUS) // b) > SHARD_ROWS:
        b += 1
    return b


def masks(b: int) -> list[int]:
    """The bits that two near fingerprints may agree on, for each choice of bands."""
    edges = [64 * i // b for i in range(b + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(b)]
    out = [sum(one[i] for i in keep) for keep in combinations(range(b), b - RADIUS)]
    assert len(out) == comb(b, RADIUS)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, i, j, home, fp), sorted by the first three: a spanning forest of their links."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    us, vs, held = [], [], 0
    left: list[np.ndarray] | None = None

    def search(shard: np.ndarray, home: np.ndarray, fp: np.ndarray) -> None:
        nonlocal held, us, vs
        edge = np.concatenate(([0], np.flatnonzero(np.any(shard[:, 1:] != shard[:, :-1], axis=0)) + 1, [len(fp)]))
        sizes = np.diff(edge)
        for a, b in zip(edge[:-1][sizes > 1].tolist(), edge[1:][sizes > 1].tolist(), strict=True):
            own, at_home = fp[a:b], home[a:b]
            for i, j in near_pairs(own, np.flatnonzero(at_home), np.flatnonzero(~at_home)):
                us.append(own[i].view(np.int64))
                vs.append(own[j].view(np.int64))
                held += len(i)
                if held > 1 << 20:
                    u, v = spanning(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0

    for batch in batches:
        now = [np.stack([batch.column(c).to_numpy() for c in range(3)]), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy().view(np.uint64)]
        if left is not None:
            now = [np.concatenate((a, b), axis=-1) for a, b in zip(left, now, strict=True)]
        if not len(now[2]):
            continue
        whole = int(np.flatnonzero(np.any(now[0] != now[0][:, -1:], axis=0))[-1]) + 1 if np.any(now[0] != now[0][:, -1:]) else 0
        if whole:
            search(*(x[..., :whole] for x in now))
        left = [x[..., whole:] for x in now]
    if left is not None:
        search(*left)
    if us:
        u, v = spanning(np.concatenate(us), np.concatenate(vs))
        yield pa.record_batch([pa.array(u), pa.array(v)], schema=kind)


def link(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp`` that span all that differ in at most ``RADIUS`` bits."""
    spark = prints.sparkSession
    runtime.ship(spark)
    total = prints.count()
    tasks = runtime.partitions(spark)
    tables = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks(bands(total)))]
    keyed = prints.select("fp", F.explode(F.array(*tables)).alias("shard"))
    hot = runtime.materialize(keyed.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS), "hot-shards")
    columns = ["shard", "i", "j", "home", "fp"]
    whole = F.lit(0).cast("long")
    rows = keyed.select("shard", whole.alias("i"), whole.alias("j"), F.lit(True).alias("home"), "fp")
    if most := hot.agg(F.max("rows")).first()[0]:
        there = runtime.materialize(keyed.join(hot.select("shard"), "shard"), "hot-rows")
        sample = there.select("fp").distinct().orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
        depth = min(DEPTH, (4 * most // HOT_ROWS).bit_length())
        tree, _ = build_tree(np.array([r.fp for r in sample], np.int64).view(np.uint64), depth)

        def dealt(batches):
            for batch in batches:
                fp = batch.column(1).to_numpy().view(np.uint64)
                at, leaf, home = route(tree, fp)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(leaf.astype(np.int64)), pa.array(home), batch.column(1).take(pa.array(at))], names=["shard", "leaf", "home", "fp"])

        routed = there.select("shard", "fp").mapInArrow(dealt, "shard long, leaf long, home boolean, fp long")
        routed = runtime.materialize(routed.select(F.xxhash64("shard", "leaf").alias("shard"), "home", "fp"), "hot-leaves")
        rows = rows.join(hot.select("shard"), "shard", "left_anti").select(*columns).union(blocked(routed, "shard", "fp", "large-leaves", most=HOT_ROWS).select(*columns))
    return rows.repartition(tasks, "shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long), component_id.

    A null text has no words, like an empty one: fingerprint zero.  Copies share
    a fingerprint and are never paired.  A null id never names a component and
    keeps its row; a component of null ids alone has a null id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = fingerprint_batch([None if x is None else x.encode() for x in batch.column(1).to_pylist()])
            return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

        return run

    schema = runtime.added(rows.select("doc_id").schema, "fp long")
    prints = runtime.materialize(runtime.map_slices(rows, "text", schema, make), "fingerprints")
    firsts = runtime.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-of-fingerprint")
    hooked = connected(link(firsts.select("fp")))
    part = firsts.join(hooked.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    part = runtime.materialize(part, "fingerprint-roots")
    least = runtime.materialize(part.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = runtime.materialize(part.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the rows of its least id stay; rows of null id stay."""
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(runtime.materialize(gone, "near-copies"), F.col(doc_id) == F.col("__gone"), "left_anti")
