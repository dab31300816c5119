"""Near copies by SimHash codes of word shingles, vantage-point trees and exact Jaccard similarity.

Sets of hashed shingles whose similarity is at least ``SIMILAR`` are linked.
Each set gets a SimHash code of ``LANES`` x 64 bits; of two sets at ``SIMILAR``
a share of at most ``SHARE`` of the bits differ.  At that share no bands of all
bits agree for certain, so the shards are tables of bits chosen at random: as
many that two sets at ``SIMILAR`` share no shard with probability ``MISS``,
closer ones less.  The bits of a table grow with the number of sets, so that a
shard holds ``SHARD_ROWS`` in the mean; up to that number all are one shard.

Within a shard a vantage-point tree splits the sets by their distance to a
vantage point and prunes through the triangle bounds.  Vantage points are the
empty set, whose distance to a set is the set's size (similar sets differ in
size by a fourth at most), and codes by Hamming distance.  A split is taken
where it spares comparisons.  What the codes propose, exact sets decide.

No group is squared: equal sets are one node; each set is first compared
exactly with its least neighbour and its nearest one by the codes, then with
those of other components, and only what is still apart, but within ``REACH``
by the codes, is then compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import groups, runtime
from .components import connected
from .groups import blocked, grouped
from .simhash import wide_codes
from .words import Words, grams, not_blank

SHINGLE, SIMILAR = 5, 0.8
#: 64-bit lanes of a code; the share of bits in which sets at ``SIMILAR`` differ at most (their angle by pi, rounded up; sets of up to five
#: shingles differ in more), and the deviations allowed beyond it (a pair at ``SIMILAR`` is beyond with probability 1e-6).
LANES, SHARE, SMALL_SHARE, SMALL, DEVIATIONS = 32, 0.16, 0.19, 5, 4.75

_TABLE = not_blank()
#: Lanes that all sets take to their shards; only sets with a neighbour by these take whole codes.
NARROW = 4
#: Mean rows of a shard at most, the probability that a pair at ``SIMILAR`` shares none.
SHARD_ROWS, MISS = 4096, 1e-6
#: Rows of a tree's leaf; the share of comparisons that a split has to spare.
LEAF, SPARED = 256, 0.05
#: Places of a code's bits as the tables take them: each once, then all again in other orders.
_PLACES = np.concatenate([np.random.default_rng(k).permutation(64 * LANES) for k in range(8)])


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Of each text the sorted different hashes of its shingles; one of fewer words is a single shingle, one without words has none."""
    words = Words(texts, _TABLE)
    h = words.hashes()
    runs = grams(h, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)] if b > a else [], np.uint64))
    return out


def node(one: np.ndarray) -> int:
    """The number of a set, the same for equal ones."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).view(np.int64))


def tables(n: int) -> tuple[int, int, int]:
    """Bits of a table for ``n`` sets, the number of tables, and that for sets of at most ``SMALL`` + 1 shingles."""
    bits = max(0, ceil(log2(max(n, 1) / SHARD_ROWS)))
    if not bits:
        return 0, 1, 1
    return bits, *(ceil(log(MISS) / log(1 - (1 - share) ** bits)) for share in (SHARE, SMALL_SHARE))


def table_keys(codes: np.ndarray, bits: int, number: int) -> np.ndarray:
    """A row of ``number`` shards for each code, one of each table."""
    each = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
    out = np.zeros((len(codes), number), np.int64)
    for t in range(number):
        for place in np.take(_PLACES, range(t * bits, (t + 1) * bits), mode="wrap"):
            out[:, t] = out[:, t] << 1 | each[:, place]
        out[:, t] += t << bits
    return out


def reach(share: float, bits: int = 64 * LANES) -> int:
    """Bits in which two codes may differ."""
    return int(bits * share + DEVIATIONS * (bits * share * (1 - share)) ** 0.5)


REACH, SMALL_REACH = reach(SHARE), reach(SMALL_SHARE)


def _texts(part: pa.RecordBatch, column: int) -> list[bytes | None]:
    return [None if x is None else x.encode() for x in part.column(column).to_pylist()]


def _prints(rows: DataFrame) -> DataFrame:
    """doc_id, the node of its set, the set's size and code (null without words)."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(_texts(part, 1))
            codes = iter(wide_codes([s for s in sets if len(s)], LANES).astype("<u8"))
            return pa.record_batch([part.column(0), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(codes).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "node", "size", "code"])

        return run

    return runtime.materialize(runtime.map_slices(rows, "text", runtime.added(rows.select("doc_id").schema, "node long, size long, code binary"), make), "shingle-codes")


def _sets(nodes: DataFrame, rows: DataFrame, firsts: DataFrame, column: str, kind: str, values, arrow: pa.DataType) -> DataFrame:
    """(node, ``column``): ``values`` of the shingle sets of ``nodes``, from a text of each."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in shingle_sets(_texts(part, 1)) if len(s)]
            return pa.record_batch([pa.array([node(s) for s in sets], pa.int64()), pa.array(values(sets), arrow)], names=["node", column])

        return run

    wanted = firsts.join(nodes, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    made = runtime.map_slices(rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), "text", runtime.added(T.StructType(), f"node long, {column} {kind}"), make)
    return runtime.materialize(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), f"node-{column}")


def _similar(pairs: DataFrame, rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    nodes = runtime.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "proposed-nodes")
    sets = _sets(nodes, rows, firsts, "shingles", "array<long>", lambda sets: [s.view(np.int64) for s in sets], pa.list_(pa.int64()))
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return runtime.materialize(both.where(shared >= F.lit(SIMILAR) * (total - shared)).select("a", "b"), "similar-pairs")


def _dealt(lanes: int, bits: int, number: int, small: int):
    """Rows (node, root, size, code) in each of their shards, with ``lanes`` lanes of their codes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                codes = part.column(3).to_pylist()
                keys = table_keys(np.frombuffer(b"".join(codes), "<u8").reshape(-1, LANES), bits, small)
                few = part.column(2).to_numpy() <= SMALL + 1
                row, table = np.nonzero(few[:, None] | (np.arange(small) < number)[None, :])
                cut = pa.array([x[: 8 * lanes] for x in codes], pa.binary())
                yield pa.record_batch([pa.array(keys[row, table]), *(part.column(c).take(pa.array(row)) for c in range(3)), cut.take(pa.array(row))], names=["key", "node", "root", "size", "code"])

    return run


def _hamming(lanes: list[np.ndarray], point: int, rows: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(lane[rows] ^ lane[point]).astype(np.int64) for lane in lanes)


def _split(lanes: list[np.ndarray], size: np.ndarray, homes: np.ndarray, queries: np.ndarray, far: int, same: bool):
    """(distances of homes, of queries, radius, bound inside, bound outside) that spare most comparisons, or None."""

    def cost(own, others):
        return own * (others + own / 2) if same else own * others

    best, least = None, (1 - SPARED) * cost(len(homes), len(queries))
    points = np.unique(homes[np.linspace(0, len(homes) - 1, 3).astype(int)])
    for point in (None, *points.tolist()):
        d, q = (size[homes], size[queries]) if point is None else (_hamming(lanes, point, homes), _hamming(lanes, point, queries))
        x, y = np.sort(d), np.sort(q)
        for r in np.unique(x[np.linspace(0, len(x) - 1, 9).astype(int)[:-1]]).tolist():
            above, below = (5 * r // 4, 4 * r // 5) if point is None else (r + far, r - far)
            inside = int(np.searchsorted(x, r, "right"))
            near = int(np.searchsorted(x, above, "right")) - inside if same else 0
            both = cost(inside, near + int(np.searchsorted(y, above, "right"))) + cost(len(x) - inside, len(y) - int(np.searchsorted(y, below, "right")))
            if both < least:
                best, least = (d, q, r, above, below), both
    return best


def leaves(lanes: list[np.ndarray], size: np.ndarray, homes: np.ndarray, queries: np.ndarray, far: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(homes, rows to compare them with) of a vantage-point tree's leaves, in which each pair of homes (with ``same``) and each of
    a home and a query meets whose codes differ in at most ``far`` bits and whose sizes allow ``SIMILAR``."""
    if len(homes) > LEAF and (found := _split(lanes, size, homes, queries, far, same)) is not None:
        d, q, radius, above, below = found
        near = homes[(d > radius) & (d <= above)] if same else homes[:0]
        yield from leaves(lanes, size, homes[d <= radius], np.concatenate((queries[q <= above], near)), far, same)
        yield from leaves(lanes, size, homes[d > radius], queries[q > below], far, same)
        return
    for a in range(0, len(homes), LEAF):
        yield homes[a : a + LEAF], np.concatenate((homes[a:], queries)) if same else queries


def near(code: np.ndarray, size: np.ndarray, root: np.ndarray, homes: np.ndarray, queries: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distance of the pairs of different roots that are within reach by their codes."""
    lanes = [np.ascontiguousarray(code[:, k]) for k in range(code.shape[1])]
    few = size <= SMALL
    first, last = ((reach(SHARE, 64 * n), reach(SMALL_SHARE, 64 * n)) for n in (NARROW, len(lanes)))
    for own, others in leaves(lanes, size, homes, queries, last[1] if few.any() else last[0], same):
        for b in range(0, len(others), 2048):
            rest = others[b : b + 2048]
            apart = np.zeros((len(own), len(rest)), np.uint16)
            for lane in lanes[:NARROW]:
                apart += np.bitwise_count(lane[own][:, None] ^ lane[rest][None, :])
            i, j = np.nonzero(apart <= (first[1] if few.any() else first[0]))
            for c in range(0, len(i), 1 << 16):
                p, q, d = own[i[c : c + (1 << 16)]], rest[j[c : c + (1 << 16)]], apart[i[c : c + (1 << 16)], j[c : c + (1 << 16)]].astype(np.int64)
                some = (root[p] != root[q]) & (5 * size[p] >= 4 * size[q]) & (5 * size[q] >= 4 * size[p])
                some &= d <= np.where(few[p] | few[q], first[1], first[0])
                p, q, d = p[some], q[some], d[some]
                for lane in lanes[NARROW:]:
                    d += np.bitwise_count(lane[p] ^ lane[q])
                some = d <= np.where(few[p] | few[q], last[1], last[0])
                if some.any():
                    yield p[some], q[some], d[some]


def _sides(t: pa.Table, lanes: int):
    """Arrays of a group (key, i, j): code, size, root and node of each row, homes and queries of its tree, whether pairs of homes count."""
    code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u8").reshape(t.num_rows, lanes)
    size, root, ids, side = (t.column(c).to_numpy() for c in ("size", "root", "node", "side"))
    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    every = np.arange(t.num_rows)
    return code, size, root, ids, every if same else np.flatnonzero(side == 0), every[:0] if same else np.flatnonzero(side == 1), same


def _neighbours(lanes: int):
    """Of groups (key, i, j): each row's nearest by the codes and that of the least root, among rows of other roots within reach."""

    def run(batches):
        for t in grouped(batches, 3):
            code, size, root, ids, homes, queries, same = _sides(t, lanes)
            order = np.lexsort((ids, root))
            rank = np.argsort(order)
            none = np.int64(1) << 62
            nearest, least = np.full(len(ids), none), np.full(len(ids), none)
            for p, q, d in near(code, size, root, homes, queries, same):
                for x, y in ((p, q), (q, p)):
                    np.minimum.at(nearest, x, d << 32 | rank[y])
                    np.minimum.at(least, x, rank[y])
            some = np.flatnonzero(nearest < none)
            if len(some):
                close, low = order[nearest[some] & 0xFFFFFFFF], order[least[some]]
                yield pa.record_batch([pa.array(ids[some]), pa.array(nearest[some] >> 32), pa.array(ids[close]), pa.array(root[low]), pa.array(ids[low])], names=["node", "apart", "close", "root", "low"])

    return run


def _all_pairs(bits: int, small: int):
    """Of groups (key, i, j): all pairs of different roots within reach by whole codes, each in the first table that it shares."""

    def run(batches):
        for t in grouped(batches, 3):
            code, size, root, ids, homes, queries, same = _sides(t, LANES)
            keys = table_keys(code, bits, small)
            table = t.column("key")[0].as_py() >> bits
            for p, q, _ in near(code, size, root, homes, queries, same):
                some = (keys[p] == keys[q]).argmax(1) == table
                if some.any():
                    p, q = ids[p[some]], ids[q[some]]
                    yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return run


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with an id: doc_id, component_id (the least id of its component).

    A null or empty text has no shingles; all such are one component.  Rows of
    one id may be in several components.  Texts of any length are read whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    prints = _prints(rows)
    firsts = runtime.materialize(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("code").alias("code")), "first-of-set")
    sets = firsts.where("size > 0").select("node", F.col("node").alias("root"), "size", "code")
    bits, number, small = tables(sets.count())
    order = ["key", "i", "j"]

    def met(some: DataFrame, lanes: int, search, kind: str) -> DataFrame:
        dealt = some.mapInArrow(_dealt(lanes, bits, number, small), "key long, node long, root long, size long, code binary")
        shards = blocked(dealt, "key", "node", "hot-shards", most=2 * groups.BLOCK).select(*order, "side", "node", "root", "size", "code")
        return shards.repartition(runtime.partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(search, kind)

    links = tried = spark.createDataFrame([], "a long, b long")
    for lanes in (NARROW, LANES):
        found = met(sets, lanes, _neighbours(lanes), "node long, apart long, close long, root long, low long")
        found = runtime.materialize(found.groupBy("node").agg(F.min(F.struct("apart", "close")).alias("x"), F.min(F.struct("root", "low")).alias("y")), "neighbours")
        pairs = found.select("node", F.explode(F.array("x.close", "y.low")).alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = runtime.materialize(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        links, tried = links.union(_similar(pairs, rows, firsts)), tried.union(pairs)
        # a set without a neighbour of another root has none in the next round
        rooted = sets.drop("root").join(found.select("node"), "node", "left_semi").join(connected(links).withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
        sets = runtime.materialize(rooted.select("node", F.coalesce("root", "node").alias("root"), "size", "code"), "sets-apart")
    pairs = met(sets, LANES, _all_pairs(bits, small), "a long, b long").distinct()
    links = links.union(_similar(runtime.materialize(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs"), rows, firsts))
    hooked = connected(links).withColumnsRenamed({"u": "node", "v": "root"})
    part = runtime.materialize(firsts.join(hooked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "set-roots")
    named = part.join(part.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return prints.join(runtime.materialize(named, "set-components"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the rows of its least id stay; rows of null id stay."""
    gone = near_copies(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(runtime.materialize(gone, "near-copies"), F.col(doc_id) == F.col("__gone"), "left_anti")
