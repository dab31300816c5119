"""Embedding near-dedup by randomised-rotation binary codes.

Each unit vector is rotated by seeded random orthogonal matrices; the signs are
its code, and for each rotation the inner product of the rotated vector with
its own (normalised) signs is stored as a correction factor.  For a query
vector q, ``<code, Pq> / factor`` is an unbiased estimate of the inner product,
with a deviation of at most ``sqrt((1 - factor^2) / factor^2 / (d - 1))``;
averaged over the rotations it is an estimate with a confidence bound.

Codes meet in tables keyed by a few sign bits of further rotations.  The number
of bits follows the number of vectors (a bucket keeps its size) and the number
of tables is the least for which a pair at the threshold meets with probability
``1 - MISS``; pairs above it miss less.  Only codes, factors, key bits and
vectors in 8 bits travel there.  A pair goes on if the upper confidence bound of
its estimate reaches the threshold and then the bound that the rounding to 8
bits sets to its inner product does; each pair counts in the least table that
both share, so it goes on once.  Links and counts come from exact
double-precision cosines of full vectors alone.

Pairs go to that comparison one by one, but for those between two vectors that
both have over ``DENSE`` such pairs in one bucket: of them a task returns a
spanning forest, and the vectors of a component of forests are compared in
blocks.  A single pair within one such component is left to it.

Equal vectors are compared once and weighted.  Buckets over
``BUCKET_BLOCK`` rows and components over 64 are dealt in pairs of blocks to
several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .components import connected, spanning
from .groups import blocked, grouped

THRESHOLD = 0.95
#: Sign bits of a code at least; deviations of the confidence bound; chance to miss a pair at the threshold; rows of a bucket.
CODE_BITS, DEVIATIONS, MISS, BUCKET = 256, 4.5, 1e-6, 256
#: Pairs of a vector in a bucket beyond which it is compared in blocks.
DENSE = 16
#: Rows of a bucket that a task holds the pairs of.
BUCKET_BLOCK = 2048


def rotations(d: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices of order ``d``."""
    r = np.random.default_rng(seed + 7919 * d)
    out = []
    for _ in range(count):
        q, s = np.linalg.qr(r.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(s)))
    return np.stack(out)


def code_rotations(d: int) -> np.ndarray:
    return rotations(d, -(-CODE_BITS // d), 1)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors (n, d): signs (n, rotations, d) and correction factors (n, rotations)."""
    y = np.einsum("rij,nj->nri", code_rotations(x.shape[1]), x)
    return y > 0, np.abs(y).sum(2) / math.sqrt(x.shape[1])


def estimate(signs: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors with query vectors, and nothing exact."""
    n, r, d = signs.shape
    weight = (np.where(signs, 1.0, -1.0) / (math.sqrt(d) * r * factors[:, :, None])).reshape(n, r * d).astype(np.float32)
    turned = np.einsum("rij,nj->nri", code_rotations(d), queries).reshape(len(queries), r * d).astype(np.float32)
    return weight @ turned.T


def deviation(factors: np.ndarray, d: int) -> np.ndarray:
    """Standard deviation bound of the averaged estimate of each coded vector."""
    f = np.clip(factors, 1e-6, 1.0)
    return np.sqrt(((1 - f * f) / (f * f)).mean(1) / max(d - 1, 1) / f.shape[1])


def table_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = max(1, round(math.log2(max(n, 1) / BUCKET))) if n > 2 * BUCKET else 0
    if not bits:
        return 0, 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each vector and table, from sign bits of rotations of their own."""
    d = x.shape[1]
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    turned = rotations(d, -(-bits * tables // d), 2).reshape(-1, d)[: bits * tables]
    signs = (x @ turned.T > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2) | np.arange(tables, dtype=np.int64) << 32


def _unit(batch: pa.RecordBatch, k: int, d: int) -> np.ndarray:
    x = batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounding(scale: np.ndarray, d: int) -> np.ndarray:
    """Length at most of the difference between a unit vector and its 8-bit form."""
    return 0.5 * scale * math.sqrt(d) + 1e-6


def _near(signs: np.ndarray, factors: np.ndarray, query: np.ndarray, scale: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (of left, of right) of pairs whose upper bounds both reach the threshold."""
    d = query.shape[1]
    # the rounding of a query to 8 bits shifts an estimate by no more than this
    slack = DEVIATIONS * deviation(factors, d) + scale.max() * 0.5 * math.sqrt(d) / factors.min()
    off = rounding(scale, d).astype(np.float32)
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(left), 512):
        for b in range(0, len(right), 4096):
            rows, cols = left[a : a + 512], right[b : b + 4096]
            got = estimate(signs[rows], factors[rows], query[cols]) + slack[rows, None] >= threshold
            some = np.flatnonzero(got.any(1))
            rows, got = rows[some], got[some]
            # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|
            inner = query[rows].astype(np.float32) @ query[cols].astype(np.float32).T
            got &= inner + off[rows, None] + (1 + off[rows, None]) * off[None, cols] + 1e-5 >= threshold
            p, q = np.nonzero(got)
            ps.append(rows[p])
            qs.append(cols[q])
    return np.concatenate(ps), np.concatenate(qs)


def _candidates(d: int, threshold: float, bits: int, tables: int):
    """Pairs (a, b, dense): single ones, and spanning forests of those between two vectors of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in grouped(batches, 3):
            n = t.num_rows
            if n < 2:
                continue
            ids, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            r = -(-CODE_BITS // d)
            signs = np.unpackbits(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, : r * d].reshape(n, r, d).astype(bool)
            factors = np.frombuffer(b"".join(t.column("factors").to_pylist()), "<f4").reshape(n, r).astype(np.float64)
            scale = t.column("scale").to_numpy()
            query = np.frombuffer(b"".join(t.column("query").to_pylist()), np.int8).reshape(n, d) * scale[:, None]
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            left = np.arange(n) if same else np.flatnonzero(side == 0)
            right = np.arange(n) if same else np.flatnonzero(side == 1)
            p, q = _near(signs, factors, query, scale, left, right, threshold)
            some = p < q if same else p != q
            p, q = p[some], q[some]
            table = t.column("bucket")[0].as_py() >> 32
            if table and len(p):
                key = np.unpackbits(np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, : tables * bits].reshape(n, tables, bits)[:, :table]
                key = (key.astype(np.int64) << np.arange(bits)).sum(2)
                before = np.zeros(len(p), bool)
                for k in range(table):
                    before |= key[p, k] == key[q, k]
                p, q = p[~before], q[~before]
            if not len(p):
                continue
            many = np.bincount(np.concatenate((p, q)), minlength=n) > DENSE
            dense = many[p] & many[q]
            us, vs = spanning(np.concatenate((us, ids[p[dense]])), np.concatenate((vs, ids[q[dense]])))
            yield pa.record_batch([pa.array(ids[p[~dense]]), pa.array(ids[q[~dense]]), pa.array(np.zeros(int((~dense).sum()), bool))], names=["a", "b", "dense"])
        yield pa.record_batch([pa.array(us), pa.array(vs), pa.array(np.ones(len(us), bool))], names=["a", "b", "dense"])

    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _single(d: int, threshold: float):
    """Of rows (a, b, wa, wb, ea, eb): for each end of a link the weight of the other (b = -1), and the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                hit = np.einsum("nd,nd->n", _unit(batch, 4, d), _unit(batch, 5, d)) >= threshold
                a, b, wa, wb = (batch.column(c).to_numpy()[hit] for c in range(4))
                none = np.full(len(a), -1)
                cols = (np.concatenate((a, b, a)), np.concatenate((none, none, b)), np.concatenate((wb, wa, np.zeros(len(a), np.int64))))
                yield pa.record_batch([pa.array(c) for c in cols], schema=_FOUND)

    return run


def _exact(d: int, threshold: float):
    """Within dense groups of full vectors: for each the weight of its links, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            t = t.combine_chunks()
            n = t.num_rows
            ids, weight, side = t.column("rep").to_numpy(), t.column("weight").to_numpy(), t.column("side").to_numpy()
            x = _unit(t.to_batches()[0], t.column_names.index("embedding"), d)
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            left = np.arange(n) if same else np.flatnonzero(side == 0)
            right = np.arange(n) if same else np.flatnonzero(side == 1)
            links = np.zeros(n, np.int64)
            u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, len(left), 1024):
                rows = left[a : a + 1024]
                for b in range(0, len(right), 2048):
                    cols = right[b : b + 2048]
                    hit = x[rows] @ x[cols].T >= threshold
                    hit &= ids[rows][:, None] != ids[cols][None, :]
                    links[rows] += hit @ weight[cols]
                    if not same:
                        links[cols] += hit.T @ weight[rows]
                    p, q = np.nonzero(hit)
                    u, v = spanning(np.concatenate((u, ids[rows[p]])), np.concatenate((v, ids[cols[q]])))
            some = links > 0
            yield pa.record_batch([pa.array(np.concatenate((ids[some], u))), pa.array(np.concatenate((np.full(int(some.sum()), -1), v))), pa.array(np.concatenate((links[some], np.zeros(len(u), np.int64))))], schema=_FOUND)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    A vector that is null, zero, empty, or holds null or non-finite components
    links with nothing, as do vectors of different lengths; each is a component
    of its own.  A row of null id counts as a vector but names no component: it
    is its own id there (null), and kept only if nothing else names it.
    Rows of equal id are vectors of their own.
    """
    spark = vectors.sparkSession
    runtime.ship(spark)
    tasks = runtime.partitions(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = runtime.materialize(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    kinds = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    # a number for each different vector, fixed by writing it
    reps = runtime.materialize(kinds.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    results = []
    for (d,) in reps.groupBy(F.size("embedding")).count().select("size(embedding)").orderBy("size(embedding)").collect():
        own = reps.where(F.size("embedding") == d)
        bits, tables = table_plan(own.count(), threshold)

        def codes(batches: Iterator[pa.RecordBatch], d=d, bits=bits, tables=tables) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, 1024):
                    batch = whole.slice(k, 1024)
                    x = _unit(batch, 1, d)
                    signs, factors = encode(x)
                    packed = np.packbits(signs.reshape(len(x), -1), axis=1)
                    scale = np.abs(x).max(1) / 127
                    query = np.rint(x / scale[:, None]).astype(np.int8)
                    key = _keys(x, bits, tables)
                    own_bits = np.packbits((key[:, :, None] >> np.arange(bits) & 1).reshape(len(x), -1).astype(np.uint8), axis=1)
                    many = np.repeat(np.arange(len(x)), key.shape[1])
                    blob = [pa.array([r.tobytes() for r in a], pa.binary()).take(pa.array(many)) for a in (packed, factors.astype("<f4"), query, own_bits)]
                    yield pa.record_batch([pa.array(key.ravel()), batch.column(0).take(pa.array(many)), *blob, pa.array(scale[many])], names=["bucket", "rep", "code", "factors", "query", "keys", "scale"])

        coded = own.select("rep", "embedding").repartition(tasks).mapInArrow(codes, "bucket long, rep long, code binary, factors binary, query binary, keys binary, scale double")
        order = ["bucket", "i", "j"]
        met = blocked(coded, "bucket", "rep", "hot-buckets", most=BUCKET_BLOCK).select(*order, "side", "rep", "code", "factors", "query", "keys", "scale")
        pairs = met.repartition(tasks, *order).sortWithinPartitions(*order).mapInArrow(_candidates(d, threshold, bits, tables), "a long, b long, dense boolean")
        pairs = runtime.materialize(pairs, "candidate-pairs")
        groups = connected(pairs.where("dense").select("a", "b"))
        named = groups.select(F.col("u").alias("member"), F.col("v").alias("group"))
        named = runtime.materialize(named.union(groups.select(F.col("v").alias("member"), F.col("v").alias("group")).distinct()), "dense-groups")
        full = runtime.materialize(own.join(named, F.col("rep") == F.col("member")).select("group", "rep", "weight", "embedding"), "dense-vectors")
        order = ["group", "i", "j"]
        met = blocked(full, "group", "rep", "hot-groups", least=64).select(*order, "side", "rep", "weight", "embedding")
        results.append(runtime.materialize(met.repartition(tasks, *order).sortWithinPartitions(*order).mapInArrow(_exact(d, threshold), "a long, b long, links long"), "exact-links"))
        single = pairs.where("not dense").select("a", "b")
        for end in ("a", "b"):
            single = single.join(named.select(F.col("member").alias(end), F.col("group").alias(f"g{end}")), end, "left")
        single = single.where(F.coalesce(F.col("ga") != F.col("gb"), F.lit(True))).select("a", "b")
        for end in ("a", "b"):
            single = single.join(own.select(F.col("rep").alias(end), F.col("weight").alias(f"w{end}"), F.col("embedding").alias(f"e{end}")), end)
        single = single.select("a", "b", "wa", "wb", "ea", "eb").mapInArrow(_single(d, threshold), "a long, b long, links long")
        results.append(runtime.materialize(single, "single-links"))
    if results:
        found = results[0]
        for x in results[1:]:
            found = found.union(x)
        counts = found.where("b = -1 and links > 0").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("rep"), "links")
        roots = connected(found.where("links = 0").select("a", "b"))
        reps = reps.join(counts, "rep", "left").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    else:
        reps = reps.withColumns({"links": F.lit(None).cast("long"), "root": F.lit(None).cast("long")})
    reps = reps.select("embedding", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first")
    reps = runtime.materialize(reps, "vector-roots")
    least = runtime.materialize(reps.groupBy("root").agg(F.min("first").alias("component_id")), "vector-components")
    reps = runtime.materialize(reps.join(least, "root").select("embedding", "n_links", "component_id"), "vector-results")
    linked = rows.where("sound").join(reps, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
