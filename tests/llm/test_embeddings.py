"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest

from patternweave.llm import embedding_dedup as op
from patternweave.llm import groups
from patternweave.llm import queries
from patternweave.llm.components import connected, spanning

SCHEMA = "vec_id long, embedding array<double>, n_links string, root string"


def clusters(n, d, seed):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((max(2, n // 12), d))
    x = centre[r.integers(0, len(centre), n)] + r.standard_normal((n, d)) * r.choice([0.05, 0.2, 0.5], (n, 1))
    return np.concatenate((x, r.standard_normal((n // 2, d))))


def brute(ids, vectors, threshold=op.THRESHOLD):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(ids)
    small = [np.array(v, float) / np.abs(np.array(v, float)).max() if sound(v) else None for v in vectors]
    unit = [None if v is None else v / np.linalg.norm(v) for v in small]
    links = [0] * n
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [(ids[k], links[k], least.get(find(k)), ids[k] == least.get(find(k))) for k in range(n)]


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


def test_links_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = [tuple(r) for r in queries.op4_embedding_dedup(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute([r.vec_id for r in rows], [r.embedding for r in rows]))


@pytest.mark.parametrize("block, dense", [(4096, 16), (16, 2)])
def test_links_of_odd_rows(spark, monkeypatch, block, dense):
    monkeypatch.setattr(groups, "BLOCK", block)
    monkeypatch.setattr(op, "BUCKET_BLOCK", block)
    monkeypatch.setattr(op, "DENSE", dense)
    monkeypatch.setattr(op, "BUCKET", 24)
    x = clusters(120, 16, block).tolist()
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e200] * 16, [1e-200] * 16, [-1.0] * 16]
    vectors = [*x, *x[:5], x[0], *odd]
    ids = [3 * k for k in range(len(vectors))]
    ids[7], ids[9] = ids[6], None
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df).collect()]
    want = [(i, n, c, (i == c)) for i, n, c, _ in brute(ids, vectors)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert op.near_duplicates(df.limit(0)).count() == 0
    assert op.near_duplicates(df.where("vec_id is null or size(embedding) = 0")).count() == 2


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(5)
    d = 64
    x = r.standard_normal((400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x + 0.3 * r.standard_normal((400, d)) / math.sqrt(d)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    signs, factors = op.encode(x)
    error = np.diag(op.estimate(signs, factors, q)) - (x * q).sum(1)
    spread = op.deviation(factors, d)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= op.DEVIATIONS * spread).all()


@pytest.mark.parametrize("d", [64, 768])
def test_bounds_keep_links_and_little_else(d):
    r = np.random.default_rng(d)
    topic = np.repeat(r.standard_normal((4, d)), 100, axis=0)
    x = np.concatenate((topic + math.sqrt(1 / 0.85 - 1) * r.standard_normal((400, d)), topic[:40] + r.choice([0.05, 0.2, 0.25], (40, 1)) * r.standard_normal((40, d))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factors = op.encode(x)
    scale = np.abs(x).max(1) / 127
    query = np.rint(x / scale[:, None]).astype(np.int8) * scale[:, None]
    every = np.arange(len(x))
    p, q = op._near(signs, factors, query, scale, every, every, op.THRESHOLD)
    got = {(a, b) for a, b in zip(p.tolist(), q.tolist(), strict=True) if a < b}
    cosine = x @ x.T
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(cosine >= op.THRESHOLD), strict=True) if a < b}
    assert true and true <= got
    assert all(cosine[a, b] >= op.THRESHOLD - 0.06 for a, b in got)


def test_tables_meet_near_pairs():
    for n in (100, 10_000, 3_000_000, 10**9):
        bits, tables = op.table_plan(n)
        meet = (1 - math.acos(op.THRESHOLD) / math.pi) ** bits
        assert (1 - meet) ** tables <= op.MISS * 1.0001
        assert n / 2**bits <= 2 * op.BUCKET


def test_components(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(-60, 60, 70), r.integers(-60, 60, 70)
    chain = [(k, k + 1) for k in range(100, 140)]
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *chain]
    got = {x.u: x.v for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    u, v = spanning(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert got == dict(zip(u.tolist(), v.tolist(), strict=True))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
