"""Near copies of the pipeline, against brute force over sets of shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from patternweave.llm import groups, near_copies, runtime, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def least(rows):
    """The least id of each document's component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[k][0]: min(rows[i][0] for i in range(len(rows)) if root[i] == root[k]) for k in range(len(rows))}


def edited(words, n, r):
    """A copy with ``n`` words changed, far enough apart that each breaks five shingles."""
    out = list(words)
    for k in range(n):
        out[10 + 10 * k] = f"new{r.random()}"
    return out


def test_near_copies_are_those_of_brute_force(spark):
    r = random.Random(8)
    rows = [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c")]
    for k in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        # one to four changed words of 200 keep a similarity of 0.8 or more, five and six don't
        rows += [(10 * k + n, " ".join(edited(words, n, r))) for n in range(7)]
    sims = [similarity(shingles(rows[5 + 7 * k][1]), shingles(rows[5 + 7 * k + n][1])) for k in range(12) for n in (4, 5)]
    assert all(s >= 0.8 for s in sims[::2]) and all(s < 0.8 for s in sims[1::2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == least(rows)


def test_the_stage_drops_copies_at_the_limit(spark, sf_dir):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited(words, 4, r))), (None, " ".join(words))], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf_dir).collect()) == ["1", "None"]


def test_a_table_against_brute_force(spark, sf_dir):
    docs = runtime.load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(x) for x in docs.collect()]
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == least(rows)


@pytest.mark.parametrize("block", [4096, 16])
def test_a_dense_group_around_the_limit(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    r = random.Random(block)
    words = [f"w{r.randrange(5000)}" for _ in range(120)]
    # copies of copies: chains of links, and pairs just under the limit that no chain joins
    rows = [(0, " ".join(words))]
    for k in range(1, 90):
        base = r.choice(rows)[1].split() if k % 3 else words
        rows.append((k, " ".join(x if r.random() > r.choice([0.005, 0.02, 0.05]) else f"n{r.randrange(10**6)}" for x in base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least(rows)
    assert 5 < len(set(want.values())) < 85
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == want


def test_codes_keep_pairs_at_the_limit():
    r = np.random.default_rng(5)
    worst = 0
    for n in (5, 6, 8, 10, 16, 36, 45, 90, 180, 900):
        shared = -(-4 * n // 5)
        for _ in range(40):
            h = r.integers(0, 1 << 63, n).astype(np.uint64)
            cut = shared + int(r.integers(0, n - shared + 1))
            code = simhash.wide_codes([h[:cut], np.concatenate((h[:shared], h[cut:]))], near_copies.LANES)
            apart = int(np.bitwise_count(code[0] ^ code[1]).sum())
            limit = near_copies.SMALL_REACH if min(cut, n - cut + shared) <= near_copies.SMALL else near_copies.REACH
            worst = max(worst, apart / limit)
    assert worst <= 1


def coded(r, n):
    """Random sets of 20 to 400 hashes and copies of them around the limit: codes and sizes."""
    sets = [r.integers(0, 1 << 63, int(r.integers(20, 400))).astype(np.uint64) for _ in range(n)]
    sets += [np.concatenate((s[: int(len(s) * r.uniform(0.8, 1))], r.integers(0, 1 << 63, int(r.integers(0, 20))).astype(np.uint64))) for s in sets for _ in range(3)]
    return simhash.wide_codes(sets, near_copies.LANES), np.array([len(s) for s in sets])


@pytest.mark.parametrize("lanes", [near_copies.NARROW, near_copies.LANES])
@pytest.mark.parametrize("same", [True, False])
def test_trees_find_all_pairs_within_reach_and_prune(lanes, same):
    code, size = coded(np.random.default_rng(lanes), 300)
    code, every = code[:, :lanes], np.arange(len(size))
    side = every % 2
    homes, queries = (every, every[:0]) if same else (every[side == 0], every[side == 1])
    got = {(min(p, q), max(p, q)) for x in near_copies.near(code, size, every, homes, queries, same) for p, q in zip(x[0].tolist(), x[1].tolist(), strict=True)}
    apart = sum(np.bitwise_count(code[:, k][:, None] ^ code[:, k][None, :]).astype(int) for k in range(lanes))
    narrow = sum(np.bitwise_count(code[:, k][:, None] ^ code[:, k][None, :]).astype(int) for k in range(near_copies.NARROW))
    near = (apart <= near_copies.reach(near_copies.SHARE, 64 * lanes)) & (narrow <= near_copies.reach(near_copies.SHARE, 64 * near_copies.NARROW))
    near &= (5 * size[:, None] >= 4 * size) & (5 * size >= 4 * size[:, None])
    want = {(p, q) for p, q in zip(*np.nonzero(near), strict=True) if p < q and (same or side[p] != side[q])}
    assert got == want and len(want) > 100
    looked = sum(len(a) * len(b) for a, b in near_copies.leaves([code[:, k] for k in range(lanes)], size, homes, queries, near_copies.reach(near_copies.SHARE, 64 * lanes), same))
    assert looked < 0.7 * (len(homes) * (len(homes) / 2 + len(queries)))


def test_shards_are_bits_of_codes_and_keep_pairs_at_the_limit():
    r = np.random.default_rng(9)
    for n in (4, 9, 45, 900):
        shared = -(-4 * n // 5)
        sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(200)]
        cut = shared + (n - shared) // 2
        codes = simhash.wide_codes([x for s in sets for x in (s[:cut], np.concatenate((s[:shared], s[cut:])))], near_copies.LANES)
        for rows in (1000, 200_000, 12_000_000):
            bits, number, small = near_copies.tables(rows)
            keys = near_copies.table_keys(codes, bits, small if n <= near_copies.SMALL + 1 else number)
            assert keys.max() >> bits == keys.shape[1] - 1 and rows >> bits <= near_copies.SHARD_ROWS
            assert (keys[0::2] == keys[1::2]).any(1).all()
            # whether two sets share a shard hangs on their codes alone
            flipped = codes[:1] ^ np.uint64(0xFFFFFFFFFFFFFFFF)
            assert not bits or not (near_copies.table_keys(flipped, bits, number) == keys[:1, :number]).any()


def test_many_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARD_ROWS", 8)
    r = random.Random(11)
    rows = []
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([7, 60, 200]))]
        rows += [(10 * k + n, " ".join(edited(words, n, r) if len(words) > 60 else words + [f"x{n}"] * (n % 3))) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.tables(len(rows))[0] == 5
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == least(rows)
