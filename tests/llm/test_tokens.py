"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patternweave.llm import bpe, queries, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.RankArrayBPE(PATH)
SCHEMA = "doc_id long, text string, ids string, value string"


def odd_texts():
    r = random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "日本", "🙂", "12", "½", "the", " The", "!!", "<|endoftext|>", " ", "\x1c", "x."]
    out = ["", " ", "  a", "a ", "a  b", "\n x", "x\n y", "don't, can't.", "<|endoftext|>", "a <|endoftext|> b.", "word" * 400, "ab" * 3000, " " * 500, "1" * 300]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(400)]


def test_bpe_is_the_librarys():
    texts = odd_texts()
    got = CODEC.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert CODEC.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False) == t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_on_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for t, ids in zip(texts, CODEC.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
        assert CODEC.decode(ids) == t


def test_long_words_merge_as_short_ones(monkeypatch):
    words = [b"international", b"aaaaaaaaaaaaaaaa", "日本語テキスト".encode(), b"thethethethe"]
    short = [CODEC.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [CODEC.merge(w) for w in words] == short


def test_decoding_any_ids():
    r = random.Random(1)
    ids = np.array([r.randrange(50257) for _ in range(500)], np.uint32)
    assert CODEC.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << bits, 1000).astype(np.uint32)
    data = token_output.pack(ids, bits)
    assert len(data) == (1000 * bits + 7) // 8
    assert (token_output.unpack(data, bits, 1000) == ids).all()
    assert (token_output.unpack(data, bits, 37, 501) == ids[501:538]).all()
    assert len(token_output.unpack(data, bits, 0)) == 0


def shard(parts, bits=17):
    data, offsets, firsts, at = b"", [], [], 0
    for docs, ids in parts:
        offsets.append(len(data))
        firsts.append(at)
        present = np.array([d is not None for d in docs])
        data += token_output.block(np.array([d or 0 for d in docs]), present, np.array([len(x) for x in ids]), np.concatenate(ids), bits) + b"\n"
        at += sum(map(len, ids))
    return data + token_output.footer(offsets, firsts, at) + b"\n", at


def test_random_access_over_blocks():
    r = np.random.default_rng(0)
    parts = [([10 * k, None], [r.integers(0, 99999, 50 + k).astype(np.uint32), r.integers(0, 99999, 7).astype(np.uint32)]) for k in range(4)]
    data, total = shard(parts)
    flat = np.concatenate([x for _, ids in parts for x in ids])
    for first, n in ((0, total), (3, 5), (55, 80), (total - 1, 10), (total + 5, 3), (0, 0)):
        assert (token_output.read_tokens(data, first, n) == flat[first : first + n]).all()
    assert [d for d, _, _ in token_output.read_documents(data)] == [d for docs, _ in parts for d in docs]


def test_op1_and_op6_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    files, digests, start = {}, {}, 0
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        whole = np.array([*ids, 2], "<u4").tobytes()
        files[r.doc_id] = (start, len(ids) + 1, zlib.crc32(whole))
        start += len(ids) + 1
        digests[r.doc_id] = (len(ids), hashlib.sha256(whole[:-4]).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in queries.op1_token_output(spark, sf_dir).collect()} == files
    assert {r[0]: tuple(r[1:]) for r in queries.op6_bpe(spark, sf_dir).collect()} == digests


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "null id", "x", "y"), (3, "same", "x", "y"), (3, "other text", "x", "y"), (3, "same", "x", "y"), (-5, "word " * 50_000, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = bpe.encode_decode(df, PATH)
    assert sorted((r.doc_id or 0, r.decoded) for r in made.collect()) == sorted((i or 0, t or "") for i, t, _, _ in rows)
    token_output.write_token_files(df, f"file://{tmp_path}/t", PATH, 2)
    back = token_output.with_starts(token_output.read_token_files(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, -5, 1, 2, 3, 3, 3]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()
    assert [r.n_tokens for r in back if r.doc_id in (1, 2)] == [1, 1]
    # rows of one id stand in the order of their texts' hashes, however they are dealt
    other = token_output.write_token_files(df.repartition(3), f"file://{tmp_path}/u", PATH, 2, shards=5)
    again = token_output.with_starts(token_output.read_token_files(spark, f"file://{tmp_path}/u")).orderBy("start").collect()
    assert other is None and [(r.doc_id, r.start, bytes(r.ids)) for r in again] == [(r.doc_id, r.start, bytes(r.ids)) for r in back]


def test_shards_end_after_so_many_blocks(spark, tmp_path):
    df = spark.createDataFrame([(k, "some words here " * (k % 7)) for k in range(200)], "doc_id long, text string")
    token_output.write_token_files(df, f"file://{tmp_path}/t", PATH, 2, shards=2, block_ids=50, shard_blocks=3)
    back = token_output.with_starts(token_output.read_token_files(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r.doc_id for r in back] == list(range(200)) and len({r.shard for r in back}) > 10
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()
    assert all(r.n_tokens == len(LIBRARY.encode("some words here " * (r.doc_id % 7), add_special_tokens=False).ids) + 1 for r in back)


def test_pieces_of_one_hash_and_a_full_table(monkeypatch):
    from patternweave.llm import chunks

    monkeypatch.setattr(chunks, "KEPT", 40)
    monkeypatch.setattr(chunks, "mix", lambda x: x & np.uint64(0xF000000000000001))
    codec, texts = bpe.RankArrayBPE(PATH), odd_texts()
    for t in texts:
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
    assert [x for x in codec.encode(texts)] == CODEC.encode(texts)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_decode(df, PATH).count() == 0
    token_output.write_token_files(df, f"file://{tmp_path}/t", PATH, 2)
    assert token_output.with_starts(token_output.read_token_files(spark, f"file://{tmp_path}/t")).count() == 0
