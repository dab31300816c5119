"""Token ids in packed binary files.

A shard is one file of a bounded number of blocks; documents stand in ascending
id order within a shard and from shard to shard.  Each id takes the least whole number of bits that holds
the vocabulary.  A shard is a row of blocks and a footer, each followed by a
line feed (Spark's committer writes the files, so a lost task leaves none):

block   ``PWT1``, bits u32, documents u32, tokens u64, bytes of packed ids u64,
        then for each document: id i64, tokens u32, id present u8;
        then the packed ids, the lowest bit first
footer  offset of each block u64, first token of each block u64,
        blocks u32, tokens of the shard u64, ``PWTF``

Block offsets give random access: ``read_tokens`` opens the blocks it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .chunks import PieceTable, text_bytes

HEAD = struct.Struct("<4sIIQQ")
TAIL = struct.Struct("<IQ4s")
#: Ids in a block before it is closed, and blocks of a shard before it is.
BLOCK_IDS, SHARD_BLOCKS = 1 << 18, 256


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.asarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from id ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    if not count:
        return np.zeros(0, np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    lo = int(at[0]) >> 3
    part = np.frombuffer(data, np.uint8)[lo : ((int(at[-1]) + bits - 1) >> 3) + 1]
    part = np.concatenate((part, np.zeros(8, np.uint8)))
    byte = (at >> 3) - lo
    out = np.zeros(count, np.uint64)
    for i in range((bits + 14) // 8):
        out |= part[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block(doc_ids: np.ndarray, present: np.ndarray, counts: np.ndarray, flat: np.ndarray, bits: int) -> bytes:
    """Documents whose ids stand one after the other in ``flat``."""
    packed = pack(flat, bits)
    table = doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + present.astype(np.uint8).tobytes()
    return HEAD.pack(b"PWT1", bits, len(doc_ids), len(flat), len(packed)) + table + packed


def footer(offsets: list[int], firsts: list[int], tokens: int) -> bytes:
    return np.array(offsets, "<u8").tobytes() + np.array(firsts, "<u8").tobytes() + TAIL.pack(len(offsets), tokens, b"PWTF")


def index(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, int]:
    """Block offsets, first tokens and the number of tokens of a shard."""
    blocks, tokens, mark = TAIL.unpack_from(data, len(data) - TAIL.size - 1)
    if mark != b"PWTF":
        raise ValueError("not a token shard: the footer is missing")
    at = len(data) - TAIL.size - 1 - 16 * blocks
    return np.frombuffer(data, "<u8", blocks, at), np.frombuffer(data, "<u8", blocks, at + 8 * blocks), tokens


def open_block(data: bytes | memoryview, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Document ids, which of them there are, their token counts, bits, and where the packed ids begin."""
    mark, bits, docs, _, _ = HEAD.unpack_from(data, offset)
    if mark != b"PWT1":
        raise ValueError("not a token block")
    at = offset + HEAD.size
    ids, counts = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u4", docs, at + 8 * docs)
    return ids, np.frombuffer(data, np.uint8, docs, at + 12 * docs).astype(bool), counts, bits, at + 13 * docs


def read_documents(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, first token within the shard, token ids) of each document, block by block."""
    view = memoryview(data)
    offsets, firsts, _ = index(view)
    for offset, first in zip(offsets.tolist(), firsts.tolist(), strict=True):
        ids, present, counts, bits, at = open_block(view, offset)
        flat = unpack(view[at:], bits, int(counts.sum()))
        ends = np.cumsum(counts, dtype=np.int64)
        for d, p, n, end in zip(ids.tolist(), present.tolist(), counts.tolist(), ends.tolist(), strict=True):
            yield d if p else None, first + end - n, flat[end - n : end]


def read_tokens(data: bytes, first: int, count: int) -> np.ndarray:
    """Tokens ``first`` to ``first + count`` of a shard; only the blocks that hold them are unpacked."""
    view = memoryview(data)
    offsets, firsts, tokens = index(view)
    first, stop = min(first, tokens), min(first + count, tokens)
    out = []
    k = max(0, int(np.searchsorted(firsts, first, side="right")) - 1)
    while first < stop:
        _, _, counts, bits, at = open_block(view, int(offsets[k]))
        begin = int(firsts[k])
        end = min(stop, begin + int(counts.sum()))
        if end > first:
            out.append(unpack(view[at:], bits, end - first, first - begin))
            first = end
        k += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _library(path: str) -> tuple[PieceTable, int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    return PieceTable(encode, [x.content for x in t.get_added_tokens_decoder().values()]), t.get_vocab_size(with_added_tokens=True)


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, shard_blocks: int = SHARD_BLOCKS) -> None:
    """Encode whole texts with the ``tokenizers`` library and write packed shards to ``path``.

    Ids ascend over the shards; a null id stands first, a null text counts as
    empty, repeated ids each keep their tokens, in the order of a hash of the
    text (and may be dealt to several shards), an empty table gives shards
    without blocks.  A text of any length is encoded whole, as a block that may
    be longer than others.  ``end_id`` is put after each document; ``shards``
    is the least number of shards.
    """
    spark = df.sparkSession
    runtime.ship(spark)
    shards = shards or runtime.partitions(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = _library(tokenizer)
        bits = max(1, (max(size - 1, end_id)).bit_length())
        kind = pa.schema([("value", pa.binary())])
        at, total, offsets, firsts = 0, 0, [], []
        #: documents of the block that is open: ids, whether there is one, token counts, tokens
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tokens = 0

        def written(data: bytes) -> pa.RecordBatch:
            return pa.record_batch([pa.array([data], pa.binary())], schema=kind)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal at, total, tokens
            data = block(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
            offsets.append(at)
            firsts.append(total)
            at, total, tokens = at + len(data) + 1, total + tokens, 0
            held.clear()
            yield written(data)
            if len(offsets) == shard_blocks:
                yield ended()

        def ended() -> pa.RecordBatch:
            nonlocal at, total
            data = footer(offsets, firsts, total)
            at, total = 0, 0
            offsets.clear()
            firsts.clear()
            return written(data)

        empty = True
        for batch in batches:
            for part in runtime.slices(batch, 1):
                flat, ends = table.ids(*text_bytes(part.column(1)))
                flat, ends = np.insert(flat, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
                present = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                docs, counts, k = part.column(0).fill_null(0).to_numpy(), np.diff(ends), 0
                while k < len(docs):
                    # a block ends with the document that fills it
                    j = min(len(docs), int(np.searchsorted(ends[1:], ends[k] + block_ids - tokens)) + 1)
                    held.append((docs[k:j], present[k:j], counts[k:j], flat[ends[k] : ends[j]]))
                    tokens += int(ends[j] - ends[k])
                    k, empty = j, False
                    if tokens >= block_ids:
                        yield from closed()
        if held:
            yield from closed()
        if offsets or empty:
            yield ended()

    # Spark begins a new file after as many records, which is where each footer stands
    writer = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write
    writer.option("compression", "none").option("maxRecordsPerFile", shard_blocks + 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: shard, doc_id, first token within the shard, n_tokens, ids (binary, u32)."""
    runtime.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    files = files.select((number(r"part-(\d+)") * (1 << 24) + number(r"-c(\d+)\.[^/]*$")).alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(data.as_buffer())
                offsets, firsts, _ = index(view)
                for offset, first in zip(offsets.tolist(), firsts.tolist(), strict=True):
                    docs, present, counts, bits, at = open_block(view, offset)
                    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                    flat = unpack(view[at:], bits, int(ends[-1])).astype("<u4")
                    for k in range(0, len(docs), 10_000):
                        own = ends[k : k + 10_001]
                        n = len(own) - 1
                        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * (own - own[0])), pa.py_buffer(flat[own[0] : own[-1]].tobytes())])
                        columns = [np.full(n, shard), pa.array(docs[k : k + n], mask=~present[k : k + n]), first + own[:-1], np.diff(own)]
                        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), ids.cast(pa.binary())], names=["shard", "doc_id", "local_start", "n_tokens", "ids"])

    return files.mapInArrow(run, "shard long, doc_id long, local_start long, n_tokens long, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all documents before; one row a shard passes through one window."""
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    return read.join(totals, F.col("shard") == F.col("of")).withColumn("start", F.col("ahead") + F.col("local_start")).drop("of", "ahead")
