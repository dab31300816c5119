"""Benchmark decontamination by winnowing.

Words are hashed, runs of ``K`` words are hashed again, and of each ``W``
consecutive ones only the least (the rightmost of equals) is a fingerprint.
Two texts that share ``K + W - 1`` words share a fingerprint, so a window of
that many words is found wherever it stands.  A document's fingerprints are
joined with the benchmark's; each hit is extended to all windows of the full
length around it, which are compared whole.  Items shorter than a window are a
window of their own; for their lengths every run is a fingerprint (W = 1).

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words.  Each block
is broadcast (its size has that bound) and the documents pass through all
blocks in one job, carrying their hits along; the documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import Words, alphanumeric, grams

#: Words of a fingerprint, fingerprints of a winnowing window, words of a full window.
K, W = 5, 6
WINDOW = K + W - 1
#: The most benchmark words in one broadcast block; a longer single item is a block alone.
BLOCK_WORDS = 4_000_000

_TABLE = alphanumeric()


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Mask of the entries that are the least of any ``w`` consecutive ones, the rightmost of equals."""
    n = len(hashes)
    if n <= w:
        out = np.zeros(n, bool)
        if n:
            out[n - 1 - int(np.argmin(hashes[::-1]))] = True
        return out
    least, at = hashes[: n - w + 1].copy(), np.arange(n - w + 1)
    for i in range(1, w):
        other = hashes[i : n - w + 1 + i]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + i
    out = np.zeros(n, bool)
    out[at] = True
    return out


@dataclass
class Block:
    """One block of the benchmark: by window length, sorted window hashes, and the items of each."""

    items: list[str]
    fingerprints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_block(items: list[tuple[str, bytes]]) -> Block:
    """The index of (item id, text) rows."""
    words = Words([t for _, t in items], _TABLE)
    hashes = words.hashes()
    sizes = np.diff(words.first)
    found: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    prints = []
    for k, n in enumerate(sizes.tolist()):
        if not n:
            continue
        own = hashes[words.first[k] : words.first[k + 1]]
        length = min(n, WINDOW)
        found[length].append((k, grams(own, length)))
        if n >= WINDOW:
            g = grams(own, K)
            prints.append(g[winnow(g, W)])
    windows = {}
    for length, rows in found.items():
        all_hashes = np.concatenate([h for _, h in rows])
        owner = np.concatenate([np.full(len(h), k) for k, h in rows])
        order = np.lexsort((owner, all_hashes))
        all_hashes, owner = all_hashes[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (all_hashes[1:] != all_hashes[:-1]) | (owner[1:] != owner[:-1])
        all_hashes, owner = all_hashes[new], owner[new]
        keys, first = np.unique(all_hashes, return_index=True)
        windows[length] = (keys, np.concatenate((first, [len(owner)])), owner)
    return Block([i for i, _ in items], np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), windows)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each value in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Filter:
    """A bit table that lets through the few hashes worth a binary search."""

    def __init__(self, keys: np.ndarray):
        bits = max(16, int(len(keys) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[keys >> self.shift] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[hashes >> self.shift])


class Matcher:
    def __init__(self, block: Block):
        self.block = block
        self.prints = Filter(block.fingerprints)
        self.short = {n: Filter(keys) for n, (keys, _, _) in block.windows.items() if n < WINDOW}

    def windows(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, first words, places among the block's windows) of all windows that occur."""
        last = words.first[1:][words.doc] if len(hashes) else np.zeros(0, np.int64)
        if len(self.block.fingerprints) and len(hashes) >= WINDOW:
            g = grams(hashes, K)
            at = np.arange(len(g))
            # winnowing over a whole part also covers each text: a minimum within a text's own windows is among these
            whole = at + K <= last[: len(g)]
            ranked = np.where(whole, g, np.uint64(0xFFFFFFFFFFFFFFFF))
            hits = np.flatnonzero(winnow(ranked, W) & whole)
            hits = hits[self.prints.places(g[hits])]
            hits = hits[_among(g[hits], self.block.fingerprints) >= 0]
            if len(hits):
                starts = np.unique((hits[:, None] - np.arange(W)).ravel())
                starts = starts[(starts >= 0)]
                starts = starts[starts + WINDOW <= last[starts]]
                value = _gram_at(hashes, starts, WINDOW)
                keys = self.block.windows[WINDOW][0]
                place = _among(value, keys)
                yield WINDOW, starts[place >= 0], place[place >= 0]
        for n, near in self.short.items():
            if len(hashes) < n:
                continue
            g = grams(hashes, n)
            at = near.places(g)
            at = at[at + n <= last[at]]
            place = _among(g[at], self.block.windows[n][0])
            yield n, at[place >= 0], place[place >= 0]


def _gram_at(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """grams() at a few places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return grams_of(hashes[starts[:, None] + np.arange(n)])


def grams_of(rows: np.ndarray) -> np.ndarray:
    from .words import mix

    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out = out * np.uint64(0xD6E8FEB86659FD93) + rows[:, i]
    return mix(out)


def match(texts: list[bytes | None], matcher: Matcher) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its number of words, spans of hit words (first, end), item ids found."""
    words = Words(texts, _TABLE)
    hashes = words.hashes()
    mark = np.zeros(len(hashes) + 1, np.int64)
    items: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for n, starts, places in matcher.windows(words, hashes):
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + n, -1)
        _, first, owner = matcher.block.windows[n]
        doc = words.doc[starts]
        pair = np.unique(doc * len(first) + places)
        doc, places = pair // len(first), pair % len(first)
        count = first[places + 1] - first[places]
        ends = np.cumsum(count)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first[places], count)
        owners.append(np.repeat(doc, count))
        items.append(owner[flat])
    hit = np.cumsum(mark[:-1]) > 0
    n_words = np.diff(words.first).tolist()
    spans: list[list[tuple[int, int]]] = [[] for _ in n_words]
    found: list[list[str]] = [[] for _ in n_words]
    if items:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:  # a run of hit words may reach over the ends of texts
                k = int(words.doc[a])
                stop = min(b, int(words.first[k + 1]))
                spans[k].append((a - int(words.first[k]), stop - int(words.first[k])))
                a = stop
        pairs = np.unique(np.concatenate(owners) * len(matcher.block.items) + np.concatenate(items))
        for p in pairs.tolist():
            found[p // len(matcher.block.items)].append(matcher.block.items[p % len(matcher.block.items)])
    return n_words, spans, found


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_matchers: dict[str, Matcher] = {}


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Find every window of the benchmark in every document.

    Returns doc_id, text, n_words, spans (array of first word and end) and
    items (ids as strings, sorted).  Null texts have no words and no hits; a
    null item id is left out; rows of equal ids stay apart; an empty benchmark
    hits nothing.  Other columns of either table are not read.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    bench = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-int(total) // (block_words * 4)) or 1
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<struct<first:long,end:long>>"), "items": F.lit(None).cast("array<string>")})
    schema = out.schema
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else bench
        rows = [(r.i, r.t.encode()) for r in part.toLocalIterator()]
        sent, name = spark.sparkContext.broadcast(build_block(rows)), uuid.uuid4().hex

        def make(sent=sent, name=name):
            if (matcher := _matchers.get(name)) is None:
                if len(_matchers) > 8:
                    _matchers.clear()
                matcher = _matchers[name] = Matcher(sent.value)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                n, spans, found = match([None if x is None else x.encode() for x in batch.column(1).to_pylist()], matcher)
                before, named = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                spans = [_joined([(x["first"], x["end"]) for x in a or ()], s) if a else s for a, s in zip(before, spans, strict=True)]
                found = [sorted({*(a or ()), *f}) for a, f in zip(named, found, strict=True)]
                cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([[{"first": s, "end": e} for s, e in x] for x in spans], arrow.field(3).type), pa.array(found, arrow.field(4).type)]
                return pa.record_batch(cols, names=arrow.names)

            return run

        out = runtime.map_slices(out, "text", schema, make)
    return out
