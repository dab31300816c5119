"""Line dedup by winnowing over line hashes.

A run is a sequence of whole lines of one document; lines without words don't
count, blanks around a line don't matter.  The unit of comparison is the
shortest run, from a line on or up to a line, that holds ``MIN_WORDS`` words:
any repeated run of so many words is a union of such units, and a line of so
many words is one by itself.  A line goes if it lies in a unit that stands
earlier without overlap (documents by id, lines from the top); the first place
of each unit stays.

The line hashes of each document are winnowed: of every ``W`` consecutive
lines the one of least hash is a fingerprint, so any run of ``W`` lines that
repeats shares one; units of fewer lines are fingerprints themselves.
Fingerprints are counted over the corpus with map-side sums.  The positions of
those that repeat are joined and extended both ways to all units over them,
and these alone are compared and dated by their first place.  Copies are never
paired with each other, only with the first place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .decontamination import winnow
from .words import Words, mix, not_blank

#: Words of a repeated run that goes, lines of a winnowing window.
MIN_WORDS = 50
W = 4

_TABLE = not_blank()
_NOT_FEED = np.ones(256, bool)
_NOT_FEED[10] = False
_BASE = 0xF1357AEA2E62A9C5


def line_arrays(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: hash, number of words, number of the line in its text; and where each text's lines begin."""
    words = Words(texts, _TABLE, lower=False)
    feeds = np.flatnonzero(words.raw == 10)
    # the line of each word, then the first and last word of each line
    line = np.searchsorted(feeds, words.start)
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(line)])) - 1 if len(first) else first
    spans = Words.__new__(Words)
    spans.raw, spans.start, spans.end = words.raw, words.start[first], words.end[last]
    doc = words.doc[first]
    begin = np.searchsorted(feeds, words.text_at[:-1])
    return spans.hashes(), last - first + 1, line[first] - begin[doc], np.searchsorted(doc, np.arange(words.n + 1))


def units(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end, hash) of every unit of the texts whose lines begin at ``first``."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = np.concatenate(([0], np.cumsum(counts)))
    end = np.searchsorted(words, words[:-1] + least)
    fits = end <= first[1:][owner]
    begin = np.searchsorted(words, words[1:] - least, side="right") - 1
    back = begin >= first[:-1][owner]
    pairs = np.unique(np.concatenate((np.flatnonzero(fits) * (n + 1) + end[fits], begin[back] * (n + 1) + np.flatnonzero(back) + 1)))
    a, b = pairs // (n + 1), pairs % (n + 1)
    steps = np.full(n + 1, _BASE, np.uint64)
    steps[0] = 1
    back_steps = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back_steps[0] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.multiply.accumulate(steps)[:n], dtype=np.uint64)))
    return a, b, mix((total[b] - total[a]) * np.multiply.accumulate(back_steps)[a] + (b - a).astype(np.uint64))


def fingerprints(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, fingerprint) of the winnowed lines and the short units."""
    at, prints = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= W:
            own = np.flatnonzero(winnow(hashes[a:b], W)) + a
            at.append(own)
            prints.append(hashes[own])
    a, b, value = units(hashes, counts, first, least)
    short = b - a < W
    at.append(a[short])
    prints.append(mix(value[short] + np.uint64(1)))
    return np.concatenate(at), np.concatenate(prints)


def _flat(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    column = batch.column(k)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rows(batch: pa.RecordBatch, owner: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    keys = [batch.column(i).take(pa.array(owner)) for i in (0, 1)]
    return pa.record_batch([*keys, *map(pa.array, columns.values())], names=["doc_id", "text_hash", *columns])


def _per_document(df: DataFrame, schema: str, f) -> DataFrame:
    runtime.ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                yield f(batch.slice(k, 2000))

    return df.mapInArrow(run, schema)


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to delete: doc_id, text_hash, spans (array of first line and end, counted over lines with words)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def lines():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, n, _, first = line_arrays([x.encode() for x in batch.column(2).to_pylist()])
            offsets = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))]
            return pa.record_batch([batch.column(0), batch.column(1), *lists], names=["doc_id", "text_hash", "h", "n"])

        return run

    schema = runtime.added(rows.select("doc_id", "text_hash").schema, "h array<long>, n array<int>")
    lined = runtime.materialize(runtime.map_slices(rows, "text", schema, lines), "lines")

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        (h, first), (n, _) = _flat(batch, 2), _flat(batch, 3)
        at, value = fingerprints(h.view(np.uint64), n, first, min_words)
        owner = np.searchsorted(first, at, side="right") - 1
        return _rows(batch, owner, {"line": (at - first[owner]).astype(np.int32), "print": value.view(np.int64)})

    found = _per_document(lined, f"doc_id {kind}, text_hash long, line int, print long", prints)
    found = runtime.materialize(found, "line-prints")
    repeated = runtime.materialize(found.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print"), "line-repeats")
    hits = found.join(repeated, "print").groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("at"))

    def extended(batch: pa.RecordBatch) -> pa.RecordBatch:
        (h, first), (n, _), (at, at_first) = _flat(batch, 2), _flat(batch, 3), _flat(batch, 4)
        a, b, value = units(h.view(np.uint64), n, first, min_words)
        marked = np.zeros(len(h) + 1, np.int64)
        marked[at + np.repeat(first[:-1], np.diff(at_first)) + 1] = 1
        near = np.cumsum(marked)
        over = near[b] > near[a]
        a, b, value = a[over], b[over], value[over]
        owner = np.searchsorted(first, a, side="right") - 1
        return _rows(batch, owner, {"unit": value.view(np.int64), "first": (a - first[owner]).astype(np.int32), "end": (b - first[owner]).astype(np.int32)})

    same = [lined["doc_id"].eqNullSafe(hits["doc_id"]), lined["text_hash"] == hits["text_hash"]]
    near = lined.join(hits, same[0] & same[1]).select(lined["doc_id"], lined["text_hash"], "h", "n", "at")
    found = runtime.materialize(_per_document(near, f"doc_id {kind}, text_hash long, unit long, first int, end int", extended), "line-units")
    place = F.struct("doc_id", "text_hash", "first", "end")
    dated = found.groupBy("unit").agg(F.count("*").alias("times"), F.min(place).alias("o")).where("times > 1").select("unit", "o")
    dated = runtime.materialize(dated, "line-firsts")
    later = found.join(dated, "unit").where(~F.col("doc_id").eqNullSafe(F.col("o.doc_id")) | (F.col("text_hash") != F.col("o.text_hash")) | (F.col("first") >= F.col("o.end")))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines in ``spans``, its number of lines, and of deleted ones; lines without words go between two deleted ones."""
    lines = text.split("\n")
    worded = [k for k, x in enumerate(lines) if any(_TABLE[b] for b in x.encode())]
    gone = np.zeros(len(worded) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    drop = set()
    for k in np.flatnonzero(gone).tolist():
        drop.add(worded[k])
        if k + 1 < len(worded) and gone[k + 1]:
            drop.update(range(worded[k], worded[k + 1]))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later repeated runs of lines.

    Returns ``docs`` with the text cut, n_lines and n_deleted (both replaced
    if they exist), and emptied: whether the cut left nothing of a text that
    had words.  A null text stays null; rows of equal id and text are one place
    and are cut alike; a null id sorts first.
    """
    spans = runtime.materialize(deletions(docs, doc_id, text, min_words), "line-cuts").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash", "spans": "__spans"})
    # the cuts follow the corpus, so the join is planned for any size of them: both sides are dealt by document
    spans = spans.hint("merge")
    rows = docs.drop("n_lines", "n_deleted", "emptied").withColumn("__own", F.xxhash64(text))
    joined = rows.join(spans, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left").drop("__id", "__hash", "__own")
    schema = runtime.added(joined.drop("__spans").schema, "n_lines long, n_deleted long, emptied boolean")
    at, spans_at = joined.columns.index(text), joined.columns.index("__spans")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, lines, deleted, emptied = [], [], [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                if t is None:
                    new, n, d = None, 0, 0
                elif not s:
                    new, n, d = t, t.count("\n") + 1, 0
                else:
                    new, n, d = cut(t, [(x["first"], x["end"]) for x in s])
                texts.append(new)
                lines.append(n)
                deleted.append(d)
                emptied.append(bool(d) and not new.strip("\x20\t\n\x0b\x0c\r"))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != spans_at]
            return pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(deleted, pa.int64()), pa.array(emptied, pa.bool_())], names=schema.names)

        return run

    return runtime.map_slices(joined, text, schema, make)
