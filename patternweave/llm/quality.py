"""Quality classifier: random-indexing word vectors and a two-layer network.

Each whitespace word gives two entries: its letters (lower-cased, hashed) and
its shape (case, digits, marks, length, whether it repeats the word before).
Entries have sparse random index vectors, drawn from their number alone; an
entry's word vector is its index vector plus the normalised sum of the index
vectors found around it.  A document is pooled: means of the vectors of both
kinds, and their lengths, which repetition raises.  A two-layer numpy network
scores it, and its logits are divided by a temperature fitted on rows that the
network wasn't trained on.

The network is fitted on at most ``SAMPLE_ROWS`` labelled rows, those of least
hash of the id; everything else, the context sums too, covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import Words, not_blank

#: The bound of the labelled sample that the network is fitted on.
SAMPLE_ROWS = 16_384
#: Tasks that hold the sample, and tasks that add up the context sums of all others.
SAMPLE_TASKS = 8
#: Entries for letters and for shapes, dimensions, non-zero places of an index vector.
LETTERS, SHAPES, DIMENSIONS, PLACES = 1 << 13, 1 << 11, 48, 4
ENTRIES = LETTERS + SHAPES
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 3e-3
#: A document is predicted to be good from this score on.
GOOD = 0.3

_TABLE = not_blank()


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, one for each entry."""
    r = np.random.default_rng(2)
    out = np.zeros((ENTRIES, DIMENSIONS), np.float32)
    at = np.argsort(r.random((ENTRIES, DIMENSIONS)), axis=1)[:, :PLACES]
    np.put_along_axis(out, at, r.choice(np.array([-1, 1], np.float32), (ENTRIES, PLACES)), axis=1)
    return out


def entries(texts: list[bytes | None]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, and each one's letter and shape entry."""
    words = Words(texts, _TABLE, lower=False)
    raw = words.raw
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    high = raw >= 128
    mark = _TABLE[raw] & ~(upper | lower | digit | high)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[words.end] - total[words.start]

    letters = Words.__new__(Words)
    letters.raw = np.where(upper, raw + 32, np.where(mark, 0, raw)).astype(np.uint8)
    letters.start, letters.end = words.start, words.end
    # marks count as nothing within the letters, but their place shifts the hash; trailing ones are cut off
    trail = words.end.copy()
    for _ in range(4):
        cut = (trail > words.start) & mark[np.maximum(trail - 1, 0)]
        trail = trail - cut
    letters.end = trail
    h = letters.hashes()
    n_upper, n_lower, n_digit, n_mark, n_high = (count(m) for m in (upper, lower, digit, mark, high))
    size = words.end - words.start
    repeats = np.zeros(len(h), np.int64)
    repeats[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    last = np.where(n_mark > 0, raw[words.end - 1] if len(h) else 0, 0).astype(np.int64)
    shape = np.minimum(n_upper, 2)
    for part, base in ((np.minimum(n_lower, 1), 2), (np.minimum(n_digit, 2), 3), (np.minimum(n_mark, 4), 5), (np.minimum(n_high, 1), 2), (np.digitize(size, (2, 4, 8, 16, 32)), 6), (repeats, 2), (last, 256)):
        shape = shape.astype(np.int64) * base + part
    shape = (shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)
    return words, (h >> np.uint64(64 - 13)).astype(np.int64), LETTERS + shape


def contexts(texts: list[bytes | None], index: np.ndarray, into: np.ndarray) -> None:
    """Add to each entry the index vectors of the entries of its own and the next words."""
    words, letter, shape = entries(texts)
    if len(letter) < 2:
        return
    near = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    pairs = [(letter, shape), (shape, letter)]
    for a, b in ((letter, letter), (shape, shape), (letter, shape), (shape, letter)):
        pairs += [(a[near], b[near + 1]), (b[near + 1], a[near])]
    # an index vector has few places, so sums are counts by entry and place
    places = np.nonzero(index)[1].reshape(len(index), -1)
    signs = np.take_along_axis(index, places, 1).astype(np.float64)
    flat = into.reshape(-1)
    for a, b in pairs:
        flat += np.bincount((a[:, None] * DIMENSIONS + places[b]).ravel(), signs[b].ravel(), len(flat))


def word_vectors(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    return index / np.sqrt(PLACES) + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean vectors of letters and of shapes, their lengths, the logarithm of the number of words; zeros without words."""
    words, letter, shape = entries(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 3), np.float32)
    n = np.diff(words.first)
    some = np.flatnonzero(n)
    if len(some):
        at = words.first[:-1][some]
        for k, ids in enumerate((letter, shape)):
            mean = np.add.reduceat(vectors[ids], at, axis=0) / n[some, None]
            out[some, k * DIMENSIONS : (k + 1) * DIMENSIONS] = mean
            out[some, 2 * DIMENSIONS + k] = np.linalg.norm(mean, axis=1)
    out[:, -1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on four fifths of the rows, the temperature on the others.  Without rows of both labels the score is their share."""
    r = np.random.default_rng(22)
    x = x.astype(np.float64)
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    scale = x.std(0) + 1e-3 if len(y) else np.ones(d)
    net = Network(x.mean(0) if len(y) else np.zeros(d), scale, r.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    order = r.permutation(len(y))
    fit, hold = order[len(y) // 5 :], order[: len(y) // 5]
    z = (x - net.mean) / net.scale
    names = ("w1", "b1", "w2", "b2")
    moments = {k: (0.0, 0.0) for k in names}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        r.shuffle(fit)
        for k in range(0, len(fit), BATCH):
            a, t = z[fit[k : k + BATCH]], y[fit[k : k + BATCH]]
            hidden = np.tanh(a @ net.w1 + net.b1)
            err = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -60, 60))) - t) / len(t)
            back = err[:, None] * net.w2 * (1 - hidden**2)
            grads = {"w1": a.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": hidden.T @ err + 1e-4 * net.w2, "b2": err.sum()}
            step += 1
            for name in names:
                m, v = moments[name]
                m, v = 0.9 * m + 0.1 * grads[name], 0.999 * v + 0.001 * grads[name] ** 2
                moments[name] = (m, v)
                setattr(net, name, getattr(net, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    if len(hold):
        logit, t = net.logits(x[hold]), y[hold]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, np.where(t == 1, -logit, logit) / s)) for s in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, the network from labelled ones; ids with a null label or two different ones don't train.

    Context sums are whole numbers, so that they don't depend on the order of tasks.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    chosen = marked.select("id", "y").orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
    rows = runtime.materialize(rows.repartition(SAMPLE_TASKS), "quality-sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, into = index_vectors(), np.zeros((ENTRIES, DIMENSIONS), np.float64)
        for batch in batches:
            for part in runtime.slices(batch, 0):
                contexts([None if x is None else x.encode() for x in part.column(0).to_pylist()], index, into)
        yield pa.record_batch([pa.array([into.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(ENTRIES * DIMENSIONS, np.float64)
        for batch in batches:
            for one in batch.column(0):
                into += np.frombuffer(one.as_buffer(), np.float64)
        yield pa.record_batch([pa.array([into.tobytes()], pa.binary())], names=["sums"])

    context = np.zeros((ENTRIES, DIMENSIONS), np.float64)
    every = docs.select(F.col(text).alias("text")).mapInArrow(sums, "sums binary")
    for r in every.repartition(SAMPLE_TASKS).mapInArrow(added, "sums binary").toLocalIterator():
        context += np.frombuffer(r.sums, np.float64).reshape(ENTRIES, DIMENSIONS)
    vectors = word_vectors(index_vectors(), context.astype(np.float32)).astype(np.float32)
    sent = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runtime.slices(batch, 0):
                x = pooled([None if t is None else t.encode() for t in part.column(0).to_pylist()], sent.value)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], names=["x", "y"])

    got = sorted((r.x, r.y) for r in rows.mapInArrow(features, "x binary, y int").toLocalIterator())
    x = np.frombuffer(b"".join(a for a, _ in got), np.float32).reshape(len(got), 2 * DIMENSIONS + 3)
    return vectors, train(x, np.array([y for _, y in got], np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, replaced if it exists): the calibrated probability of label 1.

    A null or empty text is scored by its zero features.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    sent = spark.sparkContext.broadcast((vectors, net))
    rows = docs.drop("score")
    at = rows.columns.index(text)

    def make():
        vectors, net = sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            x = pooled([None if t is None else t.encode() for t in part.column(at).to_pylist()], vectors)
            return pa.record_batch([*part.columns, pa.array(net.probabilities(x.astype(np.float64)))], names=[*part.schema.names, "score"])

        return run

    return runtime.map_slices(rows, text, runtime.added(rows.schema, "score double"), make)
