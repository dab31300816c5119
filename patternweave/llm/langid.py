"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is the product of its
letters' vectors, permuted (rolled) once for each place from the end; a text
is the sum over its trigrams, a language the sum over its training texts.
Documents go to the language whose prototype has the greatest cosine.

A prototype is linear in the trigram counts, so training adds up counts in each
task and turns them into vectors at its end; vectors are then summed by
dimension with map-side sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

DIMENSIONS = 512
#: Letters share 63 symbols: a-z have their own, all others 37 by a hash; 0 is whatever isn't a letter.
SYMBOLS = 64
#: Prototypes are broadcast; more languages than this are refused.
MOST_LANGUAGES = 10_000
#: Steepness of the score over cosines.
SHARPNESS = 24.0


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x323B0):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37
    return out


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Products of the first two letters' vectors of each trigram, and the third letters' vectors."""
    base = np.random.default_rng(8).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))
    pair = np.roll(base, 2, axis=1)[:, None, :] * np.roll(base, 1, axis=1)[None, :, :]
    return pair.reshape(-1, DIMENSIONS), base


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hypervector of trigrams with counts."""
    pair, last = _letters()
    out = np.zeros(DIMENSIONS, np.float64)
    for k in range(0, len(grams), 8192):
        g = grams[k : k + 8192]
        out += counts[k : k + 8192].astype(np.float32) @ (pair[g >> 6] * last[g & 63])
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) for each letter of the texts with its two neighbours."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    s = _symbols()[points].astype(np.int32)
    middle = np.flatnonzero(s[1:-1]) + 1
    gram = s[middle - 1] << 12 | s[middle] << 6 | s[middle + 1]
    ends = np.cumsum(sizes)
    return np.searchsorted(ends, middle - 1, side="right"), gram


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language of rows whose text and language aren't null."""
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    languages = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the prototypes have no bound to broadcast them under")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = list(counts)
            vectors = [bundle(g := np.flatnonzero(counts[n]), counts[n][g]) for n in names]
            counts.clear()
            return pa.record_batch([pa.array(np.repeat(np.array(names, object), DIMENSIONS), pa.string()), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(names))), pa.array(np.rint(np.concatenate(vectors)).astype(np.int64))], names=["lang", "at", "value"])

        for batch in batches:
            for part in runtime.slices(batch, 0):
                langs = part.column(1).to_pylist()
                owner, gram = trigrams(part.column(0).to_pylist())
                code = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                own = np.array([code[x] for x in langs])[owner]
                for name, k in code.items():
                    got = np.bincount(gram[own == k], minlength=SYMBOLS**3)
                    counts[name] = counts[name] + got if name in counts else got
                    if len(counts) >= 16:
                        yield out()
        if counts:
            yield out()

    sums = rows.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r["at"]] = r.value
    return {k: found[k] for k in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and cosine of each row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Equal cosines go to the language that sorts first.
    """
    names = list(prototypes)
    matrix = np.array([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()]).reshape(-1, DIMENSIONS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = runtime.added(rows.select("doc_id").schema, "lang_pred string, score double, cosine double")

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in part.column(1).to_pylist()]
            owner, gram = trigrams(texts)
            key, count = np.unique(owner << 18 | gram, return_counts=True)
            edge = np.searchsorted(key >> 18, np.arange(len(texts) + 1))
            gram = key & (SYMBOLS**3 - 1)
            vectors = np.zeros((len(texts), DIMENSIONS))
            for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if a < b:
                    vectors[k] = bundle(gram[a:b], count[a:b])
            some = (edge[1:] > edge[:-1]) & bool(names)
            best, score, cosine = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            if names:
                c = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                best = c.argmax(1)
                top = c.max(1)
                score = np.where(some, 1 / np.exp(SHARPNESS * (c - top[:, None])).sum(1), 0.0)
                cosine = np.where(some, top, 0.0)
            langs = [names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            return pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(cosine)], names=schema.names)

        return run

    return runtime.map_slices(rows, "text", schema, make)
