"""Byte-level BPE by contiguous rank arrays.

A word's parts are held as boundaries and ids in short lists beside a list of
the ranks of adjacent pairs.  The least rank is looked up again and again, the
boundary in it deleted and the two neighbouring ranks refreshed.  Words over
``SHORT`` bytes use a heap over linked parts, so a long run costs n log n.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime
from .chunks import Decoder, PieceTable, text_bytes

SHORT = 64
_NONE = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


class RankArrayBPE:
    """Encodes and decodes as the file at ``path`` (a ``tokenizers`` JSON of byte-level BPE) says."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, to_byte = said["model"], {c: b for b, c in enumerate(byte_characters())}
        vocabulary: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = [vocabulary[c] for c in byte_characters()]
        self.rank = {vocabulary[a] << 24 | vocabulary[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        n = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for w, k in vocabulary.items():
            self.bytes[k] = bytes(to_byte[c] for c in w)
        for w, k in self.special.items():
            self.bytes[k] = w.encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.table = PieceTable(self.encode_pieces, self.special)
        self.decoder = Decoder(self.bytes)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, bounds = self.rank, list(range(len(ids) + 1))
        ranks = [rank.get(a << 24 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 24 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 24 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := rank.get(ids[left] << 24 | ids[right])) is not None:
                    heapq.heappush(heap, (s, left, ids[left], ids[right]))
        return [x for x, here in zip(ids, alive, strict=True) if here]

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        out, merge, words = [], self.merge, self.words
        for text in texts:
            if (found := words(text)) and len(found) == 1 and text not in self.special:
                out.append(merge(text.encode()))
                continue
            # words that repeat within the piece are merged once
            got, kept = [], {}
            for k, part in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
                if k % 2:
                    got.append(self.special[part])
                    continue
                for w in words(part):
                    if (ids := kept.get(w)) is None:
                        ids = kept[w] = merge(w.encode())
                    got += ids
            out.append(got)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        ids, ends = self.table.ids(*text_bytes(pa.array(texts, pa.large_string())))
        return [x.tobytes() for x in np.split(ids.astype("<u4"), ends[1:-1])] if texts else []

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, an id out of range gives nothing."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return self.decoder.texts(ids, np.array([0, len(ids)]))[0]


@lru_cache(maxsize=2)
def codec(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def encode_decode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, ids (binary, little-endian u32) and decoded.  A null text
    counts as empty: no ids, an empty text.  Rows stay one by one, repeated or
    null ids included; other columns are left out, so their names can't clash.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    kind = runtime.added(rows.select("doc_id").schema, "ids binary, decoded string")

    def make():
        c = codec(tokenizer)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = c.table.ids(*text_bytes(part.column(1)))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<u4").tobytes())])
            return pa.record_batch([part.column(0), packed.cast(pa.binary()), pa.array(c.decoder.texts(ids, ends), pa.string())], names=["doc_id", "ids", "decoded"])

        return run

    return runtime.map_slices(rows, "text", kind, make)
