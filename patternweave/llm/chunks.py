"""Token ids of whole texts from the ids of their pieces, as numpy arrays.

Byte-level pre-tokenization lets no token hold a blank that follows a
non-blank, nor both a letter and a mark or a digit (an apostrophe before a
letter apart).  A text may therefore be cut at such places, and its ids are
those of its pieces, one after the other.  Pieces repeat: each different one is
encoded once and kept in a hash table whose keys are compared by content.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import mix

#: Pieces that a worker keeps (then it begins anew), and the bytes of the longest piece that is kept.
KEPT, LONGEST = 1 << 20, 64

_BLANK, _LETTER, _DIGIT, _MARK, _QUOTE, _HIGH = 1, 2, 3, 4, 5, 6
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


def _classes() -> np.ndarray:
    """The class of each byte; control characters count as high bytes, beside which nothing is cut."""
    out = np.full(256, _HIGH, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[33:127] = _MARK
    out[39] = _QUOTE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    return out


def _cuts() -> np.ndarray:
    """Whether a text may be cut between bytes of two classes (7 * left + right)."""
    out = np.zeros(49, bool)
    for left in (_LETTER, _DIGIT, _MARK, _QUOTE):
        out[7 * left + _BLANK] = True
    for left, right in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT)):
        out[7 * left + right] = True
    return out


_CLASS, _CUT = _classes(), _cuts()
#: Last bytes of the blanks outside ASCII; after these a blank is not cut off, unless the character is of two bytes that begin with C3 (a letter).
_ODD = np.zeros(256, bool)
_ODD[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and where each text begins (one more entry than texts)."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    first, last = int(ends[0]), int(ends[-1])
    return (np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)), ends - first


def piece_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that stand one after the other; none reaches over the end of a text."""
    kind = _CLASS[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _CUT[kind[:-1] * np.uint8(7) + kind[1:]]
    # a blank after a character that isn't ASCII: cut unless that may be a blank itself
    high = np.flatnonzero((kind[1:] == _BLANK) & (raw[:-1] >= 128)) + 1
    cut[high[~_ODD[raw[high - 1]] | (raw[high - 2] == 0xC3)]] = True
    starts = ends[:-1]
    cut[starts[starts < len(raw)]] = True
    return np.flatnonzero(cut)


class PieceTable:
    """``encode`` gives the ids of texts; those of pieces are kept in an open hash table."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: Iterable[str] = ()):
        self.encode = encode
        #: Texts that hold any of these are not cut: they are tokens wherever they stand.
        self.special = [s.encode() for s in special]
        self._clear()

    def _clear(self) -> None:
        self.size, self.tokens = 0, 0
        self.slots = np.full(1 << 14, -1, np.int32)
        self.key, self.low, self.high = (np.zeros(1 << 12, np.uint64) for _ in range(3))
        self.length, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.store = np.zeros(1 << 14, np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        out = np.full(len(key), -1, np.int64)
        left, slot, wrap = np.arange(len(key)), self._slot(key), len(self.slots) - 1
        while len(left):
            entry = self.slots[slot]
            there = entry >= 0
            left, slot, entry = left[there], slot[there], entry[there]
            hit = (self.key[entry] == key[left]) & (self.low[entry] == low[left]) & (self.high[entry] == high[left]) & (self.length[entry] == length[left])
            out[left[hit]] = entry[hit]
            left, slot = left[~hit], (slot[~hit] + 1) & wrap
        return out

    def _place(self, entries: np.ndarray) -> None:
        """Put entries, all different, into free slots."""
        wrap, slot = len(self.slots) - 1, self._slot(self.key[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # of several on a slot the last one stays
            missed = self.slots[slot] != entries
            entries, slot = entries[missed], (slot[missed] + 1) & wrap

    def _add(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        n, first = len(key), self.size
        counts = np.fromiter(map(len, ids), np.int64, n)
        tokens = int(counts.sum())
        for name, more in (("key", n), ("low", n), ("high", n), ("length", n), ("count", n), ("at", n), ("store", tokens)):
            old = getattr(self, name)
            used = self.tokens if name == "store" else first
            if used + more > len(old):
                new = np.zeros(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        part = slice(first, first + n)
        self.key[part], self.low[part], self.high[part], self.length[part], self.count[part] = key, low, high, length, counts
        self.at[part] = self.tokens + np.cumsum(counts) - counts
        self.store[self.tokens : self.tokens + tokens] = np.fromiter(chain.from_iterable(ids), np.uint32, tokens)
        self.size, self.tokens = first + n, self.tokens + tokens
        added = np.arange(first, first + n, dtype=np.int32)
        if 2 * self.size > len(self.slots):
            self.slots = np.full(1 << (4 * self.size - 1).bit_length(), -1, np.int32)
            added = np.arange(self.size, dtype=np.int32)
        self._place(added)
        return np.arange(first, first + n)

    def ids(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (one more entry than texts)."""
        starts = piece_starts(raw, ends)
        whole = raw.tobytes() if self.special else b""
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                k = int(np.searchsorted(ends, at, side="right")) - 1
                starts = starts[(starts <= ends[k]) | (starts >= ends[k + 1])]
                at = whole.find(s, int(ends[k + 1]))
        length = np.diff(np.concatenate((starts, [len(raw)])))
        low, high, key = self._keys(raw, starts, length)
        if self.size > KEPT:
            self._clear()
        entry = self._find(key, low, high, length)
        new = np.flatnonzero((entry < 0) & (length <= LONGEST))
        if len(new):
            # of equal pieces the first is encoded; two different ones of one hash are told apart by their content
            order = new[np.lexsort((length[new], high[new], low[new], key[new]))]
            head = np.ones(len(order), bool)
            a, b = order[1:], order[:-1]
            head[1:] = (key[a] != key[b]) | (low[a] != low[b]) | (high[a] != high[b]) | (length[a] != length[b])
            first = order[head]
            made = self._add(key[first], low[first], high[first], length[first], self._encode(raw, starts[first], length[first]))
            entry[order] = made[np.cumsum(head) - 1]
        count, at, store = self.count[entry].astype(np.int64), self.at[entry], self.store
        long = np.flatnonzero(length > LONGEST)
        if len(long):
            ids = [np.array(x, np.uint32) for x in self._encode(raw, starts[long], length[long])]
            count[long] = [len(x) for x in ids]
            at[long] = self.tokens + np.cumsum(count[long]) - count[long]
            store = np.concatenate((store[: self.tokens], *ids))
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = store[np.repeat(at - upto[:-1], count) + np.arange(int(upto[-1]))]
        return flat, upto[np.searchsorted(starts, ends)]

    def _encode(self, raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> list[list[int]]:
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(starts.tolist(), (starts + length).tolist(), strict=True)]
        # the collector would walk through all the lists of ids and find nothing
        gc.disable()
        try:
            return self.encode(texts)
        finally:
            gc.enable()

    @staticmethod
    def _keys(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and the next eight bytes of each piece, and a hash of all of it.

        Up to 16 bytes these and the length are the piece itself; the hash
        takes in the bytes after, eight at a time.
        """
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
        low = eight[starts] & _KEEP[np.minimum(length, 8)]
        high = np.zeros(len(starts), np.uint64)
        key = mix(low * _ONE + length.astype(np.uint64))
        left, done = np.flatnonzero(length > 8), 8
        while len(left) and done < LONGEST:
            part = eight[starts[left] + done] & _KEEP[np.minimum(length[left] - done, 8)]
            if done == 8:
                high[left] = part
            key[left] = mix((key[left] ^ part) * _TWO + np.uint64(done))
            done += 8
            left = left[length[left] > done]
        return low, high, key


class Decoder:
    """The bytes of token ids, as one array; ``words`` holds each id's bytes."""

    def __init__(self, words: list[bytes]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words) + b"\0", np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids that stand one after the other; bytes that aren't UTF-8 become U+FFFD, an id out of range gives nothing."""
        known = ids < len(self.length)
        ids = np.where(known, ids, 0)
        n = np.where(known, self.length[ids], 0)
        upto = np.concatenate(([0], np.cumsum(n)))
        data = self.bytes[np.repeat(self.at[ids] - upto[:-1], n) + np.arange(int(upto[-1]))].tobytes()
        edge = upto[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]  # noqa: B905
