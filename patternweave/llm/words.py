"""Words of whole texts as numpy arrays, straight from the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes whose hashes are taken at once (a longer word is taken whole).
PART = 1 << 21
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Lower-cases A-Z alone, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def alphanumeric() -> np.ndarray:
    """Bytes of words after lower-casing: 0-9, a-z and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def not_blank() -> np.ndarray:
    """All bytes but space and 09-0D."""
    table = np.ones(256, bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts.

    ``raw`` joins the texts' lower-cased bytes by line feeds; ``start`` and
    ``end`` are byte positions of words there, ``doc`` the text of each word,
    ``first`` the number of the first word of each text (one more entry than
    texts).  A null text has no words.
    """

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool = True):
        texts = [t or b"" for t in texts]
        self.n = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = LOWER[raw] if lower else raw
        inside = table[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        #: byte position of each text in ``raw``
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_at)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; taken over ``PART`` bytes at a time, so a very long text needs no more memory."""
        out = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(out):
            j = max(k + 1, int(np.searchsorted(self.end, self.start[k] + PART, side="right")))
            base = self.start[k]
            raw, start, end = self.raw[base : self.end[j - 1]], self.start[k:j] - base, self.end[k:j] - base
            powers, inverses = _powers_to(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=total[1:])
            out[k:j] = mix((total[end] - total[start]) * inverses[start] + (end - start).astype(np.uint64))
            k = j
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` entries, by its start; the caller drops runs over a text's end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for i in range(n):
        out = out * step + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
