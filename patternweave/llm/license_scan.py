"""Licence scans with a generalised suffix automaton.

The automaton holds every substring of every template, over words.  A document
streams through it once; at each word it gives the length of the longest
template substring that ends there (the matching statistics).  Matches that
can't be longer are chained in the order of document and template, and a chain
that covers enough of a template names its licence.

Base phrases are templates too: one stands wherever the current match ends in
its state or in a state whose suffix links lead there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import Words, alphanumeric

# Phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening words of public licence notices.
TEMPLATES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "released under the mit license"],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
    "gpl-2": ["licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"],
    "lgpl-3": ["licensed under the gnu lesser general public license version 3"],
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
}
#: Runs of words that tell a licence from its kin: a chain names a template only if matches hold those that stand in it unbroken.
TELLING = {
    "gpl-3": ["gnu general", "version 3"],
    "gpl-2": ["gnu general", "version 2"],
    "lgpl-3": ["gnu lesser general", "version 3"],
    "agpl-3": ["gnu affero general", "version 3"],
    "cc-by": ["attribution 4", "by 4"],
    "cc-by-nc": ["attribution noncommercial", "by nc"],
    "cc-by-sa": ["attribution sharealike", "by sa"],
}
#: Words of the shortest match that is chained, most words skipped between two of a chain, least share of a template.
LEAST, GAP, SHARE = 3, 6, 0.8

_TABLE = alphanumeric()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: (template, end) of the places where the state's strings end
    ends: list[tuple[int, int]] = field(default_factory=list)
    #: base phrases that end here, with their numbers of words
    base: list[tuple[int, int]] = field(default_factory=list)


class Automaton:
    """A generalised suffix automaton of templates (lists of word numbers)."""

    def __init__(self, templates: list[list[int]], phrases: list[int]):
        self.states = [State(0)]
        own = []
        for t, words in enumerate(templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.states[last].ends.append((t, at + 1))
            own.append(last)
        order = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in order:
            up = self.states[self.states[s].link]
            if self.states[s].link:
                up.ends.extend(self.states[s].ends)
        for s in reversed(order):
            if (up := self.states[s].link) > 0:
                self.states[s].base.extend(self.states[up].base)
            self.states[s].base.extend((t, len(templates[t])) for t in phrases if own[t] == s)
        for s in self.states:
            s.ends = sorted(set(s.ends))

    def _extend(self, last: int, w: int) -> int:
        states = self.states
        if (q := states[last].next.get(w)) is not None:
            return q if states[q].length == states[last].length + 1 else self._clone(last, w, q)
        new = len(states)
        states.append(State(states[last].length + 1))
        p = last
        while p >= 0 and w not in states[p].next:
            states[p].next[w] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].next[w]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        states = self.states
        copy = len(states)
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = copy
        while p >= 0 and states[p].next.get(w) == q:
            states[p].next[w] = copy
            p = states[p].link
        return copy

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(start, phrase) of each base phrase; (end, length, state) of each match that the next word doesn't prolong."""
        found, matches = [], []
        states, s, length = self.states, 0, 0
        for at, w in enumerate(words):
            if w not in states[s].next and length >= LEAST:
                matches.append((at, length, s))
            while s and w not in states[s].next:
                s = states[s].link
                length = states[s].length
            if w in states[s].next:
                s = states[s].next[w]
                length += 1
            for t, n in states[s].base:
                if n <= length:
                    found.append((at + 1 - n, t))
        if length >= LEAST:
            matches.append((len(words), length, s))
        return found, matches


class Scanner:
    def __init__(self) -> None:
        texts = [*BASE, *(x for v in TEMPLATES.values() for x in v)]
        self.labels = [*BASE.values(), *(k for k, v in TEMPLATES.items() for _ in v)]
        number: dict[str, int] = {}
        self.templates = [[number.setdefault(w, len(number) + 1) for w in t.split(" ")] for t in texts]
        #: of each template the places (first, end) of its telling runs
        self.telling = [[(i, i + len(r)) for r in map(str.split, TELLING.get(label, [])) for i in range(len(w)) if w[i : i + len(r)] == r] for label, w in zip(self.labels, (t.split(" ") for t in texts), strict=True)]
        self.automaton = Automaton(self.templates, list(range(len(BASE))))
        hashes = Words([w.encode() for w in number], _TABLE).hashes()
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], (np.array(list(number.values())))[order]
        self.near = np.zeros(1 << 16, bool)
        self.near[self.keys >> np.uint64(48)] = True

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, float, bool]]]:
        """Of each template: (first word, end, share covered, whether its telling runs are held) of its chains."""
        places: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, s in matches:
            for t, at in self.automaton.states[s].ends:
                places.setdefault(t, []).append((end - length, at - length, length))
        out: dict[int, list[tuple[int, int, float]]] = {}
        for t, runs in places.items():
            chain: list[tuple[int, int, int]] = []
            best: list[tuple[int, int, float, bool]] = []

            def close(t=t, chain=chain, best=best) -> None:
                if chain:
                    covered, upto = 0, 0
                    for _, a, n in chain:
                        covered += max(0, a + n - max(a, upto))
                        upto = max(upto, a + n)
                    told = all(any(i <= x and y <= i + n for _, i, n in chain) for x, y in self.telling[t])
                    best.append((chain[0][0], chain[-1][0] + chain[-1][2], covered / len(self.templates[t]), told))
                    chain.clear()

            for run in sorted(runs):
                if chain and (run[0] > chain[-1][0] + chain[-1][2] + GAP or run[1] < chain[-1][1]):
                    close()
                chain.append(run)
            close()
            out[t] = best
        return out

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float, bool]]]]:
        """Of each text: number of words, base places (start, label), covered spans (label, first word, end, share, told apart)."""
        words = Words(texts, _TABLE)
        hashes = words.hashes()
        ids = np.zeros(len(hashes) + 1, np.int64)
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        ids[maybe] = np.where(self.keys[at] == hashes[maybe], self.numbers[at], 0)
        # runs of template words within a text; shorter ones than any phrase or match can't count
        known = ids[:-1] > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1] | (words.doc[1:] != words.doc[:-1])
        first = np.flatnonzero(begin)
        stop = np.concatenate((np.flatnonzero(known[:-1] & (~known[1:] | begin[1:])) + 1, [len(known)] if len(known) and known[-1] else [])).astype(int)
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        matches: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            if b - a < LEAST:
                continue
            k = int(words.doc[a])
            ahead = a - int(words.first[k])
            got, runs = self.automaton.scan(ids[a:b].tolist())
            base[k].extend((ahead + s, self.labels[t]) for s, t in got)
            matches[k].extend((ahead + e, n, s) for e, n, s in runs)
        out = []
        for k, n in enumerate(np.diff(words.first).tolist()):
            spans = [(self.labels[t], *x) for t, c in self.chains(matches[k]).items() for x in c] if matches[k] else []
            out.append((n, sorted(base[k]), spans))
        return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base (array of start, label), spans (array of label, first, end, share), score.

    ``spans`` are the chains that cover ``SHARE`` of a template and hold its telling runs; ``score`` is
    the greatest share of any chain (1 at most).  A null text has no words.
    Rows stay one by one; other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = runtime.added(rows.select("doc_id").schema, "n_words long, base array<struct<start:long,label:string>>, spans array<struct<label:string,first:long,end:long,share:double>>, score double")
    base = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def make():
        s = scanner()

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            got = s.scan([None if x is None else x.encode() for x in part.column(1).to_pylist()])
            return pa.record_batch(
                [
                    part.column(0),
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[{"start": a, "label": x} for a, x in b] for _, b, _ in got], base),
                    pa.array([[{"label": x, "first": a, "end": e, "share": q} for x, a, e, q, told in c if told and q >= SHARE] for _, _, c in got], spans),
                    pa.array([min(1.0, max([0.0, *(q for *_, q, _ in c)])) for _, _, c in got], pa.float64()),
                ],
                names=schema.names,
            )

        return run

    return runtime.map_slices(rows, "text", schema, make)
