"""Pattern graphs: automorphisms and the order constraints that break them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations, permutations


@dataclass(frozen=True)
class Pattern:
    """A connected simple pattern: edges between vertices numbered from 1."""

    name: str
    edges: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, name: str, edges: list[tuple[int, int]]) -> Pattern:
        names = sorted({v for e in edges for v in e})
        number = {v: k + 1 for k, v in enumerate(names)}
        return cls(name, tuple(sorted({(min(number[a], number[b]), max(number[a], number[b])) for a, b in edges if a != b})))

    @cached_property
    def vertices(self) -> tuple[int, ...]:
        return tuple(sorted({v for e in self.edges for v in e}))

    def neighbours(self, v: int) -> set[int]:
        return {a + b - v for a, b in self.edges if v in (a, b)}

    @cached_property
    def automorphisms(self) -> list[dict[int, int]]:
        """All permutations of the vertices that keep the edges."""
        known, vs = set(self.edges), self.vertices
        out = []
        for p in permutations(vs):
            m = dict(zip(vs, p, strict=True))
            if all((min(m[a], m[b]), max(m[a], m[b])) in known for a, b in self.edges):
                out.append(m)
        return out

    @cached_property
    def constraints(self) -> list[tuple[int, int]]:
        """Pairs (a, b), meaning a < b, that leave one match of each subgraph.

        The vertex of the largest orbit is made the least of its orbit and
        held fixed, until nothing but the identity is left.
        """
        group, out = self.automorphisms, []
        while len(group) > 1:
            orbits = {v: {m[v] for m in group} for v in self.vertices}
            v = max(self.vertices, key=lambda x: (len(orbits[x]), -x))
            out += [(v, u) for u in sorted(orbits[v] - {v})]
            group = [m for m in group if m[v] == v]
        return out


def clique(k: int) -> Pattern:
    return Pattern.of(f"{k}-clique", list(combinations(range(1, k + 1), 2)))


# The patterns that queries have names for.
PATTERNS = {
    "triangle": Pattern.of("triangle", [(1, 2), (1, 3), (2, 3)]),
    "square": Pattern.of("square", [(1, 2), (2, 3), (3, 4), (4, 1)]),
    "chordalsquare": Pattern.of("chordalsquare", [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3)]),
    "house": Pattern.of("house", [(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (2, 5)]),
    "solarsquare": Pattern.of("solarsquare", [(1, 2), (2, 3), (3, 4), (4, 1), (5, 1), (5, 2), (5, 3), (5, 4)]),
    "twintriangle": Pattern.of("twintriangle", [(1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (4, 5)]),
    "near5clique": Pattern.of("near5clique", [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 1), (5, 2)]),
    "tcsquare": Pattern.of("tcsquare", [(1, 2), (2, 3), (3, 4), (4, 5), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5)]),
    "quadtriangle": Pattern.of("quadtriangle", [(1, 2), (2, 3), (3, 4), (4, 5), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5)]),
    "4-clique": clique(4),
    "5-clique": clique(5),
    "6-clique": clique(6),
    "chordalhouse": Pattern.of("chordalhouse", [(1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (3, 5), (4, 5)]),
}

#: Short names of queries.
ALIASES = {"q1": "square", "q2": "chordalsquare", "q3": "clique", "q4": "house", "q5": "solarsquare", "q6": "twintriangle", "q7": "near5clique", "q8": "tcsquare", "q9": "quadtriangle"}
