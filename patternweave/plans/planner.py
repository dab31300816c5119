"""Any pattern as joins: decomposition into stars and cliques by estimated cost, then DataFrame joins.

Estimates come from the degrees of the graph at hand.  The planner looks at
connected parts of the pattern as sets of edges; a part is a join unit or the
join of two smaller parts, and the cheapest way for the whole pattern is found
by dynamic programming.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import cliques, patterns
from ..operators.prepare import power_sums
from .patterns import Pattern

Edges = frozenset[tuple[int, int]]

#: Relative costs of sending a row, of reading a stored one, and of making one by a join.
SEND, STORED, JOINED = 3.0, 1.0, 2.0


@dataclass(frozen=True)
class Moments:
    """Sums of powers of degrees: ``sums[i]`` is the sum of the i-th powers."""

    sums: tuple[float, ...]

    @classmethod
    def of(cls, g: Graph, upto: int = 8) -> Moments:
        rows = power_sums(g.degrees, upto).orderBy("i").collect()
        return cls(tuple(float(r.total or 0.0) for r in rows))

    @property
    def vertices(self) -> float:
        return max(self.sums[0], 1.0)

    @property
    def ends(self) -> float:
        """Twice the number of edges."""
        return max(self.sums[1], 1.0)

    def grown(self, d: int) -> float:
        """Expected further edges at a vertex that is met by d edges."""
        d = min(d, len(self.sums) - 2)
        return self.sums[d + 1] / max(self.sums[d], 1e-9)

    def closed(self, d1: int, d2: int) -> float:
        """Chance that two vertices met by d1 and d2 edges are an edge."""
        return min(1.0, self.grown(d1) * self.grown(d2) / self.ends)


def vertices_of(edges: Edges) -> set[int]:
    return {v for e in edges for v in e}


def is_connected(edges: Edges) -> bool:
    left, seen = set(edges), set(next(iter(edges)))
    while True:
        touching = {e for e in left if e[0] in seen or e[1] in seen}
        if not touching:
            return not left
        left -= touching
        seen |= vertices_of(frozenset(touching))


def is_star(edges: Edges) -> bool:
    return any(all(v in e for e in edges) for v in vertices_of(edges))


def is_clique(edges: Edges) -> bool:
    n = len(vertices_of(edges))
    return len(edges) == n * (n - 1) // 2


def is_core(edges: Edges) -> bool:
    """One vertex is joined to all others (a local graph of that vertex)."""
    vs = vertices_of(edges)
    return any(sum(v in e for e in edges) == len(vs) - 1 for v in vs)


def is_square(edges: Edges) -> bool:
    return len(edges) == len(vertices_of(edges)) == 4 and all(sum(v in e for e in edges) == 2 for v in vertices_of(edges)) and is_connected(edges)


#: What a join unit may be.
UNITS = {"star": is_star, "local": is_core, "clique": lambda e: is_star(e) or is_clique(e)}


def label(edges: Edges) -> str:
    """The sorted edges as text: equal for equal sets, not for isomorphic ones."""
    return ",".join(f"{a}-{b}" for a, b in sorted(edges))


def estimate(edges: Edges, m: Moments, model: str = "power_law") -> float:
    """Expected matches of a part: uniform random edges, or degrees as they are.

    With degrees, edges are taken in depth-first order; one that reaches a new
    vertex multiplies by its expected further edges, one that closes a cycle by
    the chance that its ends are joined.
    """
    n, k = len(vertices_of(edges)), len(edges)
    if model == "uniform":
        return m.ends**k / m.vertices ** (2 * k - n)
    order, seen, met = [], set(), dict.fromkeys(vertices_of(edges), 0)
    first = min(vertices_of(edges))
    out, left, stack = m.vertices, set(edges), [first]
    seen.add(first)
    while stack:
        v = stack[-1]
        nxt = next((e for e in sorted(left) if v in e), None)
        if nxt is None:
            stack.pop()
            continue
        left.discard(nxt)
        w = nxt[0] + nxt[1] - v
        out *= m.closed(met[v], met[w]) if w in seen else m.grown(met[v])
        met[v] += 1
        met[w] += 1
        order.append(nxt)
        if w not in seen:
            seen.add(w)
            stack.append(w)
    return out


@dataclass(frozen=True)
class Step:
    """A join unit, or the join of two steps."""

    edges: Edges
    cost: float
    rows: float
    left: Step | None = None
    right: Step | None = None

    def lines(self, depth: int = 0) -> list[str]:
        kind = "join" if self.left else "square" if is_square(self.edges) else "clique" if is_clique(self.edges) and len(self.edges) > 1 else "star" if is_star(self.edges) else "local"
        out = ["  " * depth + f"{kind} [{label(self.edges)}] rows={self.rows:.4g} cost={self.cost:.4g}"]
        for s in (self.left, self.right):
            if s is not None:
                out += s.lines(depth + 1)
        return out


def connected_parts(pattern: Pattern) -> list[Edges]:
    """All connected sets of edges, smaller ones first."""
    return [frozenset(c) for k in range(1, len(pattern.edges) + 1) for c in combinations(pattern.edges, k) if is_connected(frozenset(c))]


def minus(whole: Edges, part: Edges, unit: str = "star") -> Edges:
    """What is left of ``whole`` without ``part``; for units that may overlap, edges of ``part`` whose ends both stay come back."""
    rest = whole - part
    if unit == "star" or not rest:
        return rest
    vs = vertices_of(rest)
    back = frozenset(e for e in part if e[0] in vs and e[1] in vs)
    return rest | back if rest | back != whole else rest


def decompose(pattern: Pattern, m: Moments, unit: str = "clique", model: str = "power_law", squares: bool = False) -> Step:
    """The cheapest plan; ``unit``: star, local (one vertex sees all others) or clique (or star); ``squares`` are units too."""
    allowed = (lambda e: UNITS[unit](e) or is_square(e)) if squares else UNITS[unit]
    rows = cache(lambda e: estimate(e, m, model))

    @cache
    def best(edges: Edges) -> Step | None:
        n = rows(edges)
        out = Step(edges, n * STORED, n) if allowed(edges) else None
        for k in range(max(1, len(edges) // 2 + len(edges) % 2), len(edges)):
            for c in combinations(sorted(edges), k):
                left = frozenset(c)
                right = minus(edges, left, unit)
                if not is_connected(left) or not is_connected(right) or len(right) >= len(edges) or not vertices_of(left) & vertices_of(right):
                    continue
                a, b = best(left), best(right)
                if a is None or b is None:
                    continue
                sent = a.rows + b.rows
                cost = a.cost + b.cost + SEND * sent + JOINED * n + 0.1 * sent * math.log2(sent + 2)
                if out is None or cost < out.cost:
                    out = Step(edges, cost, n, a, b)
        return out

    found = best(frozenset(pattern.edges))
    if found is None:
        raise ValueError(f"no plan for {pattern.name} with {unit} units")
    return found


def _constrained(df: DataFrame, constraints: list[tuple[int, int]], known: set[tuple[int, int]], edges: Edges) -> DataFrame:
    """Apply order constraints and injectivity over the columns at hand, each as soon as both ends are there."""
    have = sorted(int(c[1:]) for c in df.columns)
    for a, b in combinations(have, 2):
        if (a, b) in known:
            continue
        known.add((a, b))
        if (a, b) in constraints:
            df = df.where(F.col(f"v{a}") < F.col(f"v{b}"))
        elif (b, a) in constraints:
            df = df.where(F.col(f"v{b}") < F.col(f"v{a}"))
        elif (a, b) not in edges:
            df = df.where(F.col(f"v{a}") != F.col(f"v{b}"))
    return df


def _placed(rows: DataFrame, vs: list[int], placings: list[tuple[int, ...]]) -> DataFrame:
    """Rows (v1 .. vk) with pattern vertex ``vs[i]`` at column ``p[i]``, for each placing p."""
    cells = ", ".join(f"v{i}" for p in placings for i in p)
    return rows.selectExpr(f"stack({len(placings)}, {cells}) as ({', '.join(f'v{v}' for v in vs)})")


def _unit(g: Graph, edges: Edges, constraints: list[tuple[int, int]]) -> tuple[DataFrame, set[tuple[int, int]]]:
    """Matches of a join unit: placed cliques and squares, others edge by edge over the adjacency.

    There an edge between known vertices is a semi-join.
    """
    known: set[tuple[int, int]] = set()
    vs = sorted(vertices_of(edges))
    if len(vs) > 2 and is_clique(edges):
        # the columns of a clique ascend, so the order alone tells which placings meet the constraints
        placings = [p for p in permutations(range(1, len(vs) + 1)) if all(p[vs.index(a)] < p[vs.index(b)] for a, b in constraints if a in vs and b in vs)]
        return _constrained(_placed(cliques.cliques(g, len(vs)), vs, placings), constraints, known, frozenset(edges)), known
    if is_square(edges):
        joined = lambda a, b: (min(a, b), max(a, b)) in edges
        placings = [p for p in permutations(range(1, 5)) if all(joined(a, b) == (abs(p[i] - p[j]) != 2) for (i, a), (j, b) in combinations(enumerate(vs), 2))]
        return _constrained(_placed(patterns.squares(g), vs, placings), constraints, known, frozenset(edges)), known
    left = set(edges)
    centre = max(vertices_of(edges), key=lambda v: (sum(v in e for e in edges), -v))
    out, have = None, {centre}
    while left:
        closing = sorted(e for e in left if e[0] in have and e[1] in have)
        if closing and out is not None:
            a, b = closing[0]
            out = out.join(g.adjacent.select(F.col("v").alias(f"v{a}"), F.col("n").alias(f"v{b}")), [f"v{a}", f"v{b}"], "left_semi")
            left.discard((a, b))
            continue
        e = min((e for e in left if e[0] in have or e[1] in have), key=lambda e: (centre not in e, e))
        a, b = (e[0], e[1]) if e[0] in have else (e[1], e[0])
        more = g.adjacent.select(F.col("v").alias(f"v{a}"), F.col("n").alias(f"v{b}"))
        out = more if out is None else out.join(more, f"v{a}")
        have.add(b)
        left.discard(e)
        out = _constrained(out, constraints, known, frozenset(edges))
    return out, known


def match(g: Graph, pattern: Pattern, step: Step | None = None, unit: str = "clique") -> DataFrame:
    """(v1 .. vk): each subgraph of ``g`` that is isomorphic to ``pattern``, once; extra edges may be there."""
    step = step or decompose(pattern, Moments.of(g), unit, squares=unit == "clique")
    constraints = pattern.constraints

    def build(s: Step) -> tuple[DataFrame, set[tuple[int, int]]]:
        if s.left is None:
            return _unit(g, s.edges, constraints)
        (a, known_a), (b, known_b) = build(s.left), build(s.right)
        known = known_a | known_b
        joined = a.join(b, [c for c in a.columns if c in b.columns])
        return _constrained(joined, constraints, known, frozenset(pattern.edges)), known

    out, _ = build(step)
    return out.select(*[f"v{v}" for v in pattern.vertices])
