"""Cliques from stars: the star of the least vertex, then a smaller star for each next vertex."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.wedges import stars


def cliques(g: Graph, k: int, bottom_up: bool = False) -> DataFrame:
    """(v1 .. vk), ascending.

    Top-down joins the star with k - 1 leaves to those with k - 2, k - 3, ...
    leaves on all their vertices.  Bottom-up begins with the last edge and adds
    a star at a time in front of it.
    """
    if k < 3:
        raise ValueError("stars make cliques of 3 vertices or more")

    def star(first: int) -> DataFrame:
        names = [f"v{i}" for i in range(first, k + 1)]
        made = stars(g.oriented, k - first)
        return made.select(*(F.col(c).alias(n) for c, n in zip(made.columns, names, strict=True)))

    order = range(k - 1, 0, -1) if bottom_up else range(1, k)
    parts = [star(i) for i in order]
    names = [f"v{i}" for i in range(1, k + 1)]
    if bottom_up:
        return reduce(lambda out, s: s.join(out, out.columns), parts).select(*names)
    return reduce(lambda out, s: out.join(s, s.columns, "left_semi"), parts).select(*names)
