"""Wedges (two edges with a centre), stars and triangles over oriented edges (u < w)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def twin_twig(oriented: DataFrame, kind: int) -> DataFrame:
    """Wedges (x, y, z), x < y around centre z: 1 the centre is least, 2 it stands between, 3 it is greatest."""
    a, b = oriented.alias("a"), oriented.alias("b")
    if kind == 1:
        on, cols = (F.col("a.u") == F.col("b.u")) & (F.col("a.w") < F.col("b.w")), ("a.w", "b.w", "a.u")
    elif kind == 2:
        on, cols = F.col("a.w") == F.col("b.u"), ("a.u", "b.w", "a.w")
    else:
        on, cols = (F.col("a.w") == F.col("b.w")) & (F.col("a.u") < F.col("b.u")), ("a.u", "b.u", "a.w")
    return a.join(b, on).select(*(F.col(c).alias(n) for c, n in zip(cols, "xyz", strict=True)))


def wedges(oriented: DataFrame) -> DataFrame:
    """All wedges, of the three kinds."""
    return reduce(DataFrame.union, (twin_twig(oriented, k) for k in (1, 2, 3)))


def distinct_twin_twigs(oriented: DataFrame) -> DataFrame:
    """(x, y, times): pairs of ends of wedges with least centre, with their number."""
    return twin_twig(oriented, 1).groupBy("x", "y").agg(F.count("*").alias("times"))


def stars(oriented: DataFrame, leaves: int) -> DataFrame:
    """(c, l1 .. lk): a centre and ``leaves`` of its larger neighbours, ascending."""
    out = oriented.select(F.col("u").alias("c"), F.col("w").alias("l1"))
    for k in range(2, leaves + 1):
        more = oriented.select(F.col("u").alias("c"), F.col("w").alias(f"l{k}"))
        out = out.join(more, "c").where(F.col(f"l{k - 1}") < F.col(f"l{k}"))
    return out


def triangles(oriented: DataFrame) -> DataFrame:
    """(v1, v2, v3), ascending: wedges with least centre whose ends are an edge."""
    ends = twin_twig(oriented, 1)
    return ends.join(oriented.select(F.col("u").alias("x"), F.col("w").alias("y")), ["x", "y"]).select(F.col("z").alias("v1"), F.col("x").alias("v2"), F.col("y").alias("v3"))


def edge_apexes(tri: DataFrame) -> DataFrame:
    """(x, y, z): each triangle from each of its edges x < y, with the third vertex."""
    return tri.selectExpr("stack(3, v2, v3, v1, v1, v3, v2, v1, v2, v3) as (x, y, z)")


def vertex_pairs(tri: DataFrame) -> DataFrame:
    """(c, a, b): each triangle from each of its vertices, a < b the others."""
    return tri.selectExpr("stack(3, v1, v2, v3, v2, v1, v3, v3, v1, v2) as (c, a, b)")
