"""The same patterns from wedges (twin twigs) alone, edge by edge: plans that check the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.patterns import centre_pairs, square_sides, squares
from ..operators.wedges import twin_twig


def _edge(g: Graph, x: str, y: str) -> DataFrame:
    return g.oriented.select(F.col("u").alias(x), F.col("w").alias(y))


def square_counts(g: Graph) -> DataFrame:
    """(x, y, n1, n23): wedges with least centre, and others, by their ends.  Squares: n1 * n23 + n1 choose 2."""
    tagged = twin_twig(g.oriented, 1).withColumn("one", F.lit(1)).union(twin_twig(g.oriented, 2).withColumn("one", F.lit(0))).union(twin_twig(g.oriented, 3).withColumn("one", F.lit(0)))
    return tagged.groupBy("x", "y").agg(F.sum("one").alias("n1"), F.sum(1 - F.col("one")).alias("n23")).where("n1 > 0")


def chordal_squares(g: Graph) -> DataFrame:
    """Two wedges on the same ends, of those whose ends are an edge."""
    lists = g.met.join(_edge(g, "x", "y"), ["x", "y"], "left_semi")
    return centre_pairs(lists).withColumnsRenamed({"z": "p", "c": "q"})


def cliques(g: Graph, k: int) -> DataFrame:
    """(v1 .. vk), 4 to 6 vertices: wedges at the least vertex are joined on shared ends, then the ends' edges."""
    if k not in (4, 5, 6):
        raise ValueError("wedge plans cover cliques of 4, 5 and 6 vertices")
    twig = twin_twig(g.oriented, 1)
    out = twig.select(F.col("z").alias("v1"), F.col("x").alias("v2"), F.col("y").alias("v3"))
    for n in range(4, k + 1):
        out = out.join(twig.select(F.col("z").alias("v1"), F.col("x").alias(f"v{n - 1}"), F.col("y").alias(f"v{n}")), ["v1", f"v{n - 1}"])
    # what is left are the edges among v2 .. vk, two at a time as wedges at the lesser end where there are two
    for a in range(2, k):
        ends = list(range(a + 1, k + 1))
        while ends:
            if len(ends) >= 2:
                b, c = ends[:2]
                out = out.join(twig.select(F.col("z").alias(f"v{a}"), F.col("x").alias(f"v{b}"), F.col("y").alias(f"v{c}")), [f"v{a}", f"v{b}", f"v{c}"], "left_semi")
                ends = ends[2:]
            else:
                out = out.join(_edge(g, f"v{a}", f"v{ends[0]}"), [f"v{a}", f"v{ends[0]}"], "left_semi")
                ends = []
    return out.select(*[f"v{i}" for i in range(1, k + 1)])


def houses(g: Graph) -> DataFrame:
    """Sides of squares and wedges over them."""
    return square_sides(squares(g)).join(g.wedges.withColumnRenamed("z", "apex"), ["x", "y"]).where("apex <> o1 and apex <> o2")


def solar_squares(g: Graph) -> DataFrame:
    """A square, a wedge over v1 and v3, and two semi-joins for the hub's other edges.

    Either diagonal has the hub and two corners for centres, so only wedges on ends that others share are looked at.
    """
    sq, met = squares(g), g.met.select("x", "y", F.explode("mids").alias("hub"))
    diagonal = sq.select("*", F.least("v1", "v3").alias("x"), F.greatest("v1", "v3").alias("y")).join(met, ["x", "y"]).where("hub <> v2 and hub <> v4")
    return diagonal.join(met.withColumnsRenamed({"x": "v2", "y": "v4"}), ["v2", "v4", "hub"], "left_semi").select("hub", "v1", "v2", "v3", "v4")


def twin_triangles(g: Graph) -> DataFrame:
    """A triangle, a wedge at one of its vertices, and the wedge's ends' edge."""
    from ..operators.wedges import vertex_pairs

    t = vertex_pairs(g.triangles)
    w = g.wedges.select(F.col("z").alias("c"), F.col("x").alias("p"), F.col("y").alias("q"))
    return t.join(w, "c").where("a < p and b <> p and b <> q").join(_edge(g, "p", "q"), ["p", "q"], "left_semi").select("c", "a", "b", "p", "q")


def near_5_cliques(g: Graph) -> DataFrame:
    """4-cliques from wedges, and wedges over their edges."""
    sides = cliques(g, 4).selectExpr("stack(6, v1, v2, v3, v4, v1, v3, v2, v4, v1, v4, v2, v3, v2, v3, v1, v4, v2, v4, v1, v3, v3, v4, v1, v2) as (x, y, o1, o2)")
    return sides.join(g.wedges.withColumnRenamed("z", "apex"), ["x", "y"]).where("apex <> o1 and apex <> o2")
