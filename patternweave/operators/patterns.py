"""Rows of the named patterns, and their factorised forms, over packed oriented edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import chunks
from ..graph import Graph
from . import blocks

# --- squares


def top_wedges(g: Graph) -> DataFrame:
    """Wedges (x, y, z) with y above both x and z: each square has two with its greatest vertex as y.

    Centres only pair a neighbour with *larger* vertices, so a hub, which has
    few larger neighbours, makes few wedges.
    """
    near, up = g.adjacent.select(F.col("v").alias("z"), F.col("n").alias("x")), g.oriented.select(F.col("u").alias("z"), F.col("w").alias("y"))
    return near.join(up, "z").where("x < y")


def square_pairs(g: Graph) -> DataFrame:
    """(x, y, n): opposite vertices of squares, y the greatest, and the number of vertices between them."""
    return top_wedges(g).groupBy("x", "y").agg(F.count("*").alias("n"))


def squares(g: Graph) -> DataFrame:
    """(v1, v2, v3, v4): v1 least, v2 < v4, v3 opposite of v1.

    Two centres below y on the same ends are a square; its least vertex is x or
    the lesser of the two between.
    """
    both = centre_pairs(g.met).where("c < y")
    first = F.col("x") < F.col("z")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return both.select(pick("x", "z").alias("v1"), pick("z", "x").alias("v2"), pick("y", "c").alias("v3"), pick("c", "y").alias("v4"))


def centre_pairs(lists: DataFrame) -> DataFrame:
    """(x, y, z, c): two wedges z < c on the same ends, from lists (x, y, mids)."""
    one = lists.select("x", "y", "mids", F.posexplode("mids").alias("i", "z"))
    return one.select("x", "y", "z", F.explode(F.slice("mids", F.col("i") + 2, F.size("mids"))).alias("c"))


def squares_on_edges(g: Graph) -> DataFrame:
    """(x, y, k): the number of squares on each edge x < y that is in any.

    Each wedge of n on the same ends makes n - 1 squares, which lie on both of
    its edges.  Hubs make few top wedges, so nothing grows with their degree squared.
    """
    t = top_wedges(g).join(square_pairs(g).where("n > 1"), ["x", "y"])
    ends = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    sides = t.select(F.explode(F.array(ends("x", "z"), ends("z", "y"))).alias("e"), (F.col("n") - 1).alias("k"))
    return sides.groupBy("e").agg(F.sum("k").alias("k")).select("e.x", "e.y", "k")


def squares_compressed(g: Graph, threshold: int = 0) -> DataFrame:
    """(x, y, mids): all common neighbours of x < y, sorted, where they make a square whose least vertex is among them.

    With ``threshold`` longer lists are dealt in chunks, a row each pair of chunks (mids, more).
    """
    lists = g.met.where("mids[0] < x")
    return lists if not threshold else chunk_pairs(lists, "mids", threshold)


def chunk_pairs(lists: DataFrame, column: str, threshold: int) -> DataFrame:
    """Rows of an array column longer than ``threshold`` as rows (column, more) of chunk pairs i <= j; ``same`` tells i = j."""
    parts = lists.withColumn("_c", chunks(F.col(column), threshold))
    left = parts.selectExpr("*", "posexplode(_c) as (_i, _a)")
    both = left.selectExpr("*", "posexplode(_c) as (_j, _b)").where("_i <= _j")
    return both.select(*[c for c in lists.columns if c != column], F.col("_a").alias(column), F.col("_b").alias("more"), (F.col("_i") == F.col("_j")).alias("same"))


def in_chunks(rows: DataFrame, column: str, threshold: int) -> DataFrame:
    """Rows whose array ``column`` is longer than ``threshold`` as several rows, a chunk each (0: as they are)."""
    return rows.withColumn(column, F.explode(chunks(F.col(column), threshold))) if threshold else rows


def square_sides(sq: DataFrame) -> DataFrame:
    """(x, y, o1, o2): the four sides x < y of each square, and the two other corners."""
    s = sq.selectExpr("stack(4, v1, v2, v3, v4, v1, v4, v2, v3, v2, v3, v1, v4, v3, v4, v1, v2) as (p, q, o1, o2)")
    return s.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "o1", "o2")


# --- chordal squares


def apex_counts(g: Graph) -> DataFrame:
    """(x, y, n): triangles on each edge that is in any; no triangle is listed."""
    return blocks.apex_counts(g)


def chordal_squares(g: Graph) -> DataFrame:
    """(x, y, p, q): chord x < y, apexes p < q."""
    te = g.edge_apexes
    return te.alias("a").join(te.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.z") < F.col("b.z"))).select("a.x", "a.y", F.col("a.z").alias("p"), F.col("b.z").alias("q"))


def chordal_squares_from_wedges(g: Graph) -> DataFrame:
    """The same from edge-disjoint parts: a triangle and a wedge whose ends are the chord, which has two centres then."""
    te = g.edge_apexes
    return te.join(g.met.select("x", "y", F.explode("mids").alias("c")), ["x", "y"]).where("z < c").select("x", "y", F.col("z").alias("p"), F.col("c").alias("q"))


def chordal_squares_compressed(g: Graph) -> DataFrame:
    """(x, y, apexes): edges of two triangles or more, with their sorted apexes."""
    return g.edge_apexes.groupBy("x", "y").agg(F.array_sort(F.collect_list("z")).alias("apexes")).where("size(apexes) > 1")


# --- houses


def houses(g: Graph, sq: DataFrame | None = None, apexes: DataFrame | None = None) -> DataFrame:
    """(x, y, o1, o2, apex): the shared side, the other corners of the square, the top."""
    sides = square_sides(squares(g) if sq is None else sq)
    te = (g.edge_apexes if apexes is None else apexes).withColumnRenamed("z", "apex")
    return sides.join(te, ["x", "y"]).where("apex <> o1 and apex <> o2")


def houses_compressed(g: Graph, threshold: int = 0, sq: DataFrame | None = None) -> DataFrame:
    """(x, y, o1, o2, apexes): houses that differ in the top alone, as one row; tops over ``threshold`` in chunks."""
    sides = square_sides(squares(g) if sq is None else sq)
    tops = g.edge_apexes.groupBy("x", "y").agg(F.array_sort(F.collect_list("z")).alias("apexes"))
    # chunks are cut before the join, so that no long list is carried by each square
    met = sides.join(in_chunks(tops, "apexes", threshold), ["x", "y"])
    return met.withColumn("apexes", F.filter("apexes", lambda z: (z != F.col("o1")) & (z != F.col("o2")))).where("size(apexes) > 0")


def houses_from_wedges(g: Graph) -> DataFrame:
    """The same from edge-disjoint parts: squares and wedges over a side."""
    return houses(g, apexes=g.wedges)


# --- wheels


def hub_triples(cs: DataFrame) -> DataFrame:
    """(hub, p, q, z): chordal squares from each end of the chord."""
    return cs.selectExpr("stack(2, x, p, q, y, y, p, q, x) as (hub, p, q, z)")


def solar_square_sums(g: Graph) -> DataFrame:
    """(k): wheels, in parts that add up: the squares among a hub's neighbours, of which no chordal square is listed.

    A task takes the neighbours of many hubs, each with its hub, as one graph.
    """
    from .cliques import by_least
    from .wedges import vertex_pairs

    def rows(v, a, b):
        ids = np.unique(np.concatenate([a, b]))
        at = np.searchsorted(np.unique(v), v) * len(ids)
        a, b = at + np.searchsorted(ids, a), at + np.searchsorted(ids, b)
        yield pa.RecordBatch.from_arrays([pa.array([blocks.squares_in(blocks.Block(np.r_[a, b], np.r_[b, a]))], pa.int64())], names=["k"])

    return by_least(g, rows, "k long", vertex_pairs(g.triangles).withColumnRenamed("c", "v"))


def solar_squares(g: Graph) -> DataFrame:
    """(hub, v1, v2, v3, v4): rim v1 v2 v3 v4, v1 least, v2 < v4."""
    t = hub_triples(chordal_squares(g))
    on = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.z") < F.col("b.z"))
    return t.where("z < p").alias("a").join(t.alias("b"), on).select("a.hub", F.col("a.z").alias("v1"), F.col("a.p").alias("v2"), F.col("b.z").alias("v3"), F.col("a.q").alias("v4"))


def solar_squares_compressed(g: Graph, threshold: int = 0) -> DataFrame:
    """(hub, p, q, mids): all rim vertices between p < q, sorted, where one below p is among them; with ``threshold`` in pairs of chunks (mids, more)."""
    lists = hub_triples(chordal_squares(g)).groupBy("hub", "p", "q").agg(F.array_sort(F.collect_list("z")).alias("mids")).where("size(mids) > 1 and mids[0] < p")
    return lists if not threshold else chunk_pairs(lists, "mids", threshold)


def pairs_with_lesser(lists: DataFrame, low: str, mids: str = "mids") -> DataFrame:
    """(cnt): pairs of a list's elements, the lesser below column ``low``, summed over rows of chunk pairs."""
    below = lambda c: F.size(F.filter(c, lambda z: z < F.col(low)))
    a, b, la, lb = F.size(mids), F.size("more"), below(mids), below("more")
    inner = F.when(F.col("same"), F.shiftright(la * (2 * a - 1 - la), 1)).otherwise(la * b + (a - la) * lb)
    return total(lists, inner.cast("long"))


def solar_squares_left_deep(g: Graph) -> DataFrame:
    """The same by a chordal square (hub, v2 with v1, v3), a triangle (hub, v2?..): three joins in a row.

    Chordal square: hub-v2 is the chord, v1 and v3 its apexes; a triangle
    (hub, v1, v4) is joined on (hub, v1); the last rim edge (v3, v4) is a semi-join.
    """
    first = hub_triples(chordal_squares(g)).selectExpr("hub", "z as v2", "p as a", "q as b")
    # the apex below the other is v1 if it is the least of the rim
    first = first.where("a < v2").selectExpr("hub", "a as v1", "v2", "b as v3")
    tri = g.edge_apexes.selectExpr("stack(2, x, y, z, y, x, z) as (hub, v1, v4)")
    second = first.join(tri, ["hub", "v1"]).where("v2 < v4 and v4 <> v3").select("*", F.least("v3", "v4").alias("x"), F.greatest("v3", "v4").alias("y"))
    return second.join(g.oriented.select(F.col("u").alias("x"), F.col("w").alias("y")), ["x", "y"], "left_semi").select("hub", "v1", "v2", "v3", "v4")


# --- bow ties


def twin_triangles(g: Graph) -> DataFrame:
    """(c, a, b, p, q): two triangles c a b and c p q without another common vertex, a < b, p < q, a < p."""
    from .wedges import vertex_pairs

    t = vertex_pairs(g.triangles)
    r = t.select(F.col("c"), F.col("a").alias("p"), F.col("b").alias("q"))
    return t.join(r, "c").where("a < p and b <> p and b <> q")


def twin_triangles_compressed(g: Graph, threshold: int = 0) -> DataFrame:
    """(c, edges): a vertex and the edges opposite to it; two without a common vertex are a bow tie.  With ``threshold`` in pairs of chunks (edges, more)."""
    from .wedges import vertex_pairs

    lists = vertex_pairs(g.triangles).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("edges")).where("size(edges) > 1")
    return lists if not threshold else chunk_pairs(lists, "edges", threshold)


def triangles_at(g: Graph) -> DataFrame:
    """(v, n): triangles at each vertex."""
    return g.triangles.select(F.explode(F.array("v1", "v2", "v3")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


# --- near 5-cliques


def near_5_cliques(g: Graph, four: DataFrame) -> DataFrame:
    """(x, y, o1, o2, apex): a 4-clique and a vertex joined to its edge x < y.  ``four``: v1 .. v4 ascending."""
    sides = four.selectExpr("stack(6, v1, v2, v3, v4, v1, v3, v2, v4, v1, v4, v2, v3, v2, v3, v1, v4, v2, v4, v1, v3, v3, v4, v1, v2) as (x, y, o1, o2)")
    return sides.join(g.edge_apexes.withColumnRenamed("z", "apex"), ["x", "y"]).where("apex <> o1 and apex <> o2")


def near_5_cliques_compressed(g: Graph, four: DataFrame, threshold: int = 0) -> DataFrame:
    """(x, y, o1, o2, apexes): matches that differ in the fifth vertex alone, as one row; longer lists in chunks."""
    sides = four.selectExpr("stack(6, v1, v2, v3, v4, v1, v3, v2, v4, v1, v4, v2, v3, v2, v3, v1, v4, v2, v4, v1, v3, v3, v4, v1, v2) as (x, y, o1, o2)")
    tops = g.edge_apexes.groupBy("x", "y").agg(F.array_sort(F.collect_list("z")).alias("apexes"))
    met = sides.join(in_chunks(tops, "apexes", threshold), ["x", "y"])
    return met.withColumn("apexes", F.filter("apexes", lambda z: (z != F.col("o1")) & (z != F.col("o2")))).where("size(apexes) > 0")


# --- fans


def fan_halves(cs: DataFrame) -> DataFrame:
    """(h, m, p, o): hub, middle, neighbour of the middle on the path, its outer end."""
    return cs.selectExpr("stack(4, y, q, x, p, y, p, x, q, x, q, y, p, x, p, y, q) as (h, m, p, o)")


def fans(g: Graph) -> DataFrame:
    """(h, m, p, o, r, s): hub h and path o p m r s, p < r."""
    a = fan_halves(chordal_squares(g))
    b = a.select("h", "m", F.col("p").alias("r"), F.col("o").alias("s"))
    return a.join(b, ["h", "m"]).where("p < r and o <> s and o <> r and p <> s")


def fan_counts(g: Graph) -> DataFrame:
    """(h, m, cnt): fans by hub and middle, without their rows.

    Inner vertices p < r of the path are paired over the triangles (h, m, p);
    the outer ends are counted by set algebra: n * k - c, where n and k are the
    numbers of apexes of (h, p) and (h, r) that are free, c those they share.
    """
    sides = chordal_squares_compressed(g)
    both = sides.selectExpr("stack(2, x, y, apexes, y, x, apexes) as (h, p, ends)")
    # each apex m of the edge (h, p) is a middle; the other apexes are outer ends
    half = both.select("h", "p", F.explode("ends").alias("m"), "ends")
    other = half.select("h", "m", F.col("p").alias("r"), F.col("ends").alias("more"))
    met = half.join(other, ["h", "m"]).where("p < r")
    n = F.size("ends") - 1 - F.array_contains("ends", F.col("r")).cast("int")
    k = F.size("more") - 1 - F.array_contains("more", F.col("p")).cast("int")
    # both lists hold m, which is no outer end; p and r are in neither's rest
    c = F.size(F.array_intersect("ends", "more")) - 1
    return met.groupBy("h", "m").agg(F.sum(n.cast("long") * k.cast("long") - c.cast("long")).alias("cnt"))


def fan_count_by_halves(g: Graph) -> DataFrame:
    """(cnt): fans without their rows and without arrays.

    A half is an inner vertex p and its outer end o; two halves of one hub h and
    middle m are a fan unless they share p, share o, or one's o is the other's
    p.  With t triangles on the edge (h, p) there are t - 1 halves of (h, m, p),
    and with w vertices between m and o around h there are w of (h, m, o), so
    all numbers come from triangles and one aggregate over chordal squares.
    """
    from .wedges import vertex_pairs

    on = apex_counts(g)

    def counted(rows: DataFrame, v: str, name: str) -> DataFrame:
        own = on.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("n").alias(name))
        return rows.join(own, (F.least("c", v) == F.col("_x")) & (F.greatest("c", v) == F.col("_y"))).drop("_x", "_y")

    around = counted(counted(vertex_pairs(g.triangles), "a", "ta"), "b", "tb")
    ends = around.selectExpr("stack(2, c, a, tb - 1, c, b, ta - 1) as (h, m, k)")
    whole = ends.groupBy("h", "m").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("s")).select(F.shiftright(F.col("n") * F.col("n") - F.col("s"), 1).alias("k"))
    between = hub_triples(chordal_squares(g)).groupBy("hub", "p", "q").agg(F.count("*").alias("w"))
    tied = between.join(around.select(F.col("c").alias("hub"), F.col("a").alias("p"), F.col("b").alias("q"), (F.col("ta") + F.col("tb") - 3).alias("t")), ["hub", "p", "q"], "left")
    w = F.col("w")
    return total(whole.union(tied.select((-w * (w - 1) - w * F.coalesce("t", F.lit(0))).alias("k"))), F.col("k"))


def fan_counts_left_deep(g: Graph) -> DataFrame:
    """(h, m, cnt): the counts of ``fan_counts`` by two joins in a row that carry the list of outer ends along.

    A compressed chordal square (h, p) with middle m and its ends, a triangle
    (h, m, r), then the compressed chordal square (h, r).
    """
    sides = chordal_squares_compressed(g).selectExpr("stack(2, x, y, apexes, y, x, apexes) as (h, p, ends)")
    first = sides.select("h", "p", "ends", F.explode("ends").alias("m"))
    second = first.join(g.edge_apexes.selectExpr("stack(2, x, y, z, y, x, z) as (h, m, r)"), ["h", "m"]).where("p < r")
    met = second.join(sides.select("h", F.col("p").alias("r"), F.col("ends").alias("more")), ["h", "r"])
    n = F.size("ends") - 1 - F.array_contains("ends", F.col("r")).cast("int")
    k = F.size("more") - 1 - F.array_contains("more", F.col("p")).cast("int")
    c = F.size(F.array_intersect("ends", "more")) - 1
    return met.groupBy("h", "m").agg(F.sum(n.cast("long") * k.cast("long") - c.cast("long")).alias("cnt"))


def fans_left_deep(g: Graph) -> DataFrame:
    """The same by a chordal square, then a triangle (h, m, r), then a triangle (h, r, s)."""
    first = fan_halves(chordal_squares(g))
    tri = g.edge_apexes.selectExpr("stack(2, x, y, z, y, x, z) as (h, v, t)")
    second = first.join(tri.selectExpr("h", "v as m", "t as r"), ["h", "m"]).where("p < r and r <> o")
    return second.join(tri.selectExpr("h", "v as r", "t as s"), ["h", "r"]).where("s <> m and s <> p and s <> o").select("h", "m", "p", "o", "r", "s")


def count(df: DataFrame, name: str = "cnt") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def total(df: DataFrame, value, name: str = "cnt") -> DataFrame:
    """The sum of an expression as BIGINT, 0 over no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name))


