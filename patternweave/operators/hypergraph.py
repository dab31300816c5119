"""Structural twins: vertices with the same neighbours, and the graph with each class as one vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertex import degree
from ..graph import Graph
from ..sources.tables import materialize


def _by_signature(g: Graph, closed: bool, most_degree: int) -> DataFrame:
    """(v, d, s1, s2): degree and two sums of hashes of the (closed) neighbourhood.

    The sums stand for the set; they are added map-side, so no neighbourhood
    is collected.  Equal sets have equal sums; that sets of equal degree and
    equal sums of 2 x 60 bits differ is a matter of chance below 2^-100.
    """
    near = g.adjacent.where(degree(F.col("v")) <= most_degree) if most_degree else g.adjacent
    if closed:
        near = near.union(near.select("v", F.col("v").alias("n")).distinct())
    wrap = (1 << 60) - 1
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "n").bitwiseAND(F.lit(wrap)).cast("decimal(38,0)"))
    return near.groupBy("v").agg(F.count("*").alias("d"), part(1).alias("s1"), part(2).alias("s2"))


def twins(g: Graph, closed: bool, most_degree: int = 0) -> DataFrame:
    """(rep, member): classes of two or more vertices with the same closed neighbourhood (true twins) or open one (false twins).

    ``most_degree`` leaves out vertices of larger degree (0: none).  A class is
    named by its least member.
    """
    keyed = _by_signature(g, closed, most_degree)
    reps = keyed.groupBy("d", "s1", "s2").agg(F.min("v").alias("rep"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(reps, ["d", "s1", "s2"]).select("rep", F.col("v").alias("member"))


def hypervertices(g: Graph, most_degree: int = 0) -> DataFrame:
    """(rep, member, kind): each vertex once; ``clique`` (true twins) before ``set`` (false twins) before ``single``.

    No vertex has twins of both kinds: a true twin is its neighbour, a false
    one shares its neighbours but isn't one.
    """
    true = twins(g, True, most_degree).select("member", F.col("rep").alias("t"))
    false = twins(g, False, most_degree).select("member", F.col("rep").alias("f"))
    every = g.adjacent.select(F.col("v").alias("member")).distinct()
    kind = F.when(F.col("t").isNotNull(), "clique").when(F.col("f").isNotNull(), "set").otherwise("single")
    return every.join(true, "member", "left").join(false, "member", "left").select(F.coalesce("t", "f", "member").alias("rep"), "member", kind.alias("kind"))


def hyperedges(g: Graph, classes: DataFrame | None = None) -> DataFrame:
    """(p, q): distinct edges between classes, p < q; edges within a class are implied by its kind."""
    of = (hypervertices(g) if classes is None else classes).select("rep", "member")
    ends = g.oriented.join(of.withColumnsRenamed({"member": "u", "rep": "p"}), "u").join(of.withColumnsRenamed({"member": "w", "rep": "q"}), "w")
    return ends.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def expand(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The oriented edges (u, w) of the graph again."""
    m = classes.select("rep", "member")
    between = edges.join(m.withColumnsRenamed({"rep": "p", "member": "a"}), "p").join(m.withColumnsRenamed({"rep": "q", "member": "b"}), "q").select("a", "b")
    inner = classes.where("kind = 'clique'").select("rep", "member")
    within = inner.withColumnRenamed("member", "a").join(inner.withColumnRenamed("member", "b"), "rep").where("a < b").select("a", "b")
    return between.union(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w"))


def triangle_count(g: Graph) -> DataFrame:
    """(cnt): triangles counted on classes with their sizes, without expanding them."""
    classes = materialize(hypervertices(g), "twin-classes")
    size = classes.groupBy("rep").agg(F.count("*").alias("s"), F.max(F.col("kind") == "clique").alias("k"))
    e = materialize(hyperedges(g, classes), "class-edges")
    a, b, c = (size.select(F.col("rep").alias(x), F.col("s").alias(f"s{x}"), F.col("k").alias(f"k{x}")) for x in "pqr")
    pair = e.join(a, "p").join(b, "q")
    tri = pair.join(e.select("p", F.col("q").alias("r")), "p").where("q < r").join(e.select(F.col("p").alias("q"), F.col("q").alias("r")), ["q", "r"]).join(c, "r")
    three = tri.select((F.col("sp") * F.col("sq") * F.col("sr")).alias("n"))
    two = pair.select((F.when(F.col("kp"), F.col("sp") * (F.col("sp") - 1) / 2 * F.col("sq")).otherwise(0) + F.when(F.col("kq"), F.col("sq") * (F.col("sq") - 1) / 2 * F.col("sp")).otherwise(0)).cast("long").alias("n"))
    one = size.where("k").select((F.col("s") * (F.col("s") - 1) * (F.col("s") - 2) / 6).cast("long").alias("n"))
    return three.union(two).union(one).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cnt"))


def rebuilt(g: Graph) -> Graph:
    """The graph whose edges are expanded from classes of twins: queries on it see members, each as often as its class allows."""
    classes = materialize(hypervertices(g), "twin-classes")
    return Graph(Graph.ids(expand(classes, hyperedges(g, classes))).toDF("src", "dst"), g.keep, g.prune, undirected=True)


def statistics(g: Graph) -> DataFrame:
    """(kind, classes, members, edges): classes of each kind, their vertices, and the edges that have an end in one."""
    classes = materialize(hypervertices(g), "twin-classes")
    kinds = classes.groupBy("kind").agg(F.countDistinct("rep").alias("classes"), F.count("*").alias("members"))
    of = classes.select("member", "kind")
    ends = g.oriented.join(of.withColumnsRenamed({"member": "u", "kind": "ku"}), "u").join(of.withColumnsRenamed({"member": "w", "kind": "kw"}), "w")
    on = ends.select(F.explode(F.array_distinct(F.array("ku", "kw"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("edges"))
    return kinds.join(on, "kind")
