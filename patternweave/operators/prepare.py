"""From raw edges to an oriented graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertex import degree, pack


def undirect(raw: DataFrame, distinct: bool = True, parts: int | None = None) -> DataFrame:
    """Distinct edges (a < b) without loops, of any raw (src, dst); rows with a null end are left out.

    Without ``distinct`` the rows are taken to be different edges, and nothing is shuffled.
    ``parts``: how many parts they are dealt in before any is held in a table (None: as Spark is set).
    """
    ends = raw.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return dealt(ends, parts, "a", "b").distinct() if distinct else ends


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` in so many parts, which Spark doesn't merge by their compressed size; None: as they are."""
    return df.repartition(parts, *keys) if parts else df


def degrees(edges: DataFrame) -> DataFrame:
    """(v, deg) of edges (a, b); counted map-side first."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"))
    return ends.groupBy("v").agg(F.count("*").alias("deg"))


def orient(edges: DataFrame, deg: DataFrame, parts: int | None = None) -> DataFrame:
    """Packed edges (u, w), u < w in the order of degree and id; joined in ``parts`` parts."""
    left = deg.select(F.col("v").alias("a"), F.col("deg").alias("da"))
    right = deg.select(F.col("v").alias("b"), F.col("deg").alias("db"))
    ends = dealt(dealt(edges, parts, "a").join(left, "a"), parts, "b").join(right, "b").select(pack(F.col("a"), F.col("da")).alias("p"), pack(F.col("b"), F.col("db")).alias("q"))
    return ends.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("w"))


def prune_leaves(oriented: DataFrame) -> DataFrame:
    """Without edges at a vertex of degree 1.  The smaller end of an edge has the smaller degree."""
    return oriented.where(degree(F.col("u")) > 1)


def both_ways(oriented: DataFrame) -> DataFrame:
    """Adjacency (v, n): each edge from either end."""
    return oriented.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("n")), F.struct(F.col("w").alias("v"), F.col("u").alias("n")))).alias("x")).select("x.*")


def adjacency(oriented: DataFrame, least_degree: int = 0, below: bool = False) -> DataFrame:
    """(v, smaller, larger): sorted arrays of neighbours on either side of v in the order.

    With ``least_degree`` only neighbours of at least that degree (``below``:
    of less) are listed.  An array holds one vertex's neighbours, so hubs make
    long rows; the joins of this engine use edges instead.
    """
    near = both_ways(oriented)
    if least_degree:
        near = near.where(degree(F.col("n")) < least_degree if below else degree(F.col("n")) >= least_degree)
    side = near.groupBy("v").agg(F.array_sort(F.collect_list("n")).alias("all"))
    return side.select("v", F.filter("all", lambda x: x < F.col("v")).alias("smaller"), F.filter("all", lambda x: x > F.col("v")).alias("larger"))


def non_small(oriented: DataFrame) -> DataFrame:
    """Vertices without a smaller neighbour: never the second or fourth of a square."""
    return oriented.select(F.col("u").alias("v")).distinct().join(oriented.select(F.col("w").alias("v")).distinct(), "v", "left_anti")


def keep_known_edges(pairs: DataFrame, oriented: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The rows whose pair (x < y) is an edge: an exact semi-join, before which Spark may put a run-time Bloom filter."""
    return pairs.join(oriented.select(F.col("u").alias(x), F.col("w").alias(y)), [x, y], "left_semi")


def power_sums(deg: DataFrame, upto: int) -> DataFrame:
    """(i, total): sums of the i-th powers of degrees, i from 0 to ``upto``, in one pass."""
    sums = deg.agg(*[F.sum(F.pow(F.col("deg").cast("double"), F.lit(float(i)))).alias(f"s{i}") for i in range(upto + 1)])
    return sums.select(F.posexplode(F.array(*sums.columns)).alias("i", "total"))


def largest_degree(deg: DataFrame) -> DataFrame:
    """The vertex of largest degree, the least id of equals."""
    return deg.agg(F.max(F.struct("deg", (-F.col("v")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("v"), F.col("x.deg").alias("deg"))
