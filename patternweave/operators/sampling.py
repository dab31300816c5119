"""Samples of a graph and degree limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# A Lehmer generator's modulus and multipliers.
_MODULUS, _STEP, _NEXT = 2147483647, 48271, 69621


def _share(ids: list, seed: int, rate: float):
    """Whether a number drawn from ids by plain arithmetic, the same in every engine, is in the first ``rate`` of its range."""
    drawn = F.lit(seed % _MODULUS).cast("long")
    for one in ids:
        drawn = F.pmod((drawn + F.pmod(one, F.lit(_MODULUS)) * _STEP) * _NEXT % _MODULUS * _STEP, F.lit(_MODULUS))
    return drawn < int(rate * _MODULUS)


def sample_vertices(edges: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Edges (a, b) with both ends in a sample of vertices; a vertex is in by a seeded hash, the same in every run."""
    return edges.where(_share([F.col("a")], seed, rate) & _share([F.col("b")], seed, rate))


def sample_edges(edges: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """A seeded sample of edges."""
    return edges.where(_share([F.col("a"), F.col("b")], seed, rate))


def sample_vertices_modulo(edges: DataFrame, modulus: int, keep: int) -> DataFrame:
    """Edges whose ends both have ``id mod modulus < keep``: a sample that plain arithmetic can repeat."""
    return edges.where((F.pmod("a", F.lit(modulus)) < keep) & (F.pmod("b", F.lit(modulus)) < keep))


def sample_edges_modulo(edges: DataFrame, modulus: int, keep: int) -> DataFrame:
    return edges.where(F.pmod(F.col("a") + F.col("b"), F.lit(modulus)) < keep)


def limit_degrees(oriented: DataFrame, most: int, order: str = "lowest", seed: int = 42) -> DataFrame:
    """Oriented edges that both ends rank among their first ``most`` neighbours.

    ``order``: neighbours of ``lowest`` or ``highest`` degree first, or
    ``random`` by a seeded hash.  Every vertex keeps at most ``most`` edges;
    the result doesn't depend on the order in which vertices are visited.
    """
    from .prepare import both_ways

    near = both_ways(oriented)
    key = {"lowest": F.col("n").asc(), "highest": F.col("n").desc(), "random": F.xxhash64(F.lit(seed), F.least("v", "n"), F.greatest("v", "n")).asc()}[order]
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(key, "n"))).where(F.col("r") <= most)
    ends = ranked.select(F.least("v", "n").alias("u"), F.greatest("v", "n").alias("w"))
    return ends.groupBy("u", "w").agg(F.count("*").alias("sides")).where("sides = 2").select("u", "w")
