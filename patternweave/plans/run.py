"""From options to a result: the plan of each named query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import binomial, pairs
from ..graph import Graph
from ..operators import blocks, cliques, hypergraph, patterns
from ..operators.patterns import count, total
from ..options import Options
from ..sources.tables import Stages
from . import star, twintwig
from .patterns import ALIASES


def square_count(g: Graph) -> DataFrame:
    return total(blocks.square_sums(g), F.col("k"))


def chordal_square_count(g: Graph) -> DataFrame:
    return total(patterns.apex_counts(g), pairs(F.col("n")))


def house_count(g: Graph) -> DataFrame:
    """Sum over the sides of squares of the triangles on them, less 4 for each chordal square; no square is listed."""
    te = patterns.apex_counts(g)
    return total(blocks.square_sums(g, te).union(te.select((-4 * pairs(F.col("n"))).alias("k"))), F.col("k"))


def solar_square_count(g: Graph) -> DataFrame:
    return total(patterns.solar_square_sums(g), F.col("k"))


def twin_triangle_count(g: Graph) -> DataFrame:
    """Pairs of triangles at each vertex, less 2 for each pair on a common edge; both come from the triangles on edges."""
    te = patterns.apex_counts(g)
    at = te.selectExpr("stack(2, x, n, y, n) as (v, n)").groupBy("v").agg(F.shiftright(F.sum("n"), 1).alias("n"))
    return total(at.select(pairs(F.col("n")).alias("k")).union(te.select((-2 * pairs(F.col("n"))).alias("k"))), F.col("k"))


def near_5_clique_count(g: Graph) -> DataFrame:
    """Sum over the edges of 4-cliques of the triangles on it, less the two within."""
    return total(cliques.edges_of_4_cliques(g).join(patterns.apex_counts(g), ["x", "y"]), F.col("k") * (F.col("n") - 2))


def fan_count(g: Graph) -> DataFrame:
    return total(patterns.fan_counts(g), F.col("cnt"))


def fan_count_by_halves(g: Graph) -> DataFrame:
    return patterns.fan_count_by_halves(g)


COUNTS = {"square": square_count, "chordalsquare": chordal_square_count, "house": house_count, "solarsquare": solar_square_count, "twintriangle": twin_triangle_count, "near5clique": near_5_clique_count, "tcsquare": fan_count_by_halves, "quadtriangle": fan_count}


def enumerate_query(g: Graph, o: Options, query: str) -> DataFrame:
    """Rows of a query by the plan that the options ask for."""
    k = o.clique_vertices
    if query == "triangle":
        return g.triangles
    if query == "clique":
        if o.star:
            return star.cliques(g, k, o.bottom_up)
        if o.twin_twig:
            return twintwig.cliques(g, k)
        return cliques.cliques_encoded(g, k) if o.compressed and not o.count_only else cliques.cliques(g, k)
    if o.twin_twig and query in ("chordalsquare", "house", "solarsquare", "twintriangle", "near5clique"):
        return {"chordalsquare": twintwig.chordal_squares, "house": twintwig.houses, "solarsquare": twintwig.solar_squares, "twintriangle": twintwig.twin_triangles, "near5clique": twintwig.near_5_cliques}[query](g)
    compressed = (o.compressed and not o.count_only) or o.partition_threshold > 0
    stored = Stages(g.raw.sparkSession, o.stages).get if o.stages else lambda name, build: build()
    if query == "square":
        return patterns.squares_compressed(g, o.partition_threshold) if compressed else patterns.squares(g)
    if query == "chordalsquare":
        return patterns.chordal_squares_compressed(g) if compressed else patterns.chordal_squares_from_wedges(g) if o.non_overlapping else patterns.chordal_squares(g)
    if query == "house":
        if o.non_overlapping:
            return patterns.houses_from_wedges(g)
        sq = stored("squares", lambda: patterns.squares(g))
        return patterns.houses_compressed(g, o.partition_threshold, sq) if compressed else patterns.houses(g, sq)
    if query == "solarsquare":
        return patterns.solar_squares_left_deep(g) if o.left_deep else patterns.solar_squares_compressed(g, o.partition_threshold) if compressed else patterns.solar_squares(g)
    if query == "twintriangle":
        return patterns.twin_triangles_compressed(g, o.partition_threshold) if compressed else patterns.twin_triangles(g)
    if query == "near5clique":
        four = stored("4-cliques", lambda: cliques.cliques(g, 4))
        return patterns.near_5_cliques_compressed(g, four, o.partition_threshold) if compressed else patterns.near_5_cliques(g, four)
    if query == "quadtriangle" and o.left_deep and o.count_only:
        return patterns.fan_counts_left_deep(g)
    if query in ("tcsquare", "quadtriangle"):
        return patterns.fans_left_deep(g) if o.left_deep else patterns.fans(g)
    if query == "cliquecover":
        return cliques.clique_cover(g, o.clique_threshold)
    if query == "cliquedebug":
        return cliques.compare_counts(g, k)
    if query == "maximalcliques":
        return cliques.maximal_cliques(g)
    raise ValueError(f"unknown query: {query}")


#: Queries whose rows have a form in chunks.
CHUNKED = ("square", "house", "solarsquare", "twintriangle", "near5clique")


def refuse(o: Options) -> None:
    """Raise an error for options that the plan of ``o`` would ignore."""
    query = ALIASES.get(o.query, o.query)
    plain = not (o.left_deep or o.non_overlapping or o.twin_twig or o.star)
    if o.clique_threshold != Options.clique_threshold and query != "cliquecover":
        raise ValueError("clique_threshold: only a clique cover has one")
    if o.partition_threshold and (query not in CHUNKED or not plain or not (o.compressed or o.count_only)):
        raise ValueError(f"partition_threshold: only compressed rows and counts of {', '.join(CHUNKED)} are dealt in chunks")
    if o.stages and (query not in ("house", "near5clique") or not plain):
        raise ValueError("stages: only houses and near 5-cliques read stored parts")


def chunked_count(g: Graph, o: Options, query: str) -> DataFrame:
    """The count of compressed rows in chunks of at most ``partition_threshold``."""
    rows = enumerate_query(g, o, query)
    if query in ("square", "solarsquare"):
        return patterns.pairs_with_lesser(rows, "x" if query == "square" else "p")
    if query == "twintriangle":
        apart = lambda e, f: (e["a"] != f["a"]) & (e["a"] != f["b"]) & (e["b"] != f["a"]) & (e["b"] != f["b"])
        met = F.aggregate("edges", F.lit(0).cast("long"), lambda n, e: n + F.size(F.filter("more", lambda f: apart(e, f))))
        return total(rows, F.when(F.col("same"), F.shiftright(met, 1)).otherwise(met))
    return total(rows, F.size("apexes").cast("long"))


def run(g: Graph, o: Options) -> DataFrame:
    """The result of ``o.query``: (cnt) if ``count_only``, else its rows."""
    refuse(o)
    if o.hypergraph:
        g = hypergraph.rebuilt(g)
    query = ALIASES.get(o.query, o.query)
    if not o.count_only or query in ("cliquecover", "cliquedebug", "maximalcliques"):
        return enumerate_query(g, o, query)
    if o.partition_threshold:
        return chunked_count(g, o, query)
    special = o.left_deep or o.non_overlapping or o.twin_twig or o.star or bool(o.stages)
    if query in COUNTS and not special:
        return COUNTS[query](g)
    if query == "clique" and not special:
        counts = cliques.clique_counts(g, o.clique_vertices)
        return total(counts, F.col("cnt")) if o.count_once else counts
    if query == "square" and o.twin_twig:
        return total(twintwig.square_counts(g), F.col("n1") * F.col("n23") + binomial(F.col("n1"), 2))
    if query == "quadtriangle" and o.left_deep:
        return total(enumerate_query(g, o, query), F.col("cnt"))
    return count(enumerate_query(g, o, query))


def main(args: list[str] | None = None) -> None:
    """Command line: ``key=value`` options; prints the count or writes the rows."""
    import sys

    from ..operators import sampling
    from ..sources.edges import write_table

    o = Options.parse(sys.argv[1:] if args is None else args)
    refuse(o)
    spark = SparkSession.builder.appName(f"patternweave {o.query}").config("spark.sql.optimizer.runtime.bloomFilter.enabled", str(o.bloom).lower()).getOrCreate()
    g = Graph.from_text(spark, o.input, o.separator, keep=True, prune=o.degree_prune and o.query not in ("sample", "cliquecover", "maximalcliques"), undirected=o.undirected)
    if o.query == "sample":
        f = sampling.sample_vertices if o.sample_type == "vertex" else sampling.sample_edges
        out = f(g.edges, o.sample_rate, o.seed)
    else:
        out = run(g, o)
    if o.output:
        write_table(out, o.output)
    else:
        out.show(truncate=False)
    g.release()


if __name__ == "__main__":
    main()
