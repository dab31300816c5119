"""The registered queries, over graphs of parts that are ordered together, and their SQL.

Vertices are parts, and every row of ``lineitem`` is read.  Two parts are an
edge of the main graph if one order holds both and ships them no more than
``DAYS`` days apart; ``orders_<name>`` runs on the denser graph without that
limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vertex import degree, vertex_id
from .graph import Graph
from .operators import cliques, hypergraph, patterns, prepare, sampling, wedges
from .options import Options
from .plans import planner, run, star, twintwig
from .plans.patterns import PATTERNS, Pattern
from .sources import edges, tables

ids = Graph.ids

#: Days between the shipments of two parts of an order that still make an edge of the main graph.
DAYS = 200
#: The same for queries of twins, which dense graphs don't have.
TWIN_DAYS = 15
DATA = Path(__file__).resolve().parent / "data"


#: Lines in a part, whose pairs of one order are about twice as many.
LINES = 250_000


def parts_of(spark: SparkSession, sf_dir: str) -> int:
    """Parts in proportion to the lines (their number stands in the file's footer), and on small tables a few for all cores."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(1, -(-lines // LINES), min(spark.sparkContext.defaultParallelism, lines // 20_000))


def raw_pairs(spark: SparkSession, sf_dir: str, days: int | None = DAYS, clean: bool = True) -> DataFrame:
    """(src, dst): parts of one order shipped within ``days`` (None: whenever); without ``clean`` also loops and both directions."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = prepare.dealt(li, parts_of(spark, sf_dir), "l_orderkey")
    a = li.select("l_orderkey", F.col("l_partkey").alias("src"), *([F.col("l_shipdate").alias("s")] if days is not None else []))
    b = li.select("l_orderkey", F.col("l_partkey").alias("dst"), *([F.col("l_shipdate").alias("t")] if days is not None else []))
    out = a.join(b, "l_orderkey")
    if days is not None:
        out = out.where(F.abs(F.datediff("s", "t")) <= days)
    out = out.select("src", "dst")
    return out.where("src < dst") if clean else out


_prepared: dict[tuple[str, str, int | None], Graph] = {}


def graph(spark: SparkSession, sf_dir: str, days: int | None = DAYS) -> Graph:
    """The graph of ``sf_dir``, prepared once for the queries of a session; another one's parts are released."""
    key = (spark.sparkContext.applicationId, sf_dir, days)
    if key not in _prepared:
        for (app, *_), g in _prepared.items():
            if app == key[0]:
                g.release()
        _prepared.clear()
        _prepared[key] = Graph(raw_pairs(spark, sf_dir, days), keep=True, parts=parts_of(spark, sf_dir))
    return _prepared[key]


Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
#: The same as functions of any graph.
ON_GRAPH: dict[str, Callable[[Graph], DataFrame]] = {}


def on_graph(name: str, f: Callable[[Graph], DataFrame], days: int = DAYS) -> None:
    ON_GRAPH[name] = f
    QUERIES[name] = lambda spark, sf_dir: f(graph(spark, sf_dir, days))


def joined(column: str) -> F.Column:
    """A sorted array of packed vertices as text of ids in the order of ids."""
    return F.array_join(F.transform(F.array_sort(F.transform(column, vertex_id)), lambda x: x.cast("string")), ",").alias(column)


# --- preparation
QUERIES["undirected_edges"] = lambda spark, sf_dir: prepare.undirect(raw_pairs(spark, sf_dir, clean=False), parts=parts_of(spark, sf_dir))


def _text(spark: SparkSession, raw: DataFrame, head: str) -> str:
    """Raw pairs as lines of text below a comment, as a path."""
    path = tables.new_path(spark, "edges-text")
    edges.write_text(raw, f"{path}/pairs", "comma")
    spark.createDataFrame([(head,)], "value string").write.mode("overwrite").text(f"{path}/head")
    return path


def _edges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs, loops and comments written as text, written again over the first, and read."""
    path = _text(spark, raw_pairs(spark, sf_dir, clean=False), "# two parts of an order")
    edges.write_text(raw_pairs(spark, sf_dir, clean=False), f"{path}/pairs", "comma")
    return Graph.from_text(spark, [f"{path}/pairs", f"{path}/head"], "comma").edges


def _edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "edges-table")
    edges.write_table(raw_pairs(spark, sf_dir, clean=False), path)
    return Graph.from_table(spark, path).edges


def _edges_two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller ids first in one file, larger ones first in another."""
    raw = raw_pairs(spark, sf_dir)
    paths = [_text(spark, raw.where("dst % 2 = 0"), "% some"), _text(spark, raw.where("dst % 2 = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "# others")]
    return Graph.from_text(spark, [f"{p}/{x}" for p in paths for x in ("pairs", "head")], "comma").edges


def _edges_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written once each and read by a graph that is told so."""
    path = tables.new_path(spark, "edges-once")
    edges.write_text(prepare.undirect(raw_pairs(spark, sf_dir)), path)
    return Graph.from_text(spark, path, undirected=True).edges


def _house_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses from squares that an earlier run has stored."""
    o = Options(query="house", stages=tables.new_path(spark, "stages"))
    run.run(graph(spark, sf_dir), o)
    return run.run(graph(spark, sf_dir), o)


def _near5clique_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.run(graph(spark, sf_dir), Options(query="near5clique", stages=tables.new_path(spark, "stages")))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins of the graph of customers (1000 + key) and their nations: customers of one nation have the same neighbours."""
    g = Graph(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst")))
    return hypergraph.twins(g, False).select(vertex_id(F.col("member")).alias("member"), vertex_id(F.col("rep")).alias("rep"))


QUERIES |= {"edges_text": _edges_text, "edges_table": _edges_table, "edges_two_inputs": _edges_two_inputs, "edges_once": _edges_once, "house_stored": _house_stored, "near5clique_stored": _near5clique_stored, "nation_false_twins": _nations}
QUERIES["local_graph_triangles"] = lambda spark, _: ids(Graph.from_file(spark, str(DATA / "demo_graph.txt")).triangles)
QUERIES["pattern_file_count"] = lambda spark, sf_dir: patterns.count(planner.match(graph(spark, sf_dir), Pattern.of("file", edges.read_pattern(str(DATA / "house.txt")))))
on_graph("degrees", lambda g: g.degrees)
on_graph("oriented_edges", lambda g: ids(g.oriented))
on_graph("oriented_edges_pruned", lambda g: ids(prepare.prune_leaves(g.oriented)))
on_graph("adjacency", lambda g: prepare.adjacency(g.oriented).select(vertex_id(F.col("v")).alias("v"), joined("smaller"), joined("larger")))
on_graph("adjacency_large_degree", lambda g: prepare.adjacency(g.oriented, least_degree=12).select(vertex_id(F.col("v")).alias("v"), joined("smaller"), joined("larger")))
on_graph("nonsmall_vertices", lambda g: ids(prepare.non_small(g.oriented)))
on_graph("degree_power_sums", lambda g: prepare.power_sums(g.degrees, 4).select(F.col("i").cast("long").alias("i"), F.col("total").cast("long").alias("total")))
on_graph("largest_degree", lambda g: prepare.largest_degree(g.degrees))
on_graph("max_order_neighbour", lambda g: g.adjacent.groupBy("v").agg(F.max("n").alias("n")).select(vertex_id(F.col("v")).alias("v"), vertex_id(F.col("n")).alias("n"), degree(F.col("n")).alias("deg")))
for _k in (1, 2, 3):
    on_graph(f"twintwig{_k}", lambda g, k=_k: ids(wedges.twin_twig(g.oriented, k)))
on_graph("distinct_twintwig", lambda g: ids(wedges.distinct_twin_twigs(g.oriented)))
on_graph("twintwig_known_edges", lambda g: ids(prepare.keep_known_edges(wedges.twin_twig(g.oriented, 1), g.oriented)))
on_graph("stars_3", lambda g: ids(wedges.stars(g.oriented, 3)))
# --- named patterns
on_graph("triangles", lambda g: ids(g.triangles))
on_graph("edge_apexes", lambda g: ids(g.edge_apexes))
on_graph("square_count", run.square_count)
on_graph("squares_on_edges", lambda g: patterns.squares_on_edges(g).select(vertex_id(F.col("x")).alias("x"), vertex_id(F.col("y")).alias("y"), "k"))
on_graph("square_enum", lambda g: ids(patterns.squares(g)))
on_graph("square_compressed", lambda g: patterns.squares_compressed(g).select(vertex_id(F.col("x")).alias("x"), vertex_id(F.col("y")).alias("y"), joined("mids")))


for _n in run.CHUNKED:
    on_graph(f"{_n}_partitioned", lambda g, n=_n: run.run(g, Options(query=n, partition_threshold=4)))


def _rows(g: Graph, **options) -> DataFrame:
    return run.run(g, Options(count_only=False, **options))


_vertices = lambda *names: [vertex_id(F.col(c)).alias(c) for c in names]
on_graph("house_compressed", lambda g: _rows(g, query="house").select(*_vertices("x", "y", "o1", "o2"), joined("apexes")))
on_graph("solarsquare_compressed", lambda g: _rows(g, query="solarsquare").select(*_vertices("hub", "p", "q"), joined("mids")))
on_graph("near5clique_compressed", lambda g: _rows(g, query="near5clique").select(*_vertices("x", "y", "o1", "o2"), joined("apexes")))


def _opposite(g: Graph) -> DataFrame:
    """Compressed bow ties: a vertex and the edges opposite to it, as text in the order of ids."""
    both = F.transform("edges", lambda e: F.struct(F.least(vertex_id(e["a"]), vertex_id(e["b"])).alias("a"), F.greatest(vertex_id(e["a"]), vertex_id(e["b"])).alias("b")))
    text = F.array_join(F.transform(F.array_sort(both), lambda e: F.concat_ws("-", e["a"].cast("string"), e["b"].cast("string"))), ",")
    return _rows(g, query="twintriangle").select(*_vertices("c"), text.alias("edges"))


on_graph("twintriangle_compressed", _opposite)
on_graph("chordalsquare_count", run.chordal_square_count)
on_graph("chordalsquare_enum", lambda g: ids(patterns.chordal_squares(g)))
on_graph("chordalsquare_compressed", lambda g: patterns.chordal_squares_compressed(g).select(vertex_id(F.col("x")).alias("x"), vertex_id(F.col("y")).alias("y"), joined("apexes")))
on_graph("chordalsquare_nonoverlap", lambda g: patterns.count(patterns.chordal_squares_from_wedges(g)))
on_graph("clique4_enum", lambda g: ids(cliques.cliques(g, 4)))
on_graph("clique5_enum", lambda g: ids(cliques.cliques(g, 5)))
on_graph("clique4_per_vertex", lambda g: ids(cliques.clique_counts(g, 4)))
on_graph("qt_counter", lambda g: ids(cliques.clique_counts(g, 5)))
on_graph("clique4_compressed", lambda g: cliques.cliques_compressed(g, 4).select(*[vertex_id(F.col(f"v{i}")).alias(f"v{i}") for i in (1, 2, 3)], joined("last")))
on_graph("clique4_encoded_counts", lambda g: ids(cliques.encoded_counts(cliques.cliques_encoded(g, 4), 4)))
on_graph("clique5_encoded_enum", lambda g: ids(cliques.expand_encoded(cliques.cliques_encoded(g, 5), 5)))
for _k in (4, 5, 6):
    on_graph(f"clique{_k}_count", lambda g, k=_k: patterns.total(cliques.clique_counts(g, k), F.col("cnt")))
    on_graph(f"twintwig_clique{_k}", lambda g, k=_k: patterns.count(twintwig.cliques(g, k)))
on_graph("clique_star_topdown", lambda g: patterns.count(star.cliques(g, 5)))
on_graph("clique_star_bottomup", lambda g: patterns.count(star.cliques(g, 5, bottom_up=True)))
on_graph("house_count", run.house_count)
on_graph("house_join_count", lambda g: patterns.count(patterns.houses(g)))
on_graph("house_nonoverlap", lambda g: patterns.count(patterns.houses_from_wedges(g)))
on_graph("solarsquare_count", run.solar_square_count)
on_graph("solarsquare_enum", lambda g: ids(patterns.solar_squares(g)))
on_graph("solarsquare_leftdeep", lambda g: patterns.count(patterns.solar_squares_left_deep(g)))
on_graph("twintriangle_count", run.twin_triangle_count)
on_graph("twintriangle_join_count", lambda g: patterns.count(patterns.twin_triangles(g)))
on_graph("twintriangle_per_vertex", lambda g: patterns.triangles_at(g).select(vertex_id(F.col("v")).alias("v"), F.col("n").alias("triangles")))
on_graph("near5clique_count", run.near_5_clique_count)
on_graph("near5clique_join_count", lambda g: patterns.count(patterns.near_5_cliques(g, cliques.cliques(g, 4))))
on_graph("tcsquare_count", run.fan_count_by_halves)
on_graph("tcsquare_join_count", lambda g: patterns.count(patterns.fans(g)))
on_graph("tcsquare_leftdeep", lambda g: patterns.count(patterns.fans_left_deep(g)))
on_graph("quadtriangle_count", run.fan_count)
on_graph("quadtriangle_per_hub", lambda g: patterns.fan_counts(g).groupBy("h").agg(F.sum("cnt").alias("cnt")).where("cnt > 0").select(vertex_id(F.col("h")).alias("h"), "cnt"))
on_graph("quadtriangle_leftdeep", lambda g: run.run(g, Options(query="quadtriangle", left_deep=True)))
on_graph("clique_debug", lambda g: ids(run.run(g, Options(query="cliquedebug"))))
# --- wedge plans
on_graph("twintwig_square", lambda g: run.run(g, Options(query="square", twin_twig=True)))
on_graph("twintwig_chordalsquare", lambda g: patterns.count(twintwig.chordal_squares(g)))
on_graph("twintwig_house", lambda g: patterns.count(twintwig.houses(g)))
on_graph("twintwig_solarsquare", lambda g: patterns.count(twintwig.solar_squares(g)))
on_graph("twintwig_twintriangle", lambda g: patterns.count(twintwig.twin_triangles(g)))
on_graph("twintwig_near5clique", lambda g: patterns.count(twintwig.near_5_cliques(g)))
# --- twins, covers, samples
on_graph("hyper_true_twins", lambda g: hypergraph.twins(g, True).select(vertex_id(F.col("member")).alias("member"), vertex_id(F.col("rep")).alias("rep")), TWIN_DAYS)
on_graph("hyper_false_twins", lambda g: hypergraph.twins(g, False).select(vertex_id(F.col("member")).alias("member"), vertex_id(F.col("rep")).alias("rep")), TWIN_DAYS)
on_graph("hyper_vertices", lambda g: hypergraph.hypervertices(g).select(vertex_id(F.col("member")).alias("member"), vertex_id(F.col("rep")).alias("rep"), "kind"), TWIN_DAYS)
on_graph("hyper_edges", lambda g: hypergraph.hyperedges(g).select(vertex_id(F.col("p")).alias("p"), vertex_id(F.col("q")).alias("q")), TWIN_DAYS)
on_graph("hyper_triangle_count", hypergraph.triangle_count, TWIN_DAYS)
on_graph("hyper_square_count", lambda g: run.run(g, Options(query="square", hypergraph=True)), TWIN_DAYS)
on_graph("hyper_house_count", lambda g: run.run(g, Options(query="house", hypergraph=True)), TWIN_DAYS)
on_graph("hyper_statistics", hypergraph.statistics, TWIN_DAYS)


def _expanded(g: Graph) -> DataFrame:
    classes = hypergraph.hypervertices(g)
    return ids(hypergraph.expand(classes, hypergraph.hyperedges(g, classes)))


on_graph("hyper_expanded", _expanded, TWIN_DAYS)
on_graph("clique_cover", lambda g: run.run(g, Options(query="cliquecover", clique_threshold=4)).select(vertex_id(F.col("clique")).alias("clique"), vertex_id(F.col("member")).alias("member")))
on_graph("clique_collapse", lambda g: cliques.collapse(g, cliques.clique_cover(g, 4)).select(vertex_id(F.col("p")).alias("p"), vertex_id(F.col("q")).alias("q")))
on_graph("maximal_cliques", lambda g: cliques.maximal_cliques(g, 3).select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")))
on_graph("largest_clique_size", lambda g: cliques.largest_clique(g).select("size"))
on_graph("disjoint_cliques", lambda g: cliques.disjoint_cliques(g, 3).select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")))
on_graph("degree_limit", lambda g: ids(sampling.limit_degrees(g.oriented, 8)))
on_graph("sample_vertices_hash", lambda g: sampling.sample_vertices(g.edges, 0.5))
on_graph("sample_edges_hash", lambda g: sampling.sample_edges(g.edges, 0.2))
on_graph("sample_vertices_modulo", lambda g: sampling.sample_vertices_modulo(g.edges, 5, 3))
on_graph("sample_edges_modulo", lambda g: sampling.sample_edges_modulo(g.edges, 5, 1))
# --- planner
for _n in ("square", "chordalsquare", "house", "solarsquare", "chordalhouse"):
    on_graph(f"planned_{_n}", lambda g, n=_n: patterns.count(planner.match(g, PATTERNS[n])))


def _plan_rows(g: Graph) -> DataFrame:
    m = planner.Moments.of(g)
    lines = [(unit, k, line) for unit in planner.UNITS for k, line in enumerate(planner.decompose(PATTERNS["house"], m, unit).lines())]
    return g.edges.sparkSession.createDataFrame(lines, "unit string, line int, step string")


on_graph("pattern_plan_house", _plan_rows)


def _moments(g: Graph) -> DataFrame:
    """Logarithms of what the planner expects: further edges at a vertex met by d edges, the chance that two such vertices are an edge."""
    m = planner.Moments.of(g)
    from math import log

    rows = [(d, round(log(m.grown(d)), 9), round(log(min(1.0, m.closed(d, d))), 9)) for d in range(4)]
    return g.edges.sparkSession.createDataFrame(rows, "d int, ln_grown double, ln_closed double")


def _estimates(g: Graph) -> DataFrame:
    """Logarithms of the expected matches of patterns, for uniform edges and for degrees as they are."""
    from math import log

    m = planner.Moments.of(g)
    rows = [(n, *(round(log(planner.estimate(frozenset(PATTERNS[n].edges), m, model)), 9) for model in ("uniform", "power_law"))) for n in ("triangle", "square")]
    return g.edges.sparkSession.createDataFrame(rows, "pattern string, ln_uniform double, ln_degrees double")


on_graph("planner_moments", _moments)
on_graph("planner_estimates", _estimates)


def _parts(spark: SparkSession, _: str) -> DataFrame:
    """Connected sets of edges of the house by their number of edges, and how many may be join units."""
    from collections import Counter

    parts = planner.connected_parts(PATTERNS["house"])
    rows = [(k, n, *(sum(len(p) == k and f(p) for p in parts) for f in planner.UNITS.values())) for k, n in sorted(Counter(map(len, parts)).items())]
    return spark.createDataFrame(rows, "edges int, parts int, star int, local int, clique int")


QUERIES["planner_parts"] = _parts
# --- edits of a graph
on_graph("edges_removed", lambda g: g.without_edges([(1, 0), (2, 3)]).without_vertices([5, 7]).edges)
on_graph("edges_added", lambda g: g.with_edges([(1, 0), (0, 1), (900_000, 2)]).degrees)
# --- all pairs of an order
ORDERS = ("degrees", "oriented_edges", "degree_power_sums", "largest_degree", "triangles", "square_count", "chordalsquare_count", "clique4_count", "clique5_count", "clique6_count", "house_count", "solarsquare_count", "twintriangle_count", "near5clique_count")
for _n in ORDERS:
    QUERIES[f"orders_{_n}"] = lambda spark, sf_dir, n=_n: ON_GRAPH[n](graph(spark, sf_dir, None))
QUERIES["orders_undirected_edges"] = lambda spark, sf_dir: prepare.undirect(raw_pairs(spark, sf_dir, None, clean=False), parts=parts_of(spark, sf_dir))

# --- SQL

_ID = "% 4294967296"
_CTES = {
    "pe": "select distinct least(a.l_partkey, b.l_partkey) as a, greatest(a.l_partkey, b.l_partkey) as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey",
    "deg": "select v, count(*) as deg from (select a as v from pe union all select b from pe) group by v",
    "e": "select least(p, q) as u, greatest(p, q) as w from (select x.deg * 4294967296 + pe.a as p, y.deg * 4294967296 + pe.b as q from pe join deg x on x.v = pe.a join deg y on y.v = pe.b)",
    "adj": "select u as v, w as n from e union all select w, u from e",
    "t1": "select a.w as x, b.w as y, a.u as z from e a join e b on a.u = b.u and a.w < b.w",
    "t2": "select a.u as x, b.w as y, a.w as z from e a join e b on a.w = b.u",
    "t3": "select a.u as x, b.u as y, a.w as z from e a join e b on a.w = b.w and a.u < b.u",
    "w": "select a.n as x, b.n as y, a.v as z from adj a join adj b on a.v = b.v and a.n < b.n",
    "tri": "select t1.z as v1, t1.x as v2, t1.y as v3 from t1 join e on e.u = t1.x and e.w = t1.y",
    "te": "select v2 as x, v3 as y, v1 as z from tri union all select v1, v3, v2 from tri union all select v1, v2, v3 from tri",
    "sq": "select p.z as v1, p.x as v2, q.z as v3, p.y as v4 from w p join w q on p.x = q.x and p.y = q.y where p.z < p.x and p.z < q.z",
    "cs": "select a.x, a.y, a.z as p, b.z as q from te a join te b on a.x = b.x and a.y = b.y and a.z < b.z",
    "k4": "select a.v1, a.v2, a.v3, b.v3 as v4 from tri a join tri b on a.v1 = b.v1 and a.v2 = b.v2 and a.v3 < b.v3 join e on e.u = a.v3 and e.w = b.v3",
    "k5": "select a.v1, a.v2, a.v3, a.v4, b.v4 as v5 from k4 a join k4 b on a.v1 = b.v1 and a.v2 = b.v2 and a.v3 = b.v3 and a.v4 < b.v4 join e on e.u = a.v4 and e.w = b.v4",
    "k6": "select a.v1, a.v2, a.v3, a.v4, a.v5, b.v5 as v6 from k5 a join k5 b on a.v1 = b.v1 and a.v2 = b.v2 and a.v3 = b.v3 and a.v4 = b.v4 and a.v5 < b.v5 join e on e.u = a.v5 and e.w = b.v5",
    "tv": "select v1 as c, v2 as a, v3 as b from tri union all select v2, v1, v3 from tri union all select v3, v1, v2 from tri",
    "wh": "select x as hub, p, q, y as z from cs union all select y, p, q, x from cs",
    "side": "select v1 as a, v2 as b, v3 as o1, v4 as o2 from sq union all select v1, v4, v2, v3 from sq union all select least(v2, v3), greatest(v2, v3), v1, v4 from sq union all select least(v3, v4), greatest(v3, v4), v1, v2 from sq",
    "k4side": "select v1 as a, v2 as b, v3 as o1, v4 as o2 from k4 union all select v1, v3, v2, v4 from k4 union all select v1, v4, v2, v3 from k4 union all select v2, v3, v1, v4 from k4 union all select v2, v4, v1, v3 from k4 union all select v3, v4, v1, v2 from k4",
    "fa": "select y as h, q as m, x as p, p as o from cs union all select y, p, x, q from cs union all select x, q, y, p from cs union all select x, p, y, q from cs",
    "fan": "select a.h, a.m from fa a join fa b on a.h = b.h and a.m = b.m and a.p < b.p and a.o <> b.o and a.o <> b.p and a.p <> b.o",
    "sig": f"select v, string_agg(n {_ID}, ',' order by n {_ID}) as open, count(*) as d from adj group by v",
    "csig": f"select v, string_agg(n {_ID}, ',' order by n {_ID}) as closed from (select v, n from adj union select v, v from adj) group by v",
    "true_twins": "select v as member, min(v) over (partition by closed) as rep, count(*) over (partition by closed) as k from csig",
    "false_twins": "select v as member, min(v) over (partition by open) as rep, count(*) over (partition by open) as k from sig",
    "k7": "select a.v1, a.v2, a.v3, a.v4, a.v5, a.v6, b.v6 as v7 from k6 a join k6 b on a.v1 = b.v1 and a.v2 = b.v2 and a.v3 = b.v3 and a.v4 = b.v4 and a.v5 = b.v5 and a.v6 < b.v6 join e on e.u = a.v6 and e.w = b.v6",
    "k8": "select a.v1, a.v2, a.v3, a.v4, a.v5, a.v6, a.v7, b.v7 as v8 from k7 a join k7 b on a.v1 = b.v1 and a.v2 = b.v2 and a.v3 = b.v3 and a.v4 = b.v4 and a.v5 = b.v5 and a.v6 = b.v6 and a.v7 < b.v7 join e on e.u = a.v7 and e.w = b.v7",
    "kl": " union all ".join(f"select {k} as k, [{', '.join(f'v{i}' for i in range(1, k + 1))}] as c from {'tri' if k == 3 else f'k{k}'}" for k in range(3, 9)),
    # a clique that is part of one with a vertex more isn't maximal
    "mx": f"select k, list_sort([x {_ID} for x in c]) as members from kl where not exists (select 1 from (select k - 1 as k, list_filter(c, lambda y, i: i <> j) as c from kl, unnest(range(1, 9)) t(j) where j <= kl.k and kl.k > 3) s where s.k = kl.k and s.c = kl.c)",
    "he": "select unnest([1, 2, 4, 8, 16, 32]) as bit, unnest([3, 9, 17, 6, 18, 12]) as vs",
    "part": "select bit as es, vs from he union select part.es | he.bit, part.vs | he.vs from part join he on part.es & he.bit = 0 and part.vs & he.vs <> 0",
    "hv": "select t.member, case when t.k > 1 then t.rep when f.k > 1 then f.rep else t.member end as rep, case when t.k > 1 then 'clique' when f.k > 1 then 'set' else 'single' end as kind from true_twins t join false_twins f using (member)",
}


def sql(body: str, days: int | None = DAYS) -> str:
    """The body with the common tables that it needs, over the graph of so many days."""
    need: list[str] = []

    def visit(text: str, of: str = "") -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", text):
            if name in _CTES and name != of and name not in need:
                visit(_CTES[name], name)
                need.append(name)

    visit(body)
    text = _CTES if days is None else _CTES | {"pe": _CTES["pe"] + f" and abs(date_diff('day', a.l_shipdate, b.l_shipdate)) <= {days}"}
    recursive = "recursive " * ("part" in need)
    return (f"with {recursive}" + ",\n".join(f"{n} as {'' if n == 'part' else 'materialized '}({text[n]})" for n in need) + "\n" if need else "") + body


def _table(table: str, *columns: str, where: str = "") -> str:
    return f"select {', '.join(f'{c} {_ID} as {c}' for c in columns)} from {table} {where}"


def _counted(table: str) -> str:
    return f"select cast(count(*) as bigint) as cnt from {table}"


def _list(expression: str, where: str = "") -> str:
    return f"coalesce(string_agg(cast({expression} {_ID} as varchar), ',' order by {expression} {_ID}) {where}, '')"


_HOUSES = "side join te on te.x = a and te.y = b and te.z <> o1 and te.z <> o2"
_NEAR = "k4side join te on te.x = a and te.y = b and te.z <> o1 and te.z <> o2"
_BOWS = "tv l join tv r on l.c = r.c and l.a < r.a and l.b <> r.a and l.b <> r.b"
_WHEELS = "select cast(coalesce(sum(l * (2 * n - 1 - l) // 2), 0) as bigint) as cnt from (select count(*) as n, count_if(z < p) as l from wh group by hub, p, q)"
_SIDES = f"select v {_ID} as v, {_list('n', 'filter (where n < v)')} as smaller, {_list('n', 'filter (where n > v)')} as larger from adj"

_BODIES = {
    **{n: "select a, b from pe" for n in ("undirected_edges", "edges_text", "edges_table", "edges_two_inputs", "edges_once")},
    "local_graph_triangles": "select * from (values (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)) t(v1, v2, v3)",
    "clique_debug": f"select v1 {_ID} as v, count(*) as joined, count(*) as encoded from k4 group by v1",
    "nation_false_twins": "select 1000 + c_custkey as member, 1000 + rep as rep from (select c_custkey, min(c_custkey) over (partition by c_nationkey) as rep, count(*) over (partition by c_nationkey) as k from customer) where k > 1",
    "hyper_statistics": "select kind, count(distinct rep) as classes, count(*) as members, max(es) as edges from hv join (select kind as on_kind, count(*) as es from (select a.kind from e join hv a on a.member = e.u union all select b.kind from e join hv a on a.member = e.u join hv b on b.member = e.w where a.kind <> b.kind) group by kind) t on on_kind = kind group by kind",
    "house_compressed": f"select a {_ID} as x, b {_ID} as y, o1 {_ID} as o1, o2 {_ID} as o2, {_list('z')} as apexes from (select row_number() over () as r, * from side) {_HOUSES.removeprefix('side ')} group by r, a, b, o1, o2",
    "near5clique_compressed": f"select a {_ID} as x, b {_ID} as y, o1 {_ID} as o1, o2 {_ID} as o2, {_list('z')} as apexes from {_NEAR} group by a, b, o1, o2",
    "solarsquare_compressed": f"select hub {_ID} as hub, p {_ID} as p, q {_ID} as q, {_list('z')} as mids from wh group by wh.hub, wh.p, wh.q having count(*) > 1 and min(z) < wh.p",
    "twintriangle_compressed": f"select c {_ID} as c, string_agg(l || '-' || r, ',' order by l, r) as edges from (select c, least(a {_ID}, b {_ID}) as l, greatest(a {_ID}, b {_ID}) as r from tv) group by c having count(*) > 1",
    "maximal_cliques": "select array_to_string(members, ',') as members from mx",
    "largest_clique_size": "select cast(max(k) as bigint) as size from kl",
    "planner_moments": "select cast(d as int) as d, round(ln(q / p), 9) as ln_grown, round(ln(least(1.0, q / p * q / p / s)), 9) as ln_closed from (select unnest([0, 1, 2, 3]) as d, unnest([sum(deg ** 0), sum(deg ** 1), sum(deg ** 2), sum(deg ** 3)]) as p, unnest([sum(deg ** 1), sum(deg ** 2), sum(deg ** 3), sum(deg ** 4)]) as q, sum(deg) as s from deg)",
    "planner_estimates": "select unnest(['triangle', 'square']) as pattern, unnest([round(ln(s ** 3 / n ** 3), 9), round(ln(s ** 4 / n ** 4), 9)]) as ln_uniform, unnest([round(ln(n * g0 * g1 * least(1.0, g1 * g1 / s)), 9), round(ln(n * g0 * g1 * g1 * least(1.0, g1 * g1 / s)), 9)]) as ln_degrees from (select sum(deg ** 0) as n, sum(deg ** 1) as s, sum(deg ** 1) / sum(deg ** 0) as g0, sum(deg ** 2) / sum(deg ** 1) as g1 from deg)",
    # a star has a vertex in all its edges, a local part one that is joined to all others, a clique all pairs
    "planner_parts": "select bit_count(es) as edges, cast(count(*) as int) as parts, cast(count_if(star) as int) as star, cast(count_if(near + 1 = nv) as int) as local, cast(count_if(star or 2 * bit_count(es) = nv * (nv - 1)) as int) as clique from (select es, bit_count(p.vs) as nv, max(d) as near, max(d) = bit_count(es) as star from (select p.es, p.vs, v, count(*) as d from (select distinct es, vs from part) p join he on p.es & he.bit <> 0 cross join unnest([1, 2, 4, 8, 16]) t(v) where he.vs & v <> 0 group by p.es, p.vs, v) p group by es, p.vs) group by bit_count(es)",
    "edges_removed": "select a, b from pe where not (a = 0 and b = 1) and not (a = 2 and b = 3) and a not in (5, 7) and b not in (5, 7)",
    "edges_added": "select v, count(*) as deg from (select a as v from x union all select b from x) group by v".replace("from x", "from (select a, b from pe union select * from (values (0, 1), (2, 900000)) t(a, b))"),
    "sample_vertices_hash": "select a, b from pe where {} < 1073741823 and {} < 1073741823".format(*(f"((42 + {c} % 2147483647 * 48271) * 69621 % 2147483647 * 48271) % 2147483647" for c in "ab")),
    "sample_edges_hash": "select a, b from (select a, b, ((42 + a % 2147483647 * 48271) * 69621 % 2147483647 * 48271) % 2147483647 as h from pe) where ((h + b % 2147483647 * 48271) * 69621 % 2147483647 * 48271) % 2147483647 < 429496729",
    "degrees": "select v, deg from deg",
    "oriented_edges": _table("e", "u", "w"),
    "oriented_edges_pruned": _table("e", "u", "w", where="where u // 4294967296 > 1"),
    "adjacency": f"{_SIDES} group by v",
    "adjacency_large_degree": f"{_SIDES} where n // 4294967296 >= 12 group by v",
    "nonsmall_vertices": f"select distinct u {_ID} as v from e where u not in (select w from e)",
    "degree_power_sums": " union all ".join(f"select cast({i} as bigint) as i, cast(sum(deg ** {i}) as bigint) as total from deg" for i in range(5)),
    "largest_degree": "select v, deg from deg order by deg desc, v limit 1",
    "max_order_neighbour": f"select v {_ID} as v, max(n) {_ID} as n, max(n) // 4294967296 as deg from adj group by v",
    **{f"twintwig{k}": _table(f"t{k}", "x", "y", "z") for k in (1, 2, 3)},
    "distinct_twintwig": f"select x {_ID} as x, y {_ID} as y, count(*) as times from t1 group by t1.x, t1.y",
    "twintwig_known_edges": _table("tri", "v2", "v3", "v1").replace("as v2", "as x").replace("as v3", "as y").replace("as v1", "as z"),
    "stars_3": f"select a.u {_ID} as c, a.w {_ID} as l1, b.w {_ID} as l2, d.w {_ID} as l3 from e a join e b on a.u = b.u and a.w < b.w join e d on d.u = a.u and b.w < d.w",
    "triangles": _table("tri", "v1", "v2", "v3"),
    "edge_apexes": _table("te", "x", "y", "z"),
    "squares_on_edges": f"select a {_ID} as x, b {_ID} as y, count(*) as k from side group by side.a, side.b",
    "square_enum": _table("sq", "v1", "v2", "v3", "v4"),
    "square_compressed": f"select x {_ID} as x, y {_ID} as y, {_list('z')} as mids from w group by w.x, w.y having count(*) > 1 and min(z) < w.x",
    "chordalsquare_enum": _table("cs", "x", "y", "p", "q"),
    "chordalsquare_compressed": f"select x {_ID} as x, y {_ID} as y, {_list('z')} as apexes from te group by te.x, te.y having count(*) > 1",
    "clique4_enum": _table("k4", "v1", "v2", "v3", "v4"),
    "clique5_enum": _table("k5", "v1", "v2", "v3", "v4", "v5"),
    "clique5_encoded_enum": _table("k5", "v1", "v2", "v3", "v4", "v5"),
    "clique4_per_vertex": f"select v1 {_ID} as v, count(*) as cnt from k4 group by v1",
    "clique4_encoded_counts": f"select v1 {_ID} as v, count(*) as cnt from k4 group by v1",
    "qt_counter": f"select v1 {_ID} as v, count(*) as cnt from k5 group by v1",
    "clique4_compressed": f"select v1 {_ID} as v1, v2 {_ID} as v2, v3 {_ID} as v3, {_list('v4')} as last from k4 group by k4.v1, k4.v2, k4.v3",
    **{n: _counted("sq") for n in ("square_count", "square_partitioned", "hyper_square_count", "twintwig_square", "planned_square")},
    **{n: _counted("cs") for n in ("chordalsquare_count", "chordalsquare_nonoverlap", "twintwig_chordalsquare", "planned_chordalsquare")},
    **{n: _counted(f"k{k}") for k in (4, 5, 6) for n in (f"clique{k}_count", f"twintwig_clique{k}")},
    **{n: _counted("k5") for n in ("clique_star_topdown", "clique_star_bottomup")},
    **{n: _counted(_HOUSES) for n in ("house_count", "house_partitioned", "house_stored", "pattern_file_count", "hyper_house_count", "house_join_count", "house_nonoverlap", "twintwig_house", "planned_house")},
    **{n: _WHEELS for n in ("solarsquare_count", "solarsquare_partitioned", "solarsquare_leftdeep", "twintwig_solarsquare", "planned_solarsquare")},
    "solarsquare_enum": f"select a.hub {_ID} as hub, a.z {_ID} as v1, a.p {_ID} as v2, b.z {_ID} as v3, a.q {_ID} as v4 from wh a join wh b on a.hub = b.hub and a.p = b.p and a.q = b.q and a.z < b.z where a.z < a.p",
    **{n: _counted(_BOWS) for n in ("twintriangle_count", "twintriangle_partitioned", "twintriangle_join_count", "twintwig_twintriangle")},
    "twintriangle_per_vertex": f"select c {_ID} as v, count(*) as triangles from tv group by c",
    **{n: _counted(_NEAR) for n in ("near5clique_count", "near5clique_partitioned", "near5clique_stored", "near5clique_join_count", "twintwig_near5clique")},
    **{n: _counted("fan") for n in ("tcsquare_count", "tcsquare_join_count", "tcsquare_leftdeep", "quadtriangle_count", "quadtriangle_leftdeep")},
    "quadtriangle_per_hub": f"select h {_ID} as h, count(*) as cnt from fan group by fan.h",
    "hyper_true_twins": f"select member {_ID} as member, rep {_ID} as rep from true_twins where k > 1",
    "hyper_false_twins": f"select member {_ID} as member, rep {_ID} as rep from false_twins where k > 1",
    "hyper_vertices": f"select member {_ID} as member, rep {_ID} as rep, kind from hv",
    "hyper_edges": f"select distinct least(a.rep, b.rep) {_ID} as p, greatest(a.rep, b.rep) {_ID} as q from e join hv a on a.member = e.u join hv b on b.member = e.w where a.rep <> b.rep",
    "hyper_triangle_count": _counted("tri"),
    "hyper_expanded": _table("e", "u", "w"),
    "degree_limit": f"select least(v, n) {_ID} as u, greatest(v, n) {_ID} as w from (select v, n from (select v, n, row_number() over (partition by v order by n) as r from adj) where r <= 8) group by least(v, n), greatest(v, n) having count(*) = 2",
    "sample_vertices_modulo": "select a, b from pe where a % 5 < 3 and b % 5 < 3",
    "sample_edges_modulo": "select a, b from pe where (a + b) % 5 < 1",
    # three triangles around a vertex: a triangle on a side of a chordal square; either inner edge may be the chord
    "planned_chordalhouse": "select cast(count(*) // 2 as bigint) as cnt from (select unnest([least(x, p), least(x, q), least(y, p), least(y, q)]) as a, unnest([greatest(x, p), greatest(x, q), greatest(y, p), greatest(y, q)]) as b, unnest([y, y, x, x]) as o1, unnest([q, p, q, p]) as o2 from cs) s join te on te.x = s.a and te.y = s.b and te.z <> s.o1 and te.z <> s.o2",
}

#: Bodies over the dense graph that count without listing the matches.
_CLOSED = {
    "undirected_edges": "select a, b from pe",
    "square_count": "select cast(coalesce(sum(n * (n - 1) // 2), 0) // 2 as bigint) as cnt from (select count(*) as n from w group by w.x, w.y)",
    "chordalsquare_count": "select cast(coalesce(sum(n * (n - 1) // 2), 0) as bigint) as cnt from tn",
    # squares on an edge are paths over one of its ends, each closed by a further common neighbour
    "house_count": "select cast((select sum((cn.n - 1) * (coalesce(p.n, 0) + coalesce(q.n, 0))) // 2 from w join cn on cn.x = w.x and cn.y = w.y left join tn p on p.x = least(w.x, z) and p.y = greatest(w.x, z) left join tn q on q.x = least(w.y, z) and q.y = greatest(w.y, z)) - (select sum(2 * n * (n - 1)) from tn) as bigint) as cnt",
    "twintriangle_count": "select cast((select sum(n * (n - 1) // 2) from (select count(*) as n from tv group by c)) - (select sum(n * (n - 1)) from tn) as bigint) as cnt",
    "near5clique_count": "select cast(coalesce(sum(k * (n - 2)), 0) as bigint) as cnt from (select a, b, count(*) as k from k4side group by k4side.a, k4side.b) s join tn on tn.x = s.a and tn.y = s.b",
}
_CTES |= {"tn": "select x, y, count(*) as n from te group by te.x, te.y", "cn": "select x, y, count(*) as n from w group by w.x, w.y"}

ORACLE_SQL = {name: sql(body, TWIN_DAYS if name.startswith("hyper_") else DAYS) for name, body in _BODIES.items()}
ORACLE_SQL |= {f"orders_{name}": sql(_CLOSED.get(name, _BODIES[name]), None) for name in (*ORDERS, "undirected_edges")}
