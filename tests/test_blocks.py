"""Operators in blocks against brute force, and that no query sends a row for each wedge."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from test_graph import brute, clique, number, random_edges

from patternweave import PATTERNS, Graph, queries
from patternweave.operators import blocks, cliques, patterns
from patternweave.plans import run, star
from patternweave.queries import ON_GRAPH


def shuffled(spark, df):
    """The first row of ``df`` and the records that stages of its run sent."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        listed = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {listed.apply(i).stageId(): listed.apply(i).shuffleWriteRecords() for i in range(listed.size())}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    out = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for s, n in stages().items() if s not in before)


@pytest.fixture
def many(monkeypatch):
    """Blocks so small that a few edges fill several."""
    monkeypatch.setattr(blocks, "MOST", 12)
    monkeypatch.setattr(blocks, "LEAST", 1)
    monkeypatch.setattr(blocks, "WEDGES", 5)


@pytest.fixture(scope="module")
def hubs(spark):
    """Two vertices joined to 1,500 others, of which each is joined to the next: many wedges, few triangles."""
    edges = [(h, v) for h in (0, 1) for v in range(2, 1502)] + [(v, v + 1) for v in range(2, 1501)]
    g = Graph.from_pairs(spark, edges, keep=True)
    yield g, len(edges)
    g.release()


@pytest.fixture(scope="module")
def dense(spark):
    """A dense graph that has about twenty wedges an edge."""
    edges = random_edges(7, n=60, p=0.7)
    g = Graph.from_pairs(spark, edges, keep=True)
    g.oriented.count()
    yield g, len(edges)
    g.release()


@pytest.fixture(scope="module")
def sparse(spark):
    """Two hubs over a ring that is joined to its next but one: over a hundred wedges an edge."""
    edges = [(h, v) for h in (0, 1) for v in range(2, 402)] + [(v, v + k) for k in (1, 2) for v in range(2, 400)]
    g = Graph.from_pairs(spark, edges, keep=True)
    g.oriented.count()
    yield g, len(edges)
    g.release()


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = random_edges(9, n=11, p=0.5)
    g = Graph.from_pairs(spark, edges, keep=True)
    yield g, edges
    g.release()


def test_triangles_of_many_blocks(spark, many):
    edges = random_edges(3, n=9, p=0.6)
    g = Graph.from_pairs(spark, edges)
    rows = [tuple(r) for r in g.triangles.collect()]
    assert g.colours.number > 3 and len(rows) == len(set(rows)) == brute(edges, clique(3))


def test_triangles_send_no_wedges(spark, dense):
    g, edges = dense
    out, sent = shuffled(spark, lambda: ON_GRAPH["triangles"](g))
    assert len(out) > 5 * edges and sent < 4 * edges


def test_colours_split_heavy_ranges():
    c = blocks.Colours.cut(4, np.array([50, 5, 3, 4, 900, 2]), 964, 100)
    ids = np.arange(96)
    seen = c(ids | (7 << 32))
    assert c.number == seen.max() + 1 and len(set(seen[64:80])) > 3 and len(set(seen[:16])) == 1
    assert (c(ids) == seen).all()


def test_squares_of_many_blocks(spark, many):
    edges = random_edges(4, n=9, p=0.6)
    assert number(run.square_count(Graph.from_pairs(spark, edges))) == brute(edges, PATTERNS["square"])


def test_squares_send_no_wedges(spark, dense):
    g, edges = dense
    out, sent = shuffled(spark, lambda: run.square_count(g))
    assert out[0][0] > 100 * edges and sent < 4 * edges


def test_squares_of_hubs(spark, hubs, monkeypatch):
    """A pair of hubs with 1,500 common neighbours, whose wedges don't fit one step."""
    g, _ = hubs
    monkeypatch.setattr(blocks, "WEDGES", 100)
    assert number(run.square_count(g)) == 1500 * 1499 // 2 + 2 * 1498


def test_houses_of_many_blocks(spark, many):
    edges = random_edges(5, n=8, p=0.6)
    assert number(run.house_count(Graph.from_pairs(spark, edges))) == brute(edges, PATTERNS["house"])


def test_houses_send_no_wedges(spark, dense):
    g, edges = dense
    assert shuffled(spark, lambda: run.house_count(g))[1] < 12 * edges


def test_apex_counts_of_many_blocks(spark, many):
    edges = random_edges(6, n=9, p=0.6)
    g = Graph.from_pairs(spark, edges)
    assert sum(r.n for r in patterns.apex_counts(g).collect()) == 3 * brute(edges, clique(3))
    assert number(run.chordal_square_count(g)) == brute(edges, PATTERNS["chordalsquare"])


def test_chordal_squares_send_no_wedges(spark, dense):
    g, edges = dense
    assert shuffled(spark, lambda: run.chordal_square_count(g))[1] < 6 * edges


def test_bow_ties_send_no_wedges(spark, dense):
    g, edges = dense
    assert shuffled(spark, lambda: run.twin_triangle_count(g))[1] < 10 * edges


def test_parts_follow_the_lines(spark, sf_dir, monkeypatch):
    """Pairs of lines were held in as few parts as their compressed size asked for."""
    monkeypatch.setattr(queries, "LINES", 500)
    assert queries.parts_of(spark, sf_dir) == 12
    g = Graph(queries.raw_pairs(spark, sf_dir, None), parts=12)
    assert g.edges.rdd.getNumPartitions() == 12
    assert ON_GRAPH["degree_power_sums"](g).count() == 5


def test_degrees_of_many_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "LINES", 500)
    raw = queries.raw_pairs(spark, sf_dir, None)
    assert sorted(Graph(raw, parts=12).degrees.collect()) == sorted(Graph(raw).degrees.collect())


def test_oriented_edges_of_many_parts(spark, sf_dir, monkeypatch):
    """Both joins with degrees are dealt in as many parts as the edges."""
    monkeypatch.setattr(queries, "LINES", 500)
    raw = queries.raw_pairs(spark, sf_dir, None)
    g = Graph(raw, parts=12)
    assert g.oriented.rdd.getNumPartitions() == 12
    assert sorted(g.oriented.collect()) == sorted(Graph(raw).oriented.collect())


@pytest.mark.parametrize("k", [4, 5, 6])
def test_cliques_send_triangles_once(spark, dense, k):
    g, edges = dense
    want = sum(1 for _ in star.cliques(g, k).collect())
    g.triangles.count()
    out, sent = shuffled(spark, lambda: ON_GRAPH[f"clique{k}_count"](g))
    assert out[0][0] == want > g.triangles.count() and sent < 1.1 * g.triangles.count()


def test_cliques_in_small_steps(spark, dense, monkeypatch):
    """Runs of local graphs and pairs of cliques that don't fit one step."""
    g, _ = dense
    want = cliques.cliques(g, 5).collect()
    monkeypatch.setattr(cliques, "PAIRS", 7)
    v, a, b = (np.array(c) for c in zip(*sorted(tuple(r) for r in g.triangles.collect()), strict=True))
    rows = [r for found in cliques.grown(v, a, b, 5) for r in zip(*(c.tolist() for c in found), strict=True)]
    assert len(rows) == len(set(rows)) and sorted(rows) == sorted(tuple(r) for r in want)


@pytest.mark.parametrize("least", [1, 3, 100])
def test_runs_cut_no_group(least):
    v = np.repeat([1, 2, 5, 9], [4, 1, 7, 2])
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i : i + 3]), pa.array(np.arange(i, min(i + 3, 14)))], names=["v", "i"]) for i in range(0, 14, 3)]
    runs = list(cliques.whole_groups(iter(batches), least))
    assert np.concatenate([r[1] for r in runs]).tolist() == list(range(14))
    assert sum(len(set(r[0].tolist())) for r in runs) == 4


def test_near_5_cliques_send_no_cliques(spark, dense):
    g, edges = dense
    want = patterns.near_5_cliques(g, cliques.cliques(g, 4)).count()
    out, sent = shuffled(spark, lambda: run.near_5_clique_count(g))
    assert out[0][0] == want and sent < 1.1 * g.triangles.count() + 20 * edges


def test_wheels_send_no_chordal_squares(spark, dense):
    g, _ = dense
    want = patterns.solar_squares(g).count()
    out, sent = shuffled(spark, lambda: run.solar_square_count(g))
    assert out[0][0] == want and sent < 3.3 * g.triangles.count()


def test_clique_collapse_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "clique_collapse")


def searched_in_groups(g, name):
    """Whether a query starts Python anew for each vertex."""
    return "FlatMapGroupsInPandas" in ON_GRAPH[name](g)._jdf.queryExecution().optimizedPlan().toString()


def test_maximal_cliques_of_many_at_a_time(spark, small_graph):
    g, edges = small_graph
    near = {frozenset(e) for e in edges}
    vs = sorted({v for e in edges for v in e})
    whole = [set(c) for k in range(1, len(vs) + 1) for c in combinations(vs, k) if all(frozenset(p) in near for p in combinations(c, 2))]
    for least in (2, 3):
        want = sorted(sorted(c) for c in whole if len(c) >= least and not any(c < d for d in whole))
        assert sorted(r.members for r in cliques.maximal_cliques(g, least).collect()) == want
    assert not searched_in_groups(g, "maximal_cliques")


def test_disjoint_cliques_of_many_at_a_time(small_graph):
    """Each is maximal, none shares a vertex, and every other one meets one that comes first."""
    g, _ = small_graph
    every = [r.members for r in cliques.maximal_cliques(g, 3).collect()]
    kept, used = [], set()
    for c in sorted(every, key=lambda c: (-len(c), c)):
        if not used & set(c):
            kept.append(c)
            used |= set(c)
    assert sorted(r.members for r in cliques.disjoint_cliques(g, 3).collect()) == sorted(kept)
    assert not searched_in_groups(g, "maximal_cliques")


def test_clique_cover_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "clique_cover")


def test_clique_debug_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "clique_debug")


def test_clique5_encoded_enum_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "clique5_encoded_enum")


def test_clique4_encoded_counts_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "clique4_encoded_counts")


def test_largest_clique_size_of_many_at_a_time(small_graph):
    assert not searched_in_groups(small_graph[0], "largest_clique_size")


def test_met_wedges_of_many_blocks(spark, many):
    edges = random_edges(8, n=10, p=0.5)
    near = {v: {b for e in edges for a, b in (e, e[::-1]) if a == v} for v in range(10)}
    want = {(frozenset(p), frozenset(near[p[0]] & near[p[1]])) for p in combinations(range(10), 2) if len(near[p[0]] & near[p[1]]) > 1}
    rows = Graph.from_pairs(spark, edges).met.collect()
    assert len(rows) == len(want) and {(frozenset(v & 0xFFFFFFFF for v in (r.x, r.y)), frozenset(v & 0xFFFFFFFF for v in r.mids)) for r in rows} == want
    assert all(r.x < r.y and r.mids == sorted(r.mids) for r in rows)


def test_square_chunks_send_no_wedges(spark, hubs):
    g, edges = hubs
    out, sent = shuffled(spark, lambda: ON_GRAPH["square_partitioned"](g))
    assert out[0][0] == 1500 * 1499 // 2 + 2 * 1498 and sent < 10 * edges


def test_chordalsquare_nonoverlap_sends_no_wedges(spark, sparse):
    g, edges = sparse
    out, sent = shuffled(spark, lambda: ON_GRAPH["chordalsquare_nonoverlap"](g))
    assert out[0][0] == number(run.COUNTS["chordalsquare"](g)) and sent < 14 * edges


def test_twintwig_chordalsquare_sends_no_wedges(spark, sparse):
    g, edges = sparse
    out, sent = shuffled(spark, lambda: ON_GRAPH["twintwig_chordalsquare"](g))
    assert out[0][0] == number(run.COUNTS["chordalsquare"](g)) and sent < 10 * edges


def test_twintwig_solarsquare_sends_no_wedges(spark, sparse):
    g, edges = sparse
    out, sent = shuffled(spark, lambda: ON_GRAPH["twintwig_solarsquare"](g))
    assert out[0][0] == number(run.COUNTS["solarsquare"](g)) and sent < 60 * edges


def test_planned_house_sends_no_wedges(spark, sparse):
    g, edges = sparse
    out, sent = shuffled(spark, lambda: ON_GRAPH["planned_house"](g))
    assert out[0][0] == number(run.COUNTS["house"](g)) and sent < 40 * edges


def test_house_from_a_file_joins_a_square(spark, sparse):
    """The square of a house is a unit of its plan, found in blocks, not a path that is closed in the end."""
    from patternweave.plans import planner

    g, _ = sparse
    step = planner.decompose(PATTERNS["house"], planner.Moments.of(g), squares=True)
    assert any(line.strip().startswith("square") for line in step.lines())
    assert number(patterns.count(planner.match(g, PATTERNS["house"]))) == number(run.house_count(g))


def test_planned_triangles_are_the_graphs(spark, sparse):
    """Cliques of a plan are placed from the graph's, so no wedge is made for them."""
    from patternweave.plans import planner

    g, _ = sparse
    n = g.triangles.count()
    out, sent = shuffled(spark, lambda: planner._unit(g, frozenset({(1, 2), (1, 3), (2, 3)}), [(1, 2)])[0])
    assert len(out) == len(set(out)) == 3 * n and sent == 0


def test_planned_solarsquare_sends_no_wedges(spark, sparse):
    g, edges = sparse
    out, sent = shuffled(spark, lambda: ON_GRAPH["planned_solarsquare"](g))
    assert out[0][0] == number(run.COUNTS["solarsquare"](g)) and sent < 40 * edges
