"""Options do what they say, or are refused."""

import pytest

from patternweave import Graph, Options
from patternweave.operators import cliques
from patternweave.plans import run
from patternweave.plans.patterns import PATTERNS
from patternweave.sources.tables import Stages
from test_graph import brute, random_edges


@pytest.mark.parametrize("options", [{"clique_threshold": 5}, {"query": "clique", "partition_threshold": 4}, {"query": "house", "partition_threshold": 4, "left_deep": True}, {"query": "square", "stages": "/x"}])
def test_options_without_a_plan_are_refused(options):
    with pytest.raises(ValueError):
        run.refuse(Options(**options))


@pytest.fixture(scope="module")
def dense(spark):
    edges = random_edges(5, n=11, p=0.6)
    return edges, Graph.from_pairs(spark, edges, keep=True)


@pytest.mark.parametrize("query", run.CHUNKED)
@pytest.mark.parametrize("options", [{"partition_threshold": 2}, {"hypergraph": True}, {"partition_threshold": 3, "hypergraph": True}])
def test_counts_in_chunks_and_from_classes(dense, query, options):
    edges, g = dense
    assert run.run(g, Options(query=query, **options)).collect()[0][0] == brute(edges, PATTERNS[query])


@pytest.mark.parametrize("query", ["house", "near5clique"])
@pytest.mark.parametrize("threshold", [0, 2])
def test_compressed_rows_hold_every_match(dense, query, threshold):
    edges, g = dense
    rows = run.run(g, Options(query=query, count_only=False, partition_threshold=threshold)).collect()
    assert sum(len(r.apexes) for r in rows) == brute(edges, PATTERNS[query])
    assert not threshold or max(len(r.apexes) for r in rows) <= threshold


def test_tcsquare_plans_agree(dense):
    edges, g = dense
    want = brute(edges, PATTERNS["tcsquare"])
    for o in (Options(query="tcsquare"), Options(query="quadtriangle"), Options(query="quadtriangle", left_deep=True), Options(query="tcsquare", left_deep=True)):
        assert run.run(g, o).collect()[0][0] == want


def test_stored_stages_are_read_again(spark, dense, tmp_path):
    edges, g = dense
    o = Options(query="house", stages=f"file://{tmp_path}/s")
    assert run.run(g, o).collect()[0][0] == brute(edges, PATTERNS["house"])
    stages = Stages(spark, f"file://{tmp_path}/s")
    assert stages.get("squares", lambda: 1 / 0).count() == brute(edges, PATTERNS["square"])
    stages.drop("squares")
    with pytest.raises(ZeroDivisionError):
        stages.get("squares", lambda: 1 / 0)


def test_edits(spark, dense):
    edges, g = dense
    kept = sorted(edges)[2:]
    assert {tuple(r) for r in g.without_edges([e[::-1] for e in sorted(edges)[:2]]).edges.collect()} == set(kept)
    assert {tuple(r) for r in g.without_vertices([1, 2]).edges.collect()} == {e for e in edges if not {1, 2} & set(e)}
    assert {tuple(r) for r in g.with_edges([(99, 1), (1, 99)]).edges.collect()} == {*edges, (1, 99)}


@pytest.mark.parametrize("seed", range(3))
def test_maximal_cliques_of_graphs_with_a_hub(spark, seed):
    edges = sorted({*random_edges(seed, n=10, p=0.5), *((v, 50) for v in range(1, 30))})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = sorted(sorted(c) for c in cliques.bron_kerbosch(near, set(), set(near), set()))
    g = Graph.from_pairs(spark, edges)
    assert sorted(r.members for r in cliques.maximal_cliques(g).collect()) == want
    left, out = sorted((-len(c), c) for c in want if len(c) >= 3), []
    while left:
        out.append(left[0][1])
        left = [x for x in left if not set(x[1]) & set(out[-1])]
    assert sorted(r.members for r in cliques.disjoint_cliques(g, 3).collect()) == sorted(out)
