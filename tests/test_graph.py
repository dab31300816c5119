"""Graph operators against brute force, closed forms and each other."""

import random
from itertools import combinations, permutations
from math import comb

import pytest

from patternweave import PATTERNS, Graph, Options, Pattern
from patternweave.functions.arrays import binomial, chunks, common, upto
from patternweave.operators import cliques, hypergraph, patterns, prepare, sampling, wedges
from patternweave.plans import planner, run, star, twintwig
from patternweave.plans.patterns import clique
from patternweave.sources import edges as sources


def brute(edges, pattern):
    """Injective homomorphisms over automorphisms."""
    near = {frozenset(e) for e in edges}
    vs = sorted({v for e in edges for v in e})
    n = len(pattern.vertices)
    hits = sum(all(frozenset((p[a - 1], p[b - 1])) in near for a, b in pattern.edges) for p in permutations(vs, n))
    return hits // len(pattern.automorphisms)


def random_edges(seed, n=8, p=0.55):
    r = random.Random(seed)
    return [e for e in combinations(range(n), 2) if r.random() < p]


def number(df):
    return df.collect()[0][0]


def counted(g, name, **more):
    return number(run.run(g, Options(query=name, **more)))


NAMES = ("square", "chordalsquare", "house", "solarsquare", "twintriangle", "near5clique", "tcsquare", "quadtriangle")


@pytest.fixture(scope="module")
def small(spark):
    edges = random_edges(1)
    g = Graph.from_pairs(spark, [*edges, *[(b, a) for a, b in edges[::2]], (3, 3), edges[0]], keep=True)
    yield g, edges
    g.release()


@pytest.mark.parametrize("name", NAMES)
def test_counts_are_the_definitions(small, name):
    g, edges = small
    assert counted(g, name) == brute(edges, PATTERNS[name])


@pytest.mark.parametrize("name,plans", [("square", [{"twin_twig": True}, {"count_only": False, "compressed": False}]), ("chordalsquare", [{"non_overlapping": True}, {"twin_twig": True}]), ("house", [{"non_overlapping": True}, {"twin_twig": True}]), ("solarsquare", [{"left_deep": True}, {"twin_twig": True}]), ("twintriangle", [{"twin_twig": True}]), ("near5clique", [{"twin_twig": True}]), ("tcsquare", [{"left_deep": True}]), ("clique", [{"twin_twig": True}, {"star": True}, {"star": True, "bottom_up": True}])])
def test_plans_agree(small, name, plans):
    g, _ = small
    want = counted(g, name)
    for plan in plans:
        out = run.run(g, Options(query=name, **plan))
        assert (number(out) if plan.get("count_only", True) else out.count()) == want, plan


@pytest.mark.parametrize("k", [3, 4, 5, 6])
def test_cliques(small, k):
    g, edges = small
    want = brute(edges, clique(k))
    rows = cliques.cliques(g, k)
    assert rows.count() == want == rows.distinct().count()
    assert star.cliques(g, k).count() == want
    if k > 3:
        assert sum(r.cnt for r in cliques.clique_counts(g, k).collect()) == want
        assert twintwig.cliques(g, k).count() == want
        encoded = cliques.cliques_encoded(g, k)
        assert sum(r.cnt for r in cliques.encoded_counts(encoded, k).collect()) == want
        assert {tuple(r) for r in cliques.expand_encoded(encoded, k).collect()} == {tuple(r) for r in rows.collect()}


def test_complete_and_bipartite_graphs(spark):
    g = Graph.from_pairs(spark, list(combinations(range(7), 2)))
    assert counted(g, "square") == 3 * comb(7, 4)
    assert counted(g, "chordalsquare") == 6 * comb(7, 4)
    assert counted(g, "clique", clique_vertices=5) == comb(7, 5)
    assert [r.members for r in cliques.maximal_cliques(g).collect()] == [list(range(7))]
    b = Graph.from_pairs(spark, [(i, 10 + j) for i in range(3) for j in range(4)])
    assert counted(b, "square") == comb(3, 2) * comb(4, 2)
    assert b.triangles.count() == 0 and counted(b, "house") == 0
    assert {(r.member, r.kind) for r in Graph.ids(hypergraph.hypervertices(b)).select(patterns.F.col("member").bitwiseAND(0xFFFFFFFF).alias("member"), "kind").collect()} == {(v, "set") for v in (0, 1, 2, 10, 11, 12, 13)}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2)], [(0, i) for i in range(1, 9)], [(i, (i + 1) % 9) for i in range(9)]])
def test_graphs_without_any_pattern(spark, pairs):
    g = Graph.from_pairs(spark, pairs)
    for name in NAMES:
        assert counted(g, name) == 0


def test_labels_duplicates_and_unions_dont_matter(spark):
    a = random_edges(5, 7)
    moved = [(900_000_000 - 7 * y, 900_000_000 - 7 * x) for x, y in a]
    twice = Graph.from_pairs(spark, [*a, *moved, *[(y, x) for x, y in a], (4, 4)])
    for name in ("square", "house", "twintriangle"):
        assert counted(twice, name) == 2 * brute(a, PATTERNS[name])


def test_preparation(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3), (1, 2), (None, 4)], "src long, dst long")
    g = Graph(raw)
    assert {tuple(r) for r in g.edges.collect()} == {(1, 2), (2, 3)}
    assert {tuple(r) for r in g.degrees.collect()} == {(1, 1), (2, 2), (3, 1)}
    assert {tuple(r) for r in Graph.ids(g.oriented).collect()} == {(1, 2), (3, 2)}
    assert prepare.prune_leaves(g.oriented).count() == 0
    assert {r.v & 0xFFFFFFFF for r in prepare.non_small(g.oriented).collect()} == {1, 3}
    assert tuple(prepare.largest_degree(g.degrees).first()) == (2, 2)
    with pytest.raises(Exception, match="vertex ids"):
        Graph.from_pairs(spark, [(-1, 2)]).oriented.collect()


def test_wedges_and_stars(small):
    g, edges = small
    deg = {}
    for a, b in edges:
        deg[a] = deg.get(a, 0) + 1
        deg[b] = deg.get(b, 0) + 1
    assert g.wedges.count() == sum(comb(d, 2) for d in deg.values())
    assert wedges.stars(g.oriented, 2).count() == wedges.twin_twig(g.oriented, 1).count()
    assert sum(r.times for r in wedges.distinct_twin_twigs(g.oriented).collect()) == wedges.twin_twig(g.oriented, 1).count()


def test_partitioned_lists_keep_all_pairs(small):
    g, _ = small
    whole = patterns.squares_compressed(g)
    parts = patterns.chunk_pairs(whole, "mids", 2)
    n = patterns.F.size("mids")
    inner = patterns.F.when(patterns.F.col("same"), n * (n - 1) / 2).otherwise(n * patterns.F.size("more"))
    assert number(patterns.total(parts, inner)) == number(patterns.total(whole, n * (n - 1) / 2))


def test_array_expressions(spark):
    df = spark.createDataFrame([([1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21], 6)], "a array<long>, n long")
    r = df.select(chunks(patterns.F.col("a"), 10).alias("c"), chunks(patterns.F.col("a"), 4).alias("d"), binomial(patterns.F.col("n"), 3).alias("b"), upto(patterns.F.col("a"), patterns.F.lit(5)).alias("u"), common(patterns.F.col("a"), patterns.F.array(patterns.F.lit(3).cast("long"), patterns.F.lit(4).cast("long"))).alias("s")).first()
    assert [len(x) for x in r.c] == [11] and [len(x) for x in r.d] == [4, 4, 3]
    assert (r.b, r.u, r.s) == (20, 3, 1)


def test_twins_and_hyperedges(spark):
    demo = [(1, 4), (1, 2), (1, 3), (2, 4), (2, 3), (3, 4), (4, 8), (5, 8), (5, 6), (6, 7), (7, 8)]
    g = Graph.from_pairs(spark, demo)
    classes = hypergraph.hypervertices(g)
    kinds = {r.member & 0xFFFFFFFF: r.kind for r in classes.collect()}
    assert {v for v, k in kinds.items() if k == "clique"} == {1, 2, 3} and {v for v, k in kinds.items() if k == "set"} == {5, 7}
    expanded = hypergraph.expand(classes, hypergraph.hyperedges(g, classes))
    assert {tuple(r) for r in expanded.collect()} == {tuple(r) for r in g.oriented.collect()}
    assert number(hypergraph.triangle_count(g)) == brute(demo, PATTERNS["triangle"])


def test_covers_and_maximal_cliques(spark):
    r = random.Random(2)
    edges = list({*combinations(range(8), 2), *combinations(range(20, 26), 2), *[tuple(sorted(r.sample(range(30), 2))) for _ in range(60)]})
    g = Graph.from_pairs(spark, edges, keep=True)
    near = {frozenset(e) for e in edges}
    groups = {}
    for x in cliques.clique_cover(g, 4).collect():
        groups.setdefault(x.clique, []).append(x.member & 0xFFFFFFFF)
    assert groups and all(len(m) >= 4 and all(frozenset(p) in near for p in combinations(m, 2)) for m in groups.values())
    assert len({v for m in groups.values() for v in m}) == sum(map(len, groups.values()))
    vs = sorted({v for e in edges for v in e})
    maximal = {tuple(x.members) for x in cliques.maximal_cliques(g).collect()}
    assert len(maximal) == cliques.maximal_cliques(g).count()
    for m in maximal:
        assert all(frozenset(p) in near for p in combinations(m, 2))
        assert not any(all(frozenset((v, u)) in near for u in m) for v in vs if v not in m)
    assert all(any({a, b} <= set(m) for m in maximal) for a, b in edges)
    biggest = cliques.largest_clique(g).first()
    assert biggest.size == max(map(len, maximal)) and tuple(biggest.members) in maximal
    apart = [set(x.members) for x in cliques.disjoint_cliques(g, 3).collect()]
    assert apart and sum(map(len, apart)) == len(set().union(*apart))
    assert not any(len(m) >= 3 and all(not set(m) & a for a in apart) for m in maximal)
    g.release()


def test_samples_and_limits(spark):
    g = Graph.from_pairs(spark, random_edges(3, 40, 0.3))
    some = {tuple(r) for r in sampling.sample_vertices(g.edges, 0.5).collect()}
    assert some == {tuple(r) for r in sampling.sample_vertices(g.edges, 0.5).collect()} and 0 < len(some) < g.edges.count()
    kept = {v for e in some for v in e}
    assert some >= {tuple(r) for r in g.edges.collect() if set(r) <= kept}
    assert 0 < sampling.sample_edges(g.edges, 0.2).count() < 0.5 * g.edges.count()
    for order in ("lowest", "highest", "random"):
        limited = sampling.limit_degrees(g.oriented, 4, order)
        assert max(r.d for r in prepare.both_ways(limited).groupBy("v").agg(patterns.F.count("*").alias("d")).collect()) <= 4


@pytest.mark.parametrize("name", ["triangle", "square", "house", "near5clique", "twintriangle", "chordalhouse", "solarsquare"])
@pytest.mark.parametrize("unit", ["star", "local", "clique"])
def test_planned_matches(small, name, unit):
    g, edges = small
    p = PATTERNS[name]
    rows = planner.match(g, p, unit=unit)
    assert rows.count() == brute(edges, p)
    assert rows.columns == [f"v{v}" for v in p.vertices]


def test_patterns_and_estimates():
    assert [len(PATTERNS[n].automorphisms) for n in ("triangle", "square", "chordalsquare", "house", "solarsquare", "twintriangle", "near5clique", "tcsquare")] == [6, 8, 4, 2, 8, 8, 4, 2]
    assert PATTERNS["tcsquare"].edges == PATTERNS["quadtriangle"].edges
    p = Pattern.of("triangle", [(7, 9), (9, 8), (7, 8), (7, 7)])
    assert p.edges == PATTERNS["triangle"].edges
    m = planner.Moments((100.0, 600.0, 3600.0, 21600.0, 129600.0, 777600.0, 4665600.0, 2.8e7, 1.7e8))
    one = frozenset([(1, 2)])
    assert planner.estimate(one, m) == pytest.approx(600) and planner.estimate(one, m, "uniform") == pytest.approx(600)
    assert planner.is_star(frozenset([(1, 2), (1, 3)])) and not planner.is_star(frozenset([(1, 2), (3, 4)]))
    assert planner.is_clique(frozenset(clique(4).edges)) and planner.is_core(frozenset(PATTERNS["solarsquare"].edges))
    step = planner.decompose(PATTERNS["house"], m)
    assert step.left and step.edges == frozenset(PATTERNS["house"].edges) and len(step.lines()) >= 3
    assert planner.minus(frozenset(clique(3).edges), one) == frozenset([(1, 3), (2, 3)])


def test_sources_and_options(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# comment\n% too\n1\t2\n2\t1\n3\t3\n2\t3\nnot an edge\n\n")
    g = Graph.from_text(spark, str(tmp_path / "e.txt"))
    assert {tuple(r) for r in g.edges.collect()} == {(1, 2), (2, 3)}
    for name, sep in (("comma", ","), ("semicolon", ";"), ("space", " ")):
        (tmp_path / name).write_text(f"1{sep}2\n2{sep}3\n")
        assert Graph.from_text(spark, str(tmp_path / name), name).edges.count() == 2
    sources.write_table(g.edges, str(tmp_path / "t"))
    sources.write_table(g.edges, str(tmp_path / "t"))
    assert Graph.from_table(spark, str(tmp_path / "t"), "a", "b").edges.count() == 2
    sources.write_text(g.edges, str(tmp_path / "w"), "comma")
    assert Graph.from_text(spark, str(tmp_path / "w"), "comma").edges.count() == 2
    (tmp_path / "p").write_text("1\t2\n2\t3\n1\t3\n")
    assert Pattern.of("p", sources.read_pattern(str(tmp_path / "p"))).edges == PATTERNS["triangle"].edges
    o = Options.parse(["enum.query=house", "is.nonoverlapping=true", "clique.number.vertices=5", "count_only=false"])
    assert (o.query, o.non_overlapping, o.clique_vertices, o.count_only) == ("house", True, 5, False)
    with pytest.raises(ValueError):
        Options.parse(["no.such=1"])
    with pytest.raises(ValueError):
        run.run(g, Options(query="nothing"))
