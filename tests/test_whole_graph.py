"""The registered graphs read every order, against brute force on a small table."""

import datetime
import random
from itertools import combinations

import pytest

from patternweave import PATTERNS
from patternweave.plans.patterns import clique
from patternweave.queries import DAYS, ORDERS, QUERIES
from test_graph import brute

COUNTS = {f"{n}_count": PATTERNS[n] for n in ("square", "chordalsquare", "house", "solarsquare", "twintriangle", "near5clique", "tcsquare", "quadtriangle")} | {f"clique{k}_count": clique(k) for k in (4, 5, 6)} | {f"planned_{n}": PATTERNS[n] for n in ("square", "house", "chordalhouse")}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Orders 1 to 15 of parts with dates, their pairs, and those near in time."""
    r = random.Random(4)
    orders = {k: [(p, datetime.date(1997, 1, 1) + datetime.timedelta(r.choice((0, 150, 199, 200, 201, 390, 700, 950)))) for p in r.sample(range(8), r.randint(2, 4))] for k in range(1, 16)}
    out = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame([(k, *line) for k, v in orders.items() for line in v], "l_orderkey long, l_partkey long, l_shipdate date").write.parquet(f"{out}/lineitem.parquet")
    pairs = [(*sorted((a[0], b[0])), abs((a[1] - b[1]).days)) for v in orders.values() for a, b in combinations(v, 2)]
    return out, sorted({(a, b) for a, b, _ in pairs}), sorted({(a, b) for a, b, d in pairs if d <= DAYS})


def test_edges(spark, table):
    assert len(table[1]) > len(table[2])
    for name, want in (("orders_undirected_edges", table[1]), ("orders_oriented_edges", table[1]), ("undirected_edges", table[2]), ("oriented_edges", table[2]), ("edges_text", table[2]), ("edges_once", table[2])):
        assert {tuple(sorted(r)) for r in QUERIES[name](spark, table[0]).collect()} == set(want)


@pytest.mark.parametrize("name", [n for n in COUNTS if n in ORDERS])
def test_counts_of_all_pairs(spark, table, name):
    want = brute(table[1], COUNTS[name])
    assert want and QUERIES[f"orders_{name}"](spark, table[0]).collect()[0][0] == want


@pytest.mark.parametrize("name", COUNTS)
def test_counts(spark, table, name):
    assert QUERIES[name](spark, table[0]).collect()[0][0] == brute(table[2], COUNTS[name])
