"""The driver's contract: names, golden counts, and SQL beside each query."""

import duckdb
import pytest

import __spark_entry__ as entry
from patternweave import Graph
from patternweave.queries import ON_GRAPH, ORACLE_SQL, QUERIES, raw_pairs

# Counts on the graph of every eighth order of the smallest tables.
GOLDEN = {"square_count": 11470, "chordalsquare_count": 14298, "clique4_count": 1681, "clique5_count": 1152, "clique6_count": 608, "house_count": 210246, "solarsquare_count": 18904, "twintriangle_count": 113014, "near5clique_count": 45342, "tcsquare_count": 554474, "quadtriangle_count": 554474}


@pytest.fixture(scope="module")
def eighth(spark, tmp_path_factory):
    """The graph that the golden counts were taken on."""
    out = str(tmp_path_factory.mktemp("eighth"))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 8 = 0").write.parquet(f"{out}/lineitem.parquet")
    return Graph(raw_pairs(spark, out, None), keep=True)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["x", "y", "p", "q"] and df.count() == QUERIES["chordalsquare_count"](spark, entry.DATA).collect()[0][0] > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_counts(eighth, name):
    assert ON_GRAPH[name](eighth).collect()[0][0] == GOLDEN[name]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("lineitem", "customer"):
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    want = db.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert got == sorted(want)
