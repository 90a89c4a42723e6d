"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from corpusloom.plans import retrieval_queries
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_cell_index_recall(spark, size):
    """Against all true neighbours, on tables of three sizes."""
    folder = f"/root/testdata/{size}"
    found = retrieval_queries.approximate_hits(spark, folder).collect()
    exact = entry.queries()["dense_top_k"](spark, folder).count()
    assert sum(r.exact_hit for r in found) >= 0.9 * exact


def test_approximate_top_k_holds_every_true_neighbour(spark):
    rows = retrieval_queries.approximate_top_k(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 20 * len({r.query_id for r in rows}) == len({(r.query_id, r.vec_id) for r in rows})
    assert all(r.recall_reached and r.n_found == 20 and -1 <= r.score <= 1 for r in rows)
