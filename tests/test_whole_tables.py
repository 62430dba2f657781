"""Queries over whole tables: as many rows as their tables ask for, and the same as their SQL."""

import duckdb
import pytest

from sievemill.operators import search
from sievemill.plans import registry

SMALL = "/root/testdata/sf0.001"


def _shown(x):
    return "NULL" if x is None else repr(float(x)) if isinstance(x, float) else str(x)


def same_as_sql(spark, name, folder=SMALL):
    sql, con = registry.oracle_sql()[name], duckdb.connect()
    for table in ("lineitem", "supplier", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = sorted(tuple(map(_shown, r)) for r in found.fetchall())
    assert sorted(tuple(map(_shown, r)) for r in registry.queries()[name](spark, folder).select(*names).collect()) == want
    return want


@pytest.mark.parametrize("name", ["d1_d2_ranges", "d3_report"])
def test_ranges_are_checked_on_all_lines(spark, name):
    rows = same_as_sql(spark, name)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert lines == (len(rows) if name == "d1_d2_ranges" else sum(int(r[1]) for r in rows))


def test_cells_of_all_suppliers(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables have few suppliers
    rows = same_as_sql(spark, "a4_n13_cells", folder=folder)
    assert sum(int(r[3]) for r in rows) == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_two_keys_of_all_lines(spark):
    rows = same_as_sql(spark, "j1_two_keys")
    assert len(rows) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["r2_vector_top_k", "r3_relaxation"])
def test_every_fiftieth_vector_is_a_query(spark, name, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    rows = same_as_sql(spark, name)
    if name == "r2_vector_top_k":
        assert {int(r[0]) for r in rows} == set(range(0, 500, 50)) and len(rows) == 100


def test_vector_top_k_ties_nulls_and_repeated_rows(spark):
    far, near = [0.0, 1.0], [1.0, 0.0]
    rows = [(1, far), (2, near), (2, near), (3, near), (4, None), (5, [1.0]), (6, [None, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([("q", near)], "query_id string, query array<float>")
    got = search.vector_top_k(vectors, queries, 5).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [("q", 2, 1.0), ("q", 2, 1.0), ("q", 3, 1.0), ("q", 1, 0.0), ("q", 4, 0.0)]
    assert search.vector_top_k(vectors.limit(0), queries, 5).count() == 0 and search.vector_top_k(vectors, queries.limit(0), 5).count() == 0
