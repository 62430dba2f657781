"""Queries on tables of a few odd rows, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.plans import registry


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL over ``tables`` (columns by name), as text."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    return sorted(tuple(map(str, r)) for r in registry.queries()[name](spark, str(folder)).select(*names).collect()), want


def events(rows):
    """Columns of events (event_id, user_id, value)."""
    return {"event_id": [r[0] for r in rows], "user_id": [r[1] for r in rows], "value": pa.array([r[2] for r in rows], pa.float64())}


def test_crossing_between_equal_values_and_halves(spark, tmp_path):
    rows = [(1, 1, 5.0), (3, 1, 5.0), (4, 1, 2.0), (1, 2, 20.0), (2, 2, 5.0), (1, 3, 30.0), (2, 3, None), (4, 3, 3.0), (5, 3, 3.0), (1, 4, 4.0), (1005, 5, 10.0), (1006, 5, 1.0), (7, 6, 4.0), (9, 6, 6.0)]
    got, want = both(spark, tmp_path, "w10_crossing", events=events(rows))
    assert got == want == [("1", "inf"), ("2", "1.666667"), ("3", "inf"), ("5", "1005.0"), ("6", "13.0")]


def test_best_order_by_the_sum_of_price_and_key(spark, tmp_path):
    rows = [(1, 1, 10.02), (30001, 1, 10.0), (2, 2, 10.02), (30002, 2, 10.0), (5, 2, 99.0), (3, 3, None), (4, 3, None), (6, 4, 7.0), (7, 4, None), (10, 5, 1.01), (10010, 5, 1.0)]
    status = ["O" if k == 5 else "F" for k, _, _ in rows]
    orders = {"o_orderkey": [r[0] for r in rows], "o_custkey": [r[1] for r in rows], "o_totalprice": pa.array([r[2] for r in rows], pa.float64()), "o_orderstatus": status}
    got, want = both(spark, tmp_path, "a19_o5_e22_best", orders=orders)
    assert got == want == [("1", "30001"), ("2", "30002"), ("3", "None"), ("4", "6"), ("5", "10")]


def test_discharges_between_equal_voltages_and_halves(spark, tmp_path):
    flat = [(10, 1, 20.0), (20, 1, 20.0), (30, 1, 60.0)]
    half = [(9497, 2, 17.09), (14488, 2, 24.45)]
    beyond = [(100, 3, 10.0), (110, 3, 20.0), (120, 3, 40.0)]
    rest = [(200, 4, 30.0), (204217, 4, 30.0), (7, 5, 90.0), (8, 5, 10.0), (11, 6, 50.0)]
    got, want = both(spark, tmp_path, "e20_discharges", events=events(flat + half + beyond + rest))
    assert got == want and got[0][1:3] == ("inf", "voltage_cutoff") and got[1][1] == "18251.5937" and len(got) == 6


def test_page_ranges_of_more_than_four_digits(spark, tmp_path):
    got, want = both(spark, tmp_path, "t24_page_range", pages={"page_id": pa.array([0, 9960, 9961, 9999, 10000, 1234567, None], pa.int64())})
    assert got == want and ("9961", "9961", "10000") in got and ("1234567", "1234567", "1234606") in got
    names = spark.createDataFrame([("x_p0001-0040.md",), ("x_p001-0040.md",), ("x_p0001-99999999999.md",)], "n string").select(text.page_range(F.col("n")).alias("r"))
    assert [r.r and tuple(r.r) for r in names.collect()] == [(1, 40), None, (1, None)]


SMALL = "/root/testdata/sf0.001"


def planned(spark, name):
    """The plan of a query, where tables of up to 10 MB by Spark's estimate may be broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    return registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_declared_values_are_not_broadcast(spark):
    plan = planned(spark, "e15_contract_problems")
    assert "SortMergeJoin [scheme_id" in plan and plan.count("+- BroadcastExchange") == 1  # the baseline alone


def test_requests_for_revisions_are_not_broadcast(spark):
    plan = planned(spark, "e16_locked_revisions")
    assert "SortMergeJoin [scheme_id" in plan and "BroadcastExchange" not in plan


def test_pairs_of_an_alias_come_once_without_a_look_at_all_pairs(spark, tmp_path):
    part = {"p_partkey": pa.array([1, 1, 1, 2, 3, None, 4], pa.int64()), "p_brand": ["Brand#7", "BRAND#7", "brand#8", "Brand#7", None, "Brand#8", "Brand#9"]}
    supplier = {"s_suppkey": pa.array([7, 57, 57, 8, None], pa.int64())}
    got, want = both(spark, tmp_path, "j4_exact_alias", part=part, supplier=supplier)
    assert got == want and len(got) == 6
    plan = planned(spark, "j4_exact_alias")
    assert "Aggregate" not in plan[: plan.index("Join")]
