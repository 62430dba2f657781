"""Queries of test conditions and their registration, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import conditions, registration
from ..operators.storage import stored
from ..streaming import conditions as growth
from .registry import Tables, query

_FIELDS = ["status", "priority", "decade"]

#: Conditions of each customer's orders, folded in order: joined to the first known one that fits.
_FOLD = """WITH RECURSIVE o AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) % 4 AS VARCHAR) END AS decade FROM orders),
f AS (
  SELECT o_custkey, r, o_orderkey, CASE WHEN coalesce(status, priority, decade) IS NULL THEN NULL ELSE 1 END AS number,
         CASE WHEN coalesce(status, priority, decade) IS NULL THEN CAST([] AS STRUCT(s VARCHAR, p VARCHAR, d VARCHAR)[]) ELSE [{'s': status, 'p': priority, 'd': decade}] END AS kept
  FROM o WHERE r = 1
  UNION ALL
  SELECT o_custkey, r, o_orderkey, CASE WHEN none THEN NULL WHEN hit > 0 THEN hit ELSE len(kept) + 1 END,
         CASE WHEN none THEN kept WHEN hit > 0
              THEN list_transform(kept, lambda k, i: CASE WHEN i = hit THEN {'s': coalesce(k.s, status), 'p': coalesce(k.p, priority), 'd': coalesce(k.d, decade)} ELSE k END)
              ELSE list_append(kept, {'s': status, 'p': priority, 'd': decade}) END
  FROM (SELECT o.*, f.kept, coalesce(o.status, o.priority, o.decade) IS NULL AS none,
               coalesce(list_position(list_transform(f.kept, lambda k: coalesce(k.s = o.status, true) AND coalesce(k.p = o.priority, true) AND coalesce(k.d = o.decade, true)), true), 0) AS hit
        FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1))
"""


def _conditions(d: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return d.orders.select(
        "o_custkey", "o_orderkey", F.when(key % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(key % 4 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 5 != 0, (F.year("o_orderdate") % 4).cast("string")).alias("decade"),
    )


@query(_FOLD + """, l AS (SELECT o_custkey, unnest(kept) AS k, generate_subscripts(kept, 1) AS number FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC) AS z FROM f) WHERE z = 1)
SELECT l.o_custkey, CAST(l.number AS INTEGER) AS number, n.members, k.s AS status, k.p AS priority, k.d AS decade
FROM l JOIN (SELECT o_custkey, number, count(*) AS members FROM f WHERE number IS NOT NULL GROUP BY ALL) n ON n.o_custkey = l.o_custkey AND n.number = l.number
""")
def n12_merged_conditions(d: Tables) -> DataFrame:
    rows = conditions.numbered(_conditions(d), "o_custkey", "o_orderkey", _FIELDS)
    return conditions.merged(rows, "o_custkey", "o_orderkey", _FIELDS)


@query(_FOLD + "SELECT o_custkey, o_orderkey, CAST(number AS INTEGER) AS number, CAST(len(kept) AS INTEGER) AS known, kept[number].s AS status, kept[number].p AS priority, kept[number].d AS decade FROM f")
def i4_growing_conditions(d: Tables) -> DataFrame:
    """The stream numbers an order by its place among the customer's; the query gives it its key again."""
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = stored(_conditions(d).withColumn("seq", turn.cast("long")))
    grown = growth.replayed(rows, "o_custkey", _FIELDS)
    return rows.select("o_custkey", "o_orderkey", "seq").join(grown, ["o_custkey", "seq"]).drop("seq")


_REGISTERED = """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name END AS name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, replace(p_name, ' ', '') AS k FROM part),
c AS (SELECT DISTINCT a AS id FROM s WHERE b = 'bolt' AND length(a) % 2 = 0 AND length(k) % 5 <> 0 UNION SELECT 'hot'),
r AS (SELECT s.*, CASE WHEN length(k) % 5 = 0 THEN 'discarded' WHEN c.id IS NOT NULL THEN 'registered' ELSE 'open' END AS status, CASE WHEN length(k) % 5 <> 0 THEN c.id END AS id FROM s LEFT JOIN c ON c.id = s.a)
"""


def _register(d: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names of parts, the log after all rounds, what is open): a judge that makes a new id only of bolts of words with an even length, merges what begins with an
    id, and discards names of some lengths."""
    k = F.col("p_partkey") % 3
    seen = d.part.select("p_partkey", F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")).alias("name"))
    log = d.region.limit(1).select(F.lit("hot").alias("key"), F.lit("hot").alias("name"), F.lit("create").alias("action"), F.lit("hot").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("version"))

    def judge(queue: DataFrame, log: DataFrame) -> DataFrame:
        first, bolt = F.lower(F.regexp_extract("name", "^([A-Za-z]+)", 1)), F.lower("name").rlike("^(?:..)+[ -]bolt$")
        ids = log.filter("id is not null").select(F.col("id").alias("__id")).distinct()
        met = queue.withColumn("first", first).join(ids, F.col("first") == F.col("__id"), "left")
        action = F.when(F.length("key") % 5 == 0, "discard").when(F.col("__id").isNotNull(), "merge").when(bolt, "create")
        return met.select("name", action.alias("action"), F.col("first").alias("id"), F.lit(1.0).alias("confidence"), F.col("batch").alias("seq")).filter("action is not null")

    log, left = registration.settled(seen, log, judge)
    return seen, log, left


@query(_REGISTERED + "SELECT p_partkey, name, id, status FROM r")
def n19_registration(d: Tables) -> DataFrame:
    seen, log, _ = _register(d)
    return registration.resolved(seen, log)


@query(_REGISTERED + "SELECT k AS key, min(name) AS name, count(*) AS n, CAST(floor((row_number() OVER (ORDER BY k) - 1) / CAST(10 AS DOUBLE)) + 1 AS BIGINT) AS batch FROM r WHERE status = 'open' GROUP BY k")
def n21_open_queue(d: Tables) -> DataFrame:
    return registration.in_batches(_register(d)[2], 10)
