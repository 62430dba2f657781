"""Queries of readers and writers: a table is written in a form, read back and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import work_dir
from ..sources import files, manifests
from .registry import Tables, query


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, s_nationkey FROM supplier")
def s3_k1_json_arrays(d: Tables) -> DataFrame:
    spark, path = d.supplier.sparkSession, work_dir(d.supplier.sparkSession)
    files.write_json(d.supplier, path, "s_nationkey")
    back = files.read_json(spark, path, "s_suppkey long, s_name string, s_acctbal double, s_nationkey int")
    return back.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"), "s_nationkey")


@query("SELECT p_partkey, p_name, p_brand, p_size, p_type FROM part")
def s4_k6_k7_csv(d: Tables) -> DataFrame:
    path = work_dir(d.part.sparkSession)
    files.write_facts(d.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_type"), path, by="p_type")
    return files.read_csv(d.part.sparkSession, path, "p_partkey long, p_name string, p_brand string, p_size int, p_type string")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS phone FROM customer")
def s7_sheet_by_headers(d: Tables) -> DataFrame:
    path = work_dir(d.customer.sparkSession)
    headers = {"c_custkey": "No.", "c_name": "Customer name (full)", "c_mktsegment": "Market Segment, 2024"}
    d.customer.select(*[F.col(c).alias(h) for c, h in headers.items()]).write.option("header", True).csv(path)
    sheet = files.read_sheet(d.customer.sparkSession, path, {"c_custkey": "no.", "name": "customer", "segment": "segment", "phone": "phone"})
    return sheet.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""
SELECT stamp, count(*) AS n, sum(s_suppkey) AS ids FROM (SELECT 'a' AS stamp, s_suppkey FROM supplier UNION ALL SELECT 'b', s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY stamp
""")
def k3_snapshots(d: Tables) -> DataFrame:
    path = work_dir(d.supplier.sparkSession)
    files.write_snapshot(d.supplier, path, "a")
    files.write_snapshot(d.supplier.filter("s_acctbal > 0"), path, "b")
    back = d.supplier.sparkSession.read.parquet(path)
    return back.groupBy(F.col("snapshot").alias("stamp")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("ids"))


@query("""
WITH old AS (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey),
fresh AS (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey)
SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE l_partkey NOT IN (SELECT l_partkey FROM old)
""")
def k5_insert_absent(d: Tables) -> DataFrame:
    path = work_dir(d.lineitem.sparkSession)
    d.lineitem.filter("l_linenumber = 1").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey")).write.parquet(path)
    files.insert_absent(d.lineitem.select("l_partkey", "l_suppkey"), path, ["l_partkey"], [F.col("l_suppkey")])
    return d.lineitem.sparkSession.read.parquet(path)


@query("""
SELECT event_id AS seq, event_type, value FROM events ORDER BY event_id DESC LIMIT 500
""")
def k9_i6_trace(d: Tables) -> DataFrame:
    path = work_dir(d.events.sparkSession)
    for part in (0, 1):  # two runs that add to one trace
        files.append_trace(d.events.filter(F.col("event_id") % 2 == part).select(F.col("event_id").alias("seq"), "event_type", "value"), path)
    return files.latest_rows(d.events.sparkSession, path, "seq long, event_type string, value double", 500)


@query("""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages)
SELECT page_id, md5(text) AS text_md5 FROM t
""")
def k10_copied_by_category(d: Tables) -> DataFrame:
    """A table copied into a folder for each category, and read back as one."""
    path = work_dir(d.pages.sparkSession)
    text = F.regexp_replace("html", "<[^>]*>", " ")
    d.pages.select("page_id", text.alias("text"), F.pmod("page_id", F.lit(5)).alias("category")).write.partitionBy("category").parquet(path)
    return d.pages.sparkSession.read.parquet(path).select("page_id", F.md5("text").alias("text_md5"))


def _folders(d: Tables, base: str, changed: bool) -> str:
    """Documents by component and source as folders of text, and some that no component takes. changed: the texts of one component's even
    sources differ, one of its folders is gone, and another one is new."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    for i, name in enumerate(manifests.COMPONENTS):
        rows = d.documents.filter(F.col("doc_id") % 3 == i)
        if changed and name == "anode":
            rows = rows.filter(number != 3).withColumn("text", F.when(number % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
            rows = rows.withColumn("source", F.when(number == 5, "new").otherwise(F.col("source")))
        rows.select("doc_id", "text", "source").repartition("source").sortWithinPartitions("source", "doc_id").select("text", "source").write.partitionBy("source").text(f"{base}/{name}")
    d.region.select(F.col("r_name").alias("text")).coalesce(1).write.text(f"{base}/test/cathode/source=x")
    d.region.select(F.col("r_name").alias("text")).coalesce(1).write.text(f"{base}/cathode/deeper/source=y")
    return base


_FILED = """WITH f AS (SELECT ['cathode', 'anode', 'electrolyte'][CAST(doc_id % 3 + 1 AS INTEGER)] AS component, source, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER), 0) AS k FROM documents),
b AS (SELECT DISTINCT component, 'source=' || source AS stem, k FROM f)
"""


@query(_FILED + """, n AS (SELECT component, stem, k FROM b WHERE NOT (component = 'anode' AND k IN (3, 5)) UNION ALL SELECT DISTINCT component, 'source=new', 5 FROM b WHERE component = 'anode' AND k = 5)
SELECT coalesce(n.component, b.component) || '/' || coalesce(n.stem, b.stem) AS path, CASE WHEN b.stem IS NULL THEN 'added' WHEN n.stem IS NULL THEN 'gone' WHEN n.component = 'anode' AND n.k % 2 = 0 THEN 'changed' ELSE 'touched' END AS change
FROM n FULL JOIN b ON n.component = b.component AND n.stem = b.stem
""")
def s1_m7_changed_folders(d: Tables) -> DataFrame:
    spark = d.documents.sparkSession
    taken = lambda changed: manifests.with_component(manifests.manifest(spark, _folders(d, work_dir(spark), changed), "part-*", by_folder=True))
    return manifests.difference(taken(True), taken(False))


@query(_FILED + """, p AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY component || '/' || stem) AS n FROM b WHERE k % 4 <> 1)
SELECT component, stem FROM p WHERE n <= 3
""")
def s2_pending_folders(d: Tables) -> DataFrame:
    """Three folders of each component that are not done yet: the limit is the feature."""
    spark = d.documents.sparkSession
    found = manifests.with_component(manifests.manifest(spark, _folders(d, work_dir(spark), False), "part-*", by_folder=True))
    done = found.filter(F.regexp_extract("stem", "([0-9]+)", 1).try_cast("int") % 4 == 1)
    return manifests.pending(found, done, 3).select("component", "stem")
