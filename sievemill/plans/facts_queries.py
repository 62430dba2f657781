"""Queries of facts, data quality, rules, energy and physics, on rows made from the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extraction, facts, gates, physics, quality, rules
from ..sources import tables as tb
from .registry import Tables, query


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_discount <> 0 THEN 'c_rate=' || l_returnflag END, CASE WHEN l_linenumber <> 1 THEN 'electrolyte=1M lipf6 in ' || CASE WHEN l_linenumber % 2 = 0 THEN 'DMC/EC' ELSE 'EC' END END) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = '' THEN 'NO_CONDITION' ELSE 'HASH_' || substr(sha256(k), 1, 8) END AS condition_id FROM s
""")
def n8_condition_id(d: Tables) -> DataFrame:
    rate = F.when(F.col("l_discount") != 0, F.col("l_returnflag"))
    salt = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") % 2 == 0, "1 M LiPF6 in EC:DMC").otherwise("1M LiPF6 in EC")
    rows = facts.with_form(d.lineitem.withColumn("salt", salt), "salt", t.electrolyte, "form")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", facts.condition_id({"electrolyte": F.col("salt"), "c_rate": rate}, {"electrolyte": F.col("form")}).alias("condition_id"))


@query("""
SELECT conv_id, turn, 'para-' || sha1(conv_id || '|' || turn || '|' || role) AS id, 'CELL_' || substr(sha256(conv_id || '|' || role), 1, 8) AS cell, md5(text) AS passage_md5 FROM conversations
""")
def n9_n10_ids(d: Tables) -> DataFrame:
    c = F.col
    return d.conversations.select("conv_id", "turn", facts.document_id(c("conv_id"), c("turn"), c("role")).alias("id"), facts.cell_id(c("conv_id"), c("role")).alias("cell"), F.md5("text").alias("passage_md5"))


@query("""
WITH RECURSIVE o AS (SELECT p_brand, p_size, p_partkey, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part),
f AS (SELECT p_brand, p_size, r, [v] AS kept, [1] AS members FROM o WHERE r = 1
  UNION ALL
  SELECT o.p_brand, o.p_size, o.r,
    CASE WHEN len(list_filter(f.kept, lambda k: abs(o.v - k) / abs(k) < CAST(0.02 AS DOUBLE))) > 0 THEN f.kept ELSE list_append(f.kept, o.v) END,
    CASE WHEN len(list_filter(f.kept, lambda k: abs(o.v - k) / abs(k) < CAST(0.02 AS DOUBLE))) > 0 THEN f.members ELSE list_append(f.members, 1) END
  FROM f JOIN o ON o.p_brand = f.p_brand AND o.p_size = f.p_size AND o.r = f.r + 1),
l AS (SELECT p_brand, p_size, kept FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY r DESC) AS z FROM f) WHERE z = 1)
SELECT p_brand, p_size, unnest(kept) AS p_retailprice FROM l
""")
def a3_near_duplicates(d: Tables) -> DataFrame:
    return facts.merged_values(d.part, ["p_brand", "p_size"], "p_retailprice", "p_partkey").select("p_brand", "p_size", "p_retailprice")


@query("""
SELECT l_suppkey AS doi, l_partkey AS material_id, l_returnflag AS condition_id, count(*) AS n FROM lineitem GROUP BY ALL
""")
def a4_n13_cells(d: Tables) -> DataFrame:
    rows = d.lineitem.select(F.col("l_suppkey").alias("doi"), F.col("l_partkey").alias("material_id"), F.col("l_returnflag").alias("condition_id"), F.lit("qty").alias("name"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return facts.cells(facts.grouped_papers(rows)).select("doi", F.col("working_material").alias("material_id"), "condition_id", F.col("n_properties").cast("long").alias("n"))


@query("""
SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS linked FROM orders
""")
def n11_orphans(d: Tables) -> DataFrame:
    rows = d.orders.select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).otherwise(" ").alias("condition_id"))
    linked, orphans = facts.without_orphans(rows, "condition_id")
    return linked.select("o_orderkey", F.lit(True).alias("linked")).union(orphans.select("o_orderkey", F.lit(False)))


@query("""
SELECT event_id, 'p_AGG' AS name, '0' AS value, '%' AS unit, CAST(NULL AS VARCHAR) AS prop_c_rate FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'p_CIP', CAST(user_id AS VARCHAR), '%', NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'p', CAST(user_id AS VARCHAR), 'mAh/g', '1C' FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'p', '7', 'mAh/g', '2C' FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'p', CAST(user_id AS VARCHAR), 'V', NULL FROM events WHERE event_id % 3 = 2
""")
def n15_flattened(d: Tables) -> DataFrame:
    k, u = F.col("event_id") % 3, F.col("user_id")
    value = (
        F.when((k == 0) & (F.col("event_id") % 2 == 0), F.concat(F.lit('{"CIP": '), u, F.lit(', "AGG": 0, "unit": "%"}')))
        .when(k == 0, F.concat(F.lit("{'CIP': "), u, F.lit(", 'AGG': 0, 'unit': '%'}")))
        .when(k == 1, F.concat(F.lit('[{"rate": "1C", "capacity": '), u, F.lit('}, {"rate": "2C", "capacity": 7}]')))
        .otherwise(u.cast("string"))
    )
    rows = d.events.select("event_id", F.lit("p").alias("name"), value.alias("value"), F.when(k == 2, "V").when(k == 1, "mAh/g").alias("unit"))
    return facts.flattened(rows, "name", "value", "unit")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'LIPF6_DEC-EC' WHEN 1 THEN '1.2M_LIPF6_DMC-EC_VC' END AS formulation FROM customer
""")
def n1_formulations(d: Tables) -> DataFrame:
    s = F.when(F.col("c_custkey") % 3 == 0, "1M LiPF6 in EC/DEC").when(F.col("c_custkey") % 3 == 1, "1.2M LiPF6 in EC/DMC + 1% VC").otherwise("some salt")
    return d.customer.select("c_custkey", facts.formulation_id(s).alias("formulation"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'NCM811' WHEN 1 THEN 'hard carbon' ELSE 'Si' END AS base, CASE p_size % 3 WHEN 0 THEN 'NCM811_Al2O3-coated' WHEN 1 THEN 'hard carbon_N-doped_S-doped' ELSE 'Si_graphene-coated_nanoparticles' END AS variant FROM part
""")
def n2_n3_modifications(d: Tables) -> DataFrame:
    s = F.when(F.col("p_size") % 3 == 0, "Al2O3-coated NCM811").when(F.col("p_size") % 3 == 1, "N,S co-doped hard carbon").otherwise("graphene-wrapped Si nanoparticles")
    m = d.part.select("p_partkey", facts.modifications(s).alias("m"))
    return m.select("p_partkey", F.col("m.base").alias("base"), facts.variant_id(F.col("m.base"), F.col("m")).alias("variant"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ncm' WHEN 1 THEN 'lco' END AS base_id, CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'formula' ELSE 'none' END AS norm_method FROM part
""")
def n4_n5_resolution(d: Tables) -> DataFrame:
    spark = d.part.sparkSession
    aliases = spark.createDataFrame([("ncm811", "ncm")], "alias_key string, id string")
    formulas = spark.createDataFrame([("Co1Li1O2", "lco")], "formula_key string, id string")
    rows = d.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "NCM-811").when(F.col("p_size") % 3 == 1, "LiCoO2").otherwise("what").alias("name"))
    return facts.resolved(rows, "name", aliases, formulas).select("p_partkey", "base_id", "norm_method")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def n12_j21_compatible(d: Tables) -> DataFrame:
    k = d.nation.select("n_nationkey", "n_regionkey", F.lit(None).cast("string").alias("scan_rate"))
    a, b = k.alias("a"), k.alias("b")
    on = facts.compatible("a", "b", ["n_regionkey", "scan_rate"]) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(F.broadcast(b), on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("""
SELECT c_custkey, c_custkey % 2 = 0 AS same FROM customer
""")
def n20_same_goal(d: Tables) -> DataFrame:
    b = F.when(F.col("c_custkey") % 2 == 0, "design a 400 Wh/kg cell, LiNi0.8Co0.1Mn0.1O2").otherwise("design a 350Wh/kg cell")
    return d.customer.select("c_custkey", facts.same_goal(F.lit("Design of a 400Wh/kg Cell"), b).alias("same"))


_LINES = """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE l_linenumber % 4 WHEN 0 THEN 'Specific_Capacity' WHEN 1 THEN 'Operating_Voltage' WHEN 2 THEN 'Porosity' ELSE 'Note' END AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'Ah/kg' WHEN 1 THEN 'mV' WHEN 2 THEN '%' ELSE 'x' END AS unit FROM lineitem),
c AS (SELECT *, CASE name WHEN 'Specific_Capacity' THEN v WHEN 'Operating_Voltage' THEN v * CAST(0.001 AS DOUBLE) WHEN 'Porosity' THEN v / 100 END AS b FROM s)
"""


def _checked(d: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    name = F.when(k == 0, "Specific_Capacity").when(k == 1, "Operating_Voltage").when(k == 2, "Porosity").otherwise("Note")
    unit = F.when(k == 0, "Ah/kg").when(k == 1, "m V").when(k == 2, "%").otherwise("x")
    rows = d.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), name.alias("name"), unit.alias("unit"), F.lit("cathode").alias("component"))
    return quality.checked(rows, "name", "v", "unit", "component")


@query(_LINES + "SELECT l_orderkey, l_linenumber, v, b AS value_base, coalesce(CASE name WHEN 'Specific_Capacity' THEN b BETWEEN 0 AND 600 WHEN 'Operating_Voltage' THEN b BETWEEN 0 AND 6 WHEN 'Porosity' THEN b BETWEEN 0 AND 1 END, true) AS ok FROM c")
def d1_d2_ranges(d: Tables) -> DataFrame:
    return _checked(d).select("l_orderkey", "l_linenumber", "v", "value_base", "ok")


@query(_LINES + "SELECT name, count(*) AS checked, count(*) FILTER (NOT coalesce(CASE name WHEN 'Specific_Capacity' THEN b BETWEEN 0 AND 600 WHEN 'Operating_Voltage' THEN b BETWEEN 0 AND 6 WHEN 'Porosity' THEN b BETWEEN 0 AND 1 END, true)) AS dropped, 0 AS unknown_unit FROM c GROUP BY name")
def d3_report(d: Tables) -> DataFrame:
    return quality.report(_checked(d), "name")


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'value' ELSE '' END AS missing FROM events
""")
def d5_relations(d: Tables) -> DataFrame:
    relation = F.when(F.col("event_id") % 2 == 0, '{"type": "performance", "property": "x"}').otherwise('{"type": "performance", "property": "x", "value": "3"}')
    return d.events.select("event_id", F.array_join(quality.relation_problems(relation, {"performance": ["property", "value"]}), ",").alias("missing"))


@query("""
SELECT o_orderkey, CASE WHEN abs(o_totalprice - 150000) / 150000 <= CAST(0.35 AS DOUBLE) THEN 'ok' ELSE 'energy_mismatch' END AS claim, CASE WHEN o_totalprice < 50000 THEN 'below_range' WHEN o_totalprice > 350000 THEN 'above_range' ELSE 'ok' END AS in_range FROM orders
""")
def e9_e10_claims(d: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    return d.orders.select("o_orderkey", rules.claim_check(x, F.lit(150000.0)).alias("claim"), rules.range_check(x, F.lit(50000.0), F.lit(350000.0)).alias("in_range"))


@query("SELECT c_custkey, CAST(300 + c_custkey % 100 AS DOUBLE) AS claim FROM customer")
def e11_energy_claim(d: Tables) -> DataFrame:
    return d.customer.select("c_custkey", rules.energy_claim(F.concat(F.lit("We see 200 Wh/kg. Cells reach about "), 300 + F.col("c_custkey") % 100, F.lit(" Wh/kg."))).alias("claim"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_size / CAST(3.2 AS DOUBLE) * 10 ELSE 75 END, 6) AS um, CASE p_size % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'derived' ELSE 'baseline' END AS source FROM part
""")
def e13_geometry(d: Tables) -> DataFrame:
    size, k = F.col("p_size").cast("double"), F.col("p_size") % 3
    g = d.part.select("p_partkey", rules.thickness(F.when(k == 0, size), F.when(k == 1, size), F.lit(3.2), 75.0).alias("g"))
    return g.select("p_partkey", F.round("g.um", 6).alias("um"), F.col("g.source").alias("source"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN NOT (l_quantity / 10 BETWEEN 1 AND 2.5) THEN 'n_p_ratio' END, CASE WHEN l_linenumber < 1 OR l_linenumber > 5 OR l_linenumber >= 4 THEN 'voltage' END) AS violations FROM lineitem
""")
def e14_violations(d: Tables) -> DataFrame:
    v = rules.geometry_violations(F.col("l_quantity") / 10, F.col("l_linenumber").cast("double"), F.lit(4.0), F.lit(0.3))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(v, ",").alias("violations"))


@query("SELECT p_partkey, round(CAST(0.01 AS DOUBLE) * CAST(96485.33212 AS DOUBLE) * p_size * CAST(0.000001 AS DOUBLE) * CAST(0.6 AS DOUBLE) * 50000 * CAST(0.5 AS DOUBLE), 4) AS coulombs FROM part")
def e18_capacity(d: Tables) -> DataFrame:
    q = rules.electrode_capacity(F.lit(0.01), F.col("p_size") * 1e-6, F.lit(0.6), F.lit(50000.0), F.lit(0.4), F.lit(0.9))
    return d.part.select("p_partkey", F.round(q, 4).alias("coulombs"))


def _weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(0)
    w = {"bn_moving_mean": np.zeros(3), "bn_moving_var": np.ones(3), "bn_eps": 1e-3, "bn_gamma": np.ones(3), "bn_beta": np.zeros(3)}
    for name, shape in (("d1", (3, 30)), ("d2", (30, 30)), ("d3", (30, 1))):
        w |= {f"{name}_kernel": rng.normal(0, 0.3, shape), f"{name}_bias": np.zeros(shape[1])}
    return w


def _layer(x: str, kernel: np.ndarray) -> str:
    """SQL of a list x times a matrix, a list for each of its columns."""
    columns = "[" + ", ".join("[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in column.tolist()) + "]" for column in kernel.T) + "]"
    return f"list_transform({columns}, lambda k: list_sum(list_transform(list_zip({x}, k), lambda z: z[1] * z[2])))"


_ELU = "list_transform({}, lambda y: CASE WHEN y > 0 THEN y ELSE exp(y) - 1 END)"
_W = _weights()


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, CAST(1 AS DOUBLE) AS rho, l_discount AS bc, [l_quantity / 50 / sqrt(CAST(1.001 AS DOUBLE)), 1 / sqrt(CAST(1.001 AS DOUBLE)), l_discount / sqrt(CAST(1.001 AS DOUBLE))] AS x FROM lineitem),
a AS (SELECT *, {_ELU.format(_layer("x", _W["d1_kernel"]))} AS y FROM i),
b AS (SELECT *, {_ELU.format(_layer("y", _W["d2_kernel"]))} AS z FROM a)
SELECT l_orderkey, l_linenumber, s, rho, bc, round(({_layer("z", _W["d3_kernel"])})[1], 6) AS x_bar FROM b
""")
def e19_e20_surrogate(d: Tables) -> DataFrame:
    rows = d.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("s"), F.lit(1.0).alias("rho"), F.col("l_discount").alias("bc"))
    return physics.with_network(rows, ["s", "rho", "bc"], _W).withColumn("x_bar", F.round("x_bar", 6))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) AS x FROM pages) SELECT page_id, count(*) AS n_cells FROM l GROUP BY page_id
""")
def s9_s10_tables(d: Tables) -> DataFrame:
    items = F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))
    table = F.concat(F.lit("| k |\n|---|\n"), F.array_join(F.transform(items, lambda x: F.lit("| v |")), "\n"))
    return d.pages.select("page_id", F.explode(tb.pipe_rows(table)).alias("r")).groupBy("page_id").agg(F.count("*").alias("n_cells"))


_MADE = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'The cathode has loading ' || (c_custkey % 20 + 1) || '-' || (c_custkey % 20 + 3) || ' mg/cm² and the anode thickness 50 um.' ELSE 'The anode porosity 30 %.' END AS text FROM customer"


def _made(d: Tables) -> DataFrame:
    k = F.col("c_custkey") % 20
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("The cathode has loading "), k + 1, F.lit("-"), k + 3, F.lit(" mg/cm² and the anode thickness 50 um."))).otherwise("The anode porosity 30 %.")
    return d.customer.select("c_custkey", text.alias("text"))


@query("""
SELECT c_custkey, 'cathode' AS component, 'loading_mg_cm2' AS field, CAST(c_custkey % 20 + 2 AS DOUBLE) AS value FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'anode', 'thickness_um', CAST(50 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'anode', 'porosity_pct', CAST(30 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 1
""")
def e12_g17_geometry(d: Tables) -> DataFrame:
    return extraction.geometry(_made(d), "c_custkey", "text")


@query("""
SELECT p_partkey, 'capacity:' || CAST(p_size AS DOUBLE) || ' mAh/g;voltage:3.7 V' AS summary FROM part
""")
def d4_quantities(d: Tables) -> DataFrame:
    q = extraction.quantities(F.concat(F.lit("It gives "), F.col("p_size"), F.lit(" mAh/g at 3.7 V and again "), F.col("p_size"), F.lit(" mAh/g.")))
    shown = F.transform(q, lambda e: F.concat(e["kind"], F.lit(":"), e["value"].cast("string"), F.lit(" "), e["unit"]))
    return d.part.select("p_partkey", F.array_join(shown, ";").alias("summary"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'full-cell/NCM811/graphite' WHEN 1 THEN 'comparison/bare LFP/' ELSE 'unknown/Title/' END AS systems FROM supplier
""")
def l13_systems(d: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, "a full cell using NCM811 || graphite").when(k == 1, "we use bare LFP").otherwise("# Title")
    shown = F.transform(extraction.battery_systems(text), lambda s: F.concat_ws("/", s["kind"], s["material"], s["counter"]))
    return d.supplier.select("s_suppkey", F.array_join(shown, ";").alias("systems"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'value' WHEN event_id % 3 = 1 THEN 'quote,relation' ELSE '' END AS problems FROM events
""")
def d6_seed_audit(d: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    sentence, quote = F.lit("The capacity is 200 mAh/g."), F.when(k == 1, "voltage").otherwise("Capacity is")
    p = extraction.seed_problems(sentence, quote, F.when(k == 0, "300").otherwise("200"), F.when(k == 1, "odd").otherwise("performance"), ["performance"])
    return d.events.select("event_id", F.array_join(p, ",").alias("problems"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN CAST(1.5 AS DOUBLE) END AS number FROM events
""")
def e15_strict_numbers(d: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    return d.events.select("event_id", extraction.strict_number(F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, "1.5").when(k == 2, "true").otherwise('"7"')).alias("number"))


@query("""
SELECT 'ingestion' AS gate, code = 'OK' AS passed, code, n AS observed, true AS reached FROM (SELECT count(*) AS n, CASE WHEN count(*) FILTER (length(text) < 10) > 0 THEN 'CORRUPT_DOCUMENTS' ELSE 'OK' END AS code FROM documents)
UNION ALL SELECT 'index', true, 'OK', count(*), (SELECT count(*) FILTER (length(text) < 10) = 0 FROM documents) FROM embeddings
UNION ALL SELECT 'physics', false, 'VOLTAGE_OUT_OF_BOUNDS', count(*), (SELECT count(*) FILTER (length(text) < 10) = 0 FROM documents) FROM supplier
""")
def e26_e21_gates(d: Tables) -> DataFrame:
    one = gates.ingestion(d.documents, "lang", "text", ["en", "de"], 10)
    two = gates.index(d.embeddings.withColumn("label", F.lit("x")), "vec_id", "label", ["x"])
    three = gates.physics(d.supplier.select(F.lit(300.0).alias("e"), (F.col("s_suppkey") + 5).cast("double").alias("v")), "e", "v")
    return gates.all_passed([one, two, three]).drop("step")


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Specific_Capacity' WHEN 1 THEN 'Specific_Capacity' END AS standard_label, CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'none' END AS label_method FROM part
""")
def n6_n7_labels(d: Tables) -> DataFrame:
    vocabulary = d.part.sparkSession.createDataFrame([("cathode", "Specific_Capacity"), ("anode", "Specific_Capacity")], "component string, label string")
    name = F.when(F.col("p_size") % 3 == 0, "Specific_Capacity").when(F.col("p_size") % 3 == 1, "specific capacity").otherwise("Colour")
    rows = d.part.select("p_partkey", name.alias("name"), F.lit("cathode").alias("component"))
    return facts.labelled_properties(rows, "name", "component", vocabulary).select("p_partkey", "standard_label", "label_method")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NCM811' END AS cathode, CASE WHEN c_custkey % 2 = 0 THEN 'Li' END AS anode FROM customer
""")
def n14_full_cells(d: Tables) -> DataFrame:
    cell = facts.full_cell(F.when(F.col("c_custkey") % 2 == 0, "NCM811 || Li").otherwise("half-cell"))
    return d.customer.select("c_custkey", cell.alias("c")).select("c_custkey", "c.cathode", "c.anode")


@query("""
SELECT DISTINCT p_brand, CAST(ceil(row_number() OVER (ORDER BY p_brand) / CAST(10 AS DOUBLE)) AS INTEGER) AS batch FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#1')
""")
def n19_n21_queue(d: Tables) -> DataFrame:
    known = d.part.sparkSession.createDataFrame([("Brand#1",)], "p_brand string")
    return facts.batches(d.part.select("p_brand").distinct().join(F.broadcast(known), "p_brand", "left_anti"), "p_brand", 10)


@query("""
SELECT p_partkey, round(p_size * CAST(0.0001 AS DOUBLE) * CAST(1.5 AS DOUBLE) * CAST(0.3 AS DOUBLE) * 1000, 6) AS pore_ul, CASE WHEN p_size % 2 = 0 THEN 'low' WHEN p_size % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE '' END AS missing FROM part
""")
def e5_e23_a18_metrics(d: Tables) -> DataFrame:
    size = F.col("p_size")
    pore = rules.pore_metrics(size.cast("double"), F.lit(0.3), F.lit(1.5), F.lit(20.0))
    missing = rules.missing_fields({"a": F.lit(1), "b": F.when(size % 2 != 0, 1)})
    return d.part.select("p_partkey", F.round(pore["pore_ul"], 6).alias("pore_ul"), rules.confidence(size % 2 != 0, F.when(size % 3 == 0, 1).otherwise(0)).alias("confidence"), F.array_join(missing, ",").alias("missing"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER ((l_quantity > 25) = (l_linenumber > 3)) AS consistent, round(count(*) FILTER ((l_quantity > 25) = (l_linenumber > 3)) / CAST(count(*) AS DOUBLE), 6) AS rate FROM lineitem GROUP BY l_returnflag")
def e8_consistency(d: Tables) -> DataFrame:
    tasks = d.lineitem.select("l_returnflag", (F.col("l_quantity") > 25).alias("expected"), (F.col("l_linenumber") > 3).alias("found"))
    return rules.consistency(tasks, "expected", "found", "l_returnflag")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'sysA' WHEN s_suppkey % 3 = 1 THEN 'sysB' END AS system FROM supplier")
def j14_registry(d: Tables) -> DataFrame:
    registry = d.supplier.sparkSession.createDataFrame([("sysA", ["NCM", "NCA"], ["graphite"]), ("sysB", ["LFP"], ["graphite", "Li"])], "system string, cathodes array<string>, anodes array<string>")
    k = F.col("s_suppkey") % 3
    specs = d.supplier.select("s_suppkey", F.when(k == 0, "NCA").when(k == 1, "LFP").otherwise("LCO").alias("cathode"), F.lit("graphite").alias("anode"))
    return rules.registry_match(specs, registry).select("s_suppkey", "system")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice + 5 ELSE o_totalprice END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'applied' ELSE 'rejected' END AS status FROM orders
""")
def e16_revisions(d: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    base = d.orders.select("o_orderkey", F.lit(1).alias("version"), F.col("o_totalprice").alias("value"))
    n = F.when(k == 3, 4).otherwise(1)
    changes = d.orders.filter(k > 0).select("o_orderkey", F.when(k == 2, 0).otherwise(1).alias("version"), (F.col("o_totalprice") + 5).alias("value"), F.explode(F.sequence(F.lit(1), n)).alias("seq"))
    return rules.revised(base, changes, "o_orderkey", 3)


@query("""
SELECT coalesce(a.n_nationkey, b.k) AS id, CASE WHEN a.n_nationkey IS NOT NULL THEN a.n_name ELSE b.name END AS name FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) a FULL JOIN (SELECT n_nationkey AS k, upper(n_name) AS name FROM nation WHERE n_nationkey % 3 = 0) b ON a.n_nationkey = b.k
""")
def j17_saved_stages_win(d: Tables) -> DataFrame:
    saved = d.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("saved"))
    given = d.nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"), F.upper("n_name").alias("given"))
    return saved.join(given, "id", "full").select("id", F.coalesce("saved", "given").alias("name"))


@query("SELECT 'documents' AS asset, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'items', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels")
def a20_s14_assets(d: Tables) -> DataFrame:
    out = None
    for name, table in (("documents", d.documents), ("pages", d.pages), ("vectors", d.embeddings), ("items", d.benchmark), ("labels", d.labels)):
        row = table.agg(F.lit(name).alias("asset"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def i9_tail(d: Tables) -> DataFrame:
    return d.events.select("event_id", "user_id").orderBy(F.desc("event_id")).limit(50)
