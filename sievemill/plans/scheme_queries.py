"""Queries of design schemes and stage gates, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, labels, schemes
from .registry import Tables, query

#: Materials: a cathode for each brand, an anode for each region, an electrolyte for each sixth of the nations.
_MATERIALS = """WITH c AS (
  SELECT CASE b WHEN 1 THEN 'LNMO' WHEN 2 THEN 'LRMO' ELSE 'CAT' || b END AS id, ['Brand-' || b || '!'] AS aliases, b AS place, CAST(3 AS DOUBLE) + b % 17 / CAST(10 AS DOUBLE) AS voltage,
         CAST(3 AS DOUBLE) + b % 20 / CAST(10 AS DOUBLE) AS voltage_limit, CAST(150 + s % 120 AS DOUBLE) AS capacity
  FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS b, sum(p_size) AS s FROM part GROUP BY 1)),
a AS (
  SELECT CASE r_regionkey WHEN 0 THEN 'graphite' WHEN 1 THEN 'si_base' WHEN 2 THEN 'li_metal' ELSE 'anode_' || r_regionkey END AS id, CASE r_regionkey WHEN 1 THEN ['silicon'] WHEN 2 THEN ['lithium foil', 'foil'] ELSE [] END AS aliases, r_regionkey AS place FROM region),
e AS (
  SELECT DISTINCT CASE n_nationkey % 6 WHEN 0 THEN 'carbonate_ec' WHEN 1 THEN 'carbonate_fec' WHEN 2 THEN 'lhce' WHEN 3 THEN 'ether' WHEN 4 THEN 'carbonate_dmc' ELSE 'ionic' END AS id, CASE n_nationkey % 6 WHEN 2 THEN ['local high'] ELSE [] END AS aliases, n_nationkey % 6 AS place FROM nation),
n AS (
  SELECT id, lower(unnest(list_concat([id], aliases))) AS name FROM (SELECT id, aliases FROM c UNION ALL SELECT id, aliases FROM a UNION ALL SELECT id, aliases FROM e)),
"""

_SCHEMES = """s AS (
  SELECT p_partkey, CASE WHEN p_partkey % 29 = 0 THEN 'no such' ELSE 'doped BRAND-' || regexp_extract(p_brand, '([0-9]+)', 1) || '! powder' END AS cathode,
    CASE p_size % 7 WHEN 0 THEN 'Graphite sheet' WHEN 1 THEN 'a Silicon base' WHEN 2 THEN 'Lithium Foil' WHEN 3 THEN 'anode_3' WHEN 4 THEN NULL WHEN 5 THEN 'graphite' ELSE 'ANODE_4 x' END AS anode,
    CASE p_partkey % 6 WHEN 0 THEN 'Carbonate_EC with salt' WHEN 1 THEN 'carbonate_fec' WHEN 2 THEN 'a Local High one' WHEN 3 THEN 'ether' WHEN 4 THEN 'CARBONATE_DMC' ELSE 'ionic' END AS electrolyte,
    CASE p_partkey % 5 WHEN 0 THEN ['FEC', 'x'] WHEN 1 THEN ['LiNO3'] WHEN 2 THEN [] END AS additives, CASE WHEN p_partkey % 7 = 0 THEN '单晶 and ' || p_name ELSE p_name END AS notes,
    CASE WHEN p_partkey % 4 = 0 THEN ['gradient'] ELSE [] END AS modifications, CASE WHEN p_partkey % 3 = 0 THEN ['electrolyte'] END AS user_locked,
    coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 3 END, CASE WHEN p_partkey % 3 = 0 THEN CAST(450 AS DOUBLE) END) AS target FROM part),
r AS (
  SELECT s.*, (SELECT min_by(id, (-length(name), name)) FROM n WHERE contains(lower(s.cathode), name)) AS ci, (SELECT min_by(id, (-length(name), name)) FROM n WHERE contains(lower(s.anode), name)) AS ai,
         (SELECT min_by(id, (-length(name), name)) FROM n WHERE contains(lower(s.electrolyte), name)) AS ei FROM s),
t AS (
  SELECT r.*, c.voltage_limit, coalesce(ai, anode) AS an, coalesce(ei, electrolyte) AS el, coalesce(ci, cathode) AS ca,
         lower(concat_ws(' ', cathode, anode, electrolyte, array_to_string(additives, ' '), notes, array_to_string(modifications, ' '), array_to_string(user_locked, ' '), ci, ai, ei)) AS x,
         coalesce(list_contains(user_locked, 'electrolyte'), false) AND len(modifications) > 0 AS locked FROM r LEFT JOIN c ON c.id = ci),
"""
_EASED = "(locked OR len(list_filter([{}], lambda w: contains(x, w))) > 0)"
_W1 = "'fec', '氟代碳酸乙烯酯', 'fluoroethylene carbonate', 'lipo2f2', '二氟磷酸锂', 'difluorophosphate', 'vc', '碳酸亚乙烯酯', 'vinylene carbonate', 'dtd', 'lpo', '包覆', 'coating', '快离子', 'al2o3', 'single_crystal', '单晶', 'sc-', 'single crystal'"
_W2 = "'fec', '氟代碳酸乙烯酯', 'fluoroethylene carbonate', 'lipo2f2', '二氟磷酸锂', 'difluorophosphate', 'dtd', 'lpo', '包覆', 'coating', '快离子', 'al2o3'"
_W3 = "'artificial_sei', '人工sei', '人工界面', '保护层', 'artificial sei', 'alloy_li_ag', 'li-ag', 'las', '合金', '亲锂', 'lithiophilic_framework', '三维', '3d', '骨架', 'fec', '氟代碳酸乙烯酯', 'fluoroethylene carbonate', 'lino3', 'lhce'"
#: What each rule finds of columns voltage_limit, el, an, ca, target, x, locked, additives.
_RULES = f"""list_filter([
    CASE WHEN coalesce(voltage_limit > CAST(4.3 AS DOUBLE) AND contains(lower(el), 'carbonate'), false) THEN 'C1:' || CASE WHEN {_EASED.format(_W1)} THEN 'eased' ELSE 'violation' END END,
    CASE WHEN coalesce(voltage_limit > CAST(4.6 AS DOUBLE) AND el = 'carbonate_ec', false) THEN 'C2:' || CASE WHEN {_EASED.format(_W2)} THEN 'eased' ELSE 'violation' END END,
    CASE WHEN coalesce(an = 'li_metal' AND contains(lower(el), 'carbonate'), false) THEN 'C3:' || CASE WHEN {_EASED.format(_W3)} THEN 'eased' ELSE 'violation' END END,
    CASE WHEN coalesce(an = 'si_base', false) THEN 'C5:recommended' || CASE WHEN coalesce(list_contains(additives, 'FEC'), false) THEN '' ELSE ':additive:FEC' END END,
    CASE WHEN coalesce(ca IN ('LNMO', 'LRMO'), false) THEN 'C6:audit_note' END,
    CASE WHEN coalesce(target >= 400, false) THEN 'C7:' || CASE WHEN coalesce(an = 'graphite', false) THEN 'violation' ELSE 'material_energy' END END,
    CASE WHEN coalesce(target >= 500, false) THEN 'C8:frontier' END], lambda h: h IS NOT NULL)"""


def _materials(d: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cathodes, anodes, electrolytes, all of them)."""
    none = F.array().cast("array<string>")
    b = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("b")
    c = d.part.groupBy(b).agg(F.sum("p_size").alias("s")).select(
        F.when(F.col("b") == 1, "LNMO").when(F.col("b") == 2, "LRMO").otherwise(F.concat(F.lit("CAT"), "b")).alias("id"), F.array(F.concat(F.lit("Brand-"), "b", F.lit("!"))).alias("aliases"), F.col("b").alias("place"),
        (3 + F.col("b") % 17 / 10).alias("voltage"), (3 + F.col("b") % 20 / 10).alias("voltage_limit"), (150 + F.col("s") % 120).cast("double").alias("capacity"),
    )
    k = F.col("r_regionkey")
    a = d.region.select(
        F.when(k == 0, "graphite").when(k == 1, "si_base").when(k == 2, "li_metal").otherwise(F.concat(F.lit("anode_"), k)).alias("id"),
        F.when(k == 1, F.array(F.lit("silicon"))).when(k == 2, F.array(F.lit("lithium foil"), F.lit("foil"))).otherwise(none).alias("aliases"), k.cast("long").alias("place"),
    )
    names = ["carbonate_ec", "carbonate_fec", "lhce", "ether", "carbonate_dmc", "ionic"]
    k = F.col("n_nationkey") % 6
    e = d.nation.select(F.get(F.array(*[F.lit(n) for n in names]), k).alias("id"), F.when(k == 2, F.array(F.lit("local high"))).otherwise(none).alias("aliases"), k.cast("long").alias("place")).distinct()
    return c, a, e, c.select("id", "aliases", "voltage_limit").unionByName(a.select("id", "aliases"), allowMissingColumns=True).unionByName(e.select("id", "aliases"), allowMissingColumns=True)


def _schemes(d: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size") % 7
    of = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    anode = F.when(size == 0, "Graphite sheet").when(size == 1, "a Silicon base").when(size == 2, "Lithium Foil").when(size == 3, "anode_3").when(size == 5, "graphite").when(size == 6, "ANODE_4 x")
    electrolyte = F.get(of("Carbonate_EC with salt", "carbonate_fec", "a Local High one", "ether", "CARBONATE_DMC", "ionic"), (key % 6).cast("int"))
    return d.part.select(
        "p_partkey", F.when(key % 29 == 0, "no such").otherwise(F.concat(F.lit("doped BRAND-"), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("! powder"))).alias("cathode"), anode.alias("anode"), electrolyte.alias("electrolyte"),
        F.when(key % 5 == 0, of("FEC", "x")).when(key % 5 == 1, of("LiNO3")).when(key % 5 == 2, none).alias("additives"), F.when(key % 7 == 0, F.concat(F.lit("单晶 and "), "p_name")).otherwise(F.col("p_name")).alias("notes"),
        F.when(key % 4 == 0, of("gradient")).otherwise(none).alias("modifications"), F.when(key % 3 == 0, of("electrolyte")).alias("user_locked"),
        F.when(key % 2 == 0, F.col("p_retailprice") / 3).alias("target_energy_wh_kg"), F.when(key % 3 == 0, F.lit(450.0)).alias("claimed_energy"),
    )


def _shown(hits: str = "hits"):
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["rule"], h["outcome"], h["missing"])), ";")


@query(_MATERIALS + _SCHEMES + f"""f AS (SELECT *, list_concat(CASE WHEN ci IS NULL OR ei IS NULL OR (ai IS NULL AND anode IS NOT NULL) THEN ['C0:unverified'] ELSE [] END, {_RULES}) AS hits FROM t)
SELECT p_partkey, array_to_string(hits, ';') AS hits, len(list_filter(hits, lambda h: h = 'C0:unverified' OR contains(h, ':violation'))) = 0 AS feasible FROM f
""")
def e1_e4_j15_rules(d: Tables) -> DataFrame:
    judged = schemes.evaluated(_schemes(d), _materials(d)[3])
    return judged.select("p_partkey", _shown().alias("hits"), "feasible")


_EVERY = """k AS (
  SELECT c.id AS ca, a.id AS an, e.id AS el, c.voltage_limit, (c.place, a.place, e.place) AS place, [] AS additives, lower(concat_ws(' ', c.id, a.id, e.id)) AS x, false AS locked,
         c.voltage * c.capacity * CASE a.id WHEN 'graphite' THEN CAST(0.5 AS DOUBLE) WHEN 'si_base' THEN CAST(0.45 AS DOUBLE) WHEN 'li_metal' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.48 AS DOUBLE) END AS energy FROM c, a, e),
"""


@query(_MATERIALS + _EVERY + f"""j AS (SELECT *, {_RULES} AS hits FROM k, (SELECT unnest([CAST(300 AS DOUBLE), 350, 400, 450]) AS target)),
f AS (SELECT * FROM j WHERE len(list_filter(hits, lambda h: contains(h, ':violation'))) = 0),
b AS (SELECT target, count(*) AS n, min_by(row(ca, an, el, energy), (-energy, place)) FILTER (energy >= target) AS best FROM f GROUP BY target)
SELECT CAST(t.target AS INTEGER) AS target, coalesce(n, 0) AS n_feasible, best IS NOT NULL AS feasible, best[1] AS cathode, best[2] AS anode, best[3] AS electrolyte, round(best[4], 6) AS energy
FROM (SELECT unnest([CAST(300 AS DOUBLE), 350, 400, 450]) AS target) t LEFT JOIN b ON b.target = t.target
""")
def e6_e9_enumeration(d: Tables) -> DataFrame:
    c, a, e, every = _materials(d)
    return schemes.combination_tasks(schemes.enumerated(c, a, e), every).withColumn("energy", F.round("energy", 6))


@query(_MATERIALS + _EVERY + f"""j AS (SELECT *, {_RULES} AS hits FROM k, (SELECT unnest([CAST(NULL AS DOUBLE), 400, 500]) AS target)),
v AS (SELECT *, unnest(list_filter(hits, lambda h: contains(h, ':violation'))) AS h FROM j)
SELECT split_part(h, ':', 1) AS rule, min_by(ca, place) AS cathode, min_by(an, place) AS anode, min_by(el, place) AS electrolyte FROM v GROUP BY 1
""")
def e6_violating_combinations(d: Tables) -> DataFrame:
    c, a, e, every = _materials(d)
    return schemes.violating_tasks(schemes.enumerated(c, a, e), every)


def _evidence(gate: DataFrame) -> DataFrame:
    """A row for each code that rows fail by, or one without evidence."""
    return gate.select("gate", "passed", "code", "observed", "failing", F.explode_outer("evidence").alias("e")).select("gate", "passed", "code", "observed", "failing", F.col("e.code").alias("why"), F.col("e.rows").alias("rows"), F.col("e.first").alias("first"), F.col("e.notes").alias("notes"))


_GATE = """gate_total AS (SELECT count(*) AS observed, count(why) AS failing, count(*) FILTER (why IS NOT NULL) = 0 AS passed, coalesce(min_by(why, rank), 'OK') AS code FROM j),
gate_code AS (SELECT why, count(*) AS n, min(row(coalesce(key, ''), coalesce(notes, ''))) AS f FROM j WHERE why IS NOT NULL GROUP BY why)
SELECT '{}' AS gate, passed, code, observed, failing, why, n AS rows, f[1] AS first, f[2] AS notes FROM gate_total LEFT JOIN gate_code ON true
"""


@query("""
WITH m AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN 'm' || c_custkey END AS id FROM customer),
c AS (SELECT CASE WHEN o_orderkey % 997 = 3 THEN NULL WHEN o_orderkey % 500 = 7 THEN 'twice' || o_orderkey // 1000 ELSE 'cell' || o_orderkey END AS cell_id, 'm' || o_custkey % 120 AS cathode, CASE WHEN o_orderkey % 613 = 5 THEN '' ELSE 'm' || o_orderkey % 90 END AS anode,
  'm' || CAST(floor(o_totalprice) AS BIGINT) % 110 AS electrolyte, CASE WHEN o_orderkey % 701 = 9 THEN ' ' ELSE o_orderpriority END AS provenance FROM orders),
k AS (SELECT *, concat_ws(',', CASE WHEN trim(coalesce(cell_id, '')) = '' THEN 'cell_id' END, CASE WHEN trim(cathode) = '' THEN 'cathode' END, CASE WHEN trim(anode) = '' THEN 'anode' END, CASE WHEN trim(electrolyte) = '' THEN 'electrolyte' END, CASE WHEN trim(provenance) = '' THEN 'provenance' END) AS lacking,
  count(*) OVER (PARTITION BY cell_id) > 1 AND cell_id IS NOT NULL AS twice, list_min(list_filter([cathode, anode, electrolyte], lambda x: trim(x) <> '' AND NOT list_contains(ids, x))) AS dangling FROM c, (SELECT list(id) AS ids FROM m)),
j AS (SELECT cell_id AS key, CASE WHEN lacking <> '' THEN lacking ELSE dangling END AS notes, CASE WHEN lacking <> '' THEN 'CELL_SPEC_INCOMPLETE' WHEN twice THEN 'CELL_ID_REPEATED' WHEN dangling IS NOT NULL THEN 'UNKNOWN_COMPONENT' END AS why,
  CASE WHEN lacking <> '' THEN 1 WHEN twice THEN 2 ELSE 3 END AS rank FROM k),
""" + _GATE.format("cell_assembly"))
def e26_cell_assembly_gate(d: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    m = lambda x: F.concat(F.lit("m"), x)
    cells = d.orders.select(
        F.when(key % 997 == 3, None).when(key % 500 == 7, F.concat(F.lit("twice"), F.floor(key / 1000))).otherwise(F.concat(F.lit("cell"), key)).alias("cell_id"), m(F.col("o_custkey") % 120).alias("cathode"),
        F.when(key % 613 == 5, "").otherwise(m(key % 90)).alias("anode"), m(F.floor("o_totalprice") % 110).alias("electrolyte"), F.when(key % 701 == 9, " ").otherwise(F.col("o_orderpriority")).alias("provenance"),
    )
    materials = d.customer.select(F.when(F.col("c_custkey") % 50 != 0, m(F.col("c_custkey"))).alias("material_id"))
    return _evidence(gates.cell_assembly(materials, cells))


_MARKDOWN = """CASE {k} % 11 WHEN 0 THEN '# 目标' WHEN 1 THEN '# Target' || {fill} WHEN 2 THEN '**1. 目标** **推荐组合** **3 Metrics** ** 依据 ** **risks**' || {fill} WHEN 3 THEN NULL
  ELSE '# 能量目标' || chr(10) || '## Combination' || chr(10) || '### 性能指标' || chr(10) || '#### 文献证据' || chr(10) || '## Gaps' || chr(10) || {fill} END"""


def _lacking(sections: list[tuple[str, str]], text: str, heads: str) -> str:
    return "concat_ws(',', " + ", ".join(rf"CASE WHEN NOT (regexp_matches({heads}, '{words}') OR regexp_matches({text}, '(?i)\*\*\s*[0-9]?\.?\s*(?:{words})\s*\*\*')) THEN '{name}' END" for name, words in sections) + ")"


_HEADS = "lower(array_to_string(regexp_extract_all({}, '(?m)^#{{1,4}}[ \t]+(.+)$', 1), chr(10)))"
_DESIGN = [("目标与设计路线", "目标|设计路线|能量目标|target|路线"), ("推荐组合", "推荐材料组合|推荐组合|正极|负极|电解液|combination|配方"), ("预期关键指标", "预期指标|关键指标|能量密度|比容量|metrics|性能指标"),
           ("可行性依据", "可行性依据|文献证据|机理支撑|feasibility|evidence|依据"), ("风险与数据缺口", "风险与数据缺口|风险分析|数据缺口|risks|gaps|风险评估")]


@query(_MATERIALS + _SCHEMES + f"""f AS (SELECT *, list_concat(CASE WHEN ci IS NULL OR ei IS NULL OR (ai IS NULL AND anode IS NOT NULL) THEN ['C0:unverified'] ELSE [] END, {_RULES}) AS hits FROM t),
g AS (SELECT f.*, p_partkey % 13 <> 6 AS reviewed, {_MARKDOWN.format(k="p_partkey", fill="repeat('text ', 50)")} AS md, len(list_filter(hits, lambda h: h = 'C0:unverified' OR contains(h, ':violation'))) = 0 AS feasible FROM f),
v AS (SELECT l_partkey, count(*) FILTER (l_linenumber % 2 = 0) AS valid, count(*) FILTER (l_linenumber % 2 = 0 AND l_orderkey % 3 <> 0) AS relevant FROM lineitem GROUP BY l_partkey),
h AS (SELECT g.*, coalesce(valid, 0) AS valid, coalesce(relevant, 0) AS relevant, {_lacking(_DESIGN, "coalesce(md, '')", _HEADS.format("coalesce(md, '')"))} AS lacking FROM g LEFT JOIN v ON l_partkey = p_partkey),
i AS (SELECT p_partkey, lacking, CASE WHEN length(trim(coalesce(md, ''))) < 200 THEN 1 WHEN lacking <> '' THEN 2 WHEN valid = 0 THEN 3 WHEN relevant = 0 THEN 4 WHEN NOT reviewed THEN 5 WHEN cathode IS NULL OR anode IS NULL OR electrolyte IS NULL THEN 6 WHEN NOT feasible THEN 7 END AS rank FROM h),
j AS (SELECT CAST(p_partkey AS VARCHAR) AS key, lacking AS notes, rank, ['DESIGN_SCHEME_MD_TOO_SHORT', 'DESIGN_SCHEME_SECTIONS_INCOMPLETE', 'EVIDENCE_MISSING', 'EVIDENCE_CHEMISTRY_MISMATCH', 'REVIEWER_RESPONSE_FAILED', 'STRUCTURED_SCHEME_INCOMPLETE', 'RELATION_ENGINE_VIOLATION'][rank] AS why FROM i),
""" + _GATE.format("design"))
def e26_design_gate(d: Tables) -> DataFrame:
    key, fill = F.col("p_partkey"), F.repeat(F.lit("text "), 50)
    markdown = (
        F.when(key % 11 == 0, "# 目标").when(key % 11 == 1, F.concat(F.lit("# Target"), fill)).when(key % 11 == 2, F.concat(F.lit("**1. 目标** **推荐组合** **3 Metrics** ** 依据 ** **risks**"), fill)).when(key % 11 == 3, None)
        .otherwise(F.concat(F.lit("# 能量目标\n## Combination\n### 性能指标\n#### 文献证据\n## Gaps\n"), fill))
    )
    judged = schemes.evaluated(_schemes(d), _materials(d)[3]).withColumns({"scheme_id": key, "markdown": markdown, "reviewed": key % 13 != 6})
    told = d.lineitem.select(F.col("l_partkey").alias("scheme_id"), F.lit("a li cell").alias("scheme"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("source"), F.when(F.col("l_orderkey") % 3 == 0, "Na-ion data").otherwise("data").alias("text"))
    return _evidence(gates.design(judged, labels.foreign_evidence(told, "scheme", "source", "text")))


_REPORT = [("研发摘要", "研发摘要|执行摘要|总体概览|summary"), ("文献与电芯数据概况", "文献|数据概况|电芯挖掘|literature|mining|stage journal|阶段履历"), ("电池体系设计方案", "体系设计方案|设计方案|正极|负极|电解液|design|方案"),
           ("物理仿真与验证", "仿真与优化分析|物理仿真|pinn|pybamm|仿真验证|跳过说明|simulation|物理"), ("实验配方与落地建议", "实验路线与验证计划|实验配方|落地建议|制备工艺|研发路线|recipe|roadmap|后续建议|结论")]


@query(f"""
WITH r AS (SELECT c_custkey AS goal, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '# Summary' WHEN 2 THEN '# Summary' || repeat(' text', 90) ELSE '# Executive SUMMARY' || chr(10) || '## 文献' || chr(10) || '## The design' || chr(10) || '#### PINN' || chr(10) || '**5. Recipe**' || repeat(' text', 90) END AS md FROM customer),
s AS (SELECT c_custkey AS goal, k AS stage, CASE WHEN (c_custkey + k) % 40 = 0 THEN 'FAILED' WHEN (c_custkey + k) % 9 = 0 THEN 'SKIPPED' WHEN (c_custkey + k) % 8 = 0 AND k = 5 THEN 'FALLBACK' ELSE 'PASSED' END AS status, c_custkey % 3 <> 0 AS ok FROM customer, (SELECT unnest(range(1, 7)) AS k)),
p AS (SELECT goal, count(DISTINCT stage) AS passed FROM s WHERE stage <= 5 AND (status = 'PASSED' OR (status = 'SKIPPED' AND ok) OR (status = 'FALLBACK' AND stage = 5)) GROUP BY goal),
y AS (SELECT o_custkey AS goal, count(*) AS entries, count(*) FILTER (o_orderkey % 60 = 0 AND o_orderstatus <> 'F') AS claims FROM orders GROUP BY o_custkey),
h AS (SELECT r.*, coalesce(passed, 0) AS passed, coalesce(entries, 0) AS entries, coalesce(claims, 0) AS claims, {_lacking(_REPORT, "coalesce(md, '')", _HEADS.format("coalesce(md, '')"))} AS lacking FROM r LEFT JOIN p USING (goal) LEFT JOIN y USING (goal)),
i AS (SELECT goal, lacking, CASE WHEN passed < 5 THEN 1 WHEN md IS NULL THEN 2 WHEN length(trim(md)) < 400 THEN 3 WHEN lacking <> '' THEN 4 WHEN entries = 0 THEN 5 WHEN claims > 0 THEN 6 END AS rank FROM h),
j AS (SELECT CAST(goal AS VARCHAR) AS key, lacking AS notes, rank, ['REPORT_PREREQUISITES_INCOMPLETE', 'SYNTHESIS_REPORT_MISSING', 'SYNTHESIS_REPORT_TOO_SHORT', 'SYNTHESIS_REPORT_SECTIONS_INCOMPLETE', 'STAGE_JOURNAL_MISSING', 'STAGE_JOURNAL_PINN_MISMATCH'][rank] AS why FROM i),
""" + _GATE.format("report"))
def e26_report_gate(d: Tables) -> DataFrame:
    key, fill = F.col("c_custkey"), F.repeat(F.lit(" text"), 90)
    markdown = (
        F.when(key % 7 == 0, None).when(key % 7 == 1, "# Summary").when(key % 7 == 2, F.concat(F.lit("# Summary"), fill))
        .otherwise(F.concat(F.lit("# Executive SUMMARY\n## 文献\n## The design\n#### PINN\n**5. Recipe**"), fill))
    )
    reports = d.customer.select(key.alias("goal"), markdown.alias("markdown"))
    at = F.col("goal") + F.col("stage")
    status = F.when(at % 40 == 0, "FAILED").when(at % 9 == 0, "SKIPPED").when((at % 8 == 0) & (F.col("stage") == 5), "FALLBACK").otherwise("PASSED")
    stages = d.customer.select(key.alias("goal"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("stage")).select("goal", "stage", status.alias("status"), (F.col("goal") % 3 != 0).alias("allow_skip"), F.lit(True).alias("skip"))
    journals = d.orders.select(F.col("o_custkey").alias("goal"), (F.col("o_orderkey") % 60 == 0).alias("delivers_simulation"), (F.col("o_orderstatus") == "F").alias("has_simulation"))
    return _evidence(gates.report(reports, stages, journals))
