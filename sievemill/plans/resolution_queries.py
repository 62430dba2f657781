"""Queries of names, evidence and routes, on texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels, resolution
from .registry import Tables, query

#: Names of parts in nine forms, and a vocabulary of the nations: id, formula, aliases.
_NAMES = r"""WITH v AS (
  SELECT 'NCM' || n_nationkey AS id, 'LiNi' || (n_nationkey + 2) || 'O2' AS formula, [n_name, 'Mat-' || n_nationkey || ' X'] AS aliases, n_nationkey AS rank FROM nation
  UNION ALL SELECT 'LIPF6_DEC-EC', NULL, NULL, 100),
p AS (
  SELECT p_partkey, p_partkey % 10 AS form, p_size % 30 AS k FROM part),
n AS (
  SELECT p_partkey,
    CASE form WHEN 0 THEN '1M LiPF6 in EC/DEC' WHEN 1 THEN '1M LiTFSI in DOL' WHEN 2 THEN 'nation ' || k WHEN 3 THEN 'thing ' || k % 3 WHEN 4 THEN 'NiO2Li' || (k + 2) WHEN 5 THEN 'powder of Nation_' || k || '/batch'
      WHEN 6 THEN 'whatever' WHEN 7 THEN 'Al2O3-coated NATION_' || k WHEN 8 THEN '  ' ELSE 'Mat-' || k || '-X' END AS name,
    CASE form WHEN 3 THEN 'Li1O2Ni' || (k + 2) END AS formula, CASE form WHEN 6 THEN 'MAT ' || k || ',x' WHEN 9 THEN 'no such hint' END AS hint FROM p),
a AS (
  SELECT alias_key, min_by(id, rank * 10 + pos) AS id FROM (
    SELECT id, rank, 0 AS pos, id AS x FROM v UNION ALL SELECT id, rank, unnest(range(1, len(aliases) + 1)), unnest(aliases) FROM v), LATERAL (SELECT lower(regexp_replace(x, '[\s\-_/.,]', '', 'g')) AS alias_key) GROUP BY alias_key),
e AS (
  SELECT x, array_to_string(list_sort(list_transform(regexp_extract_all(x, '[A-Z][a-z]?[0-9]*'), lambda y: CASE WHEN regexp_matches(y, '[0-9]$') THEN y ELSE y || '1' END)), '') AS formula_key
  FROM (SELECT formula AS x FROM v UNION SELECT formula FROM n UNION SELECT name FROM n) WHERE regexp_full_match(x, '(?:Li[0-9]*|Ni[0-9]*|O[0-9]*){3}')),
f AS (
  SELECT formula_key, min_by(id, rank) AS id FROM v JOIN e ON v.formula = e.x GROUP BY formula_key),
t AS (
  SELECT *, regexp_matches(name, '\sin\s') AS whole, regexp_replace(name, '^([A-Za-z0-9]+)-coated ', '') AS base, nullif(regexp_extract(name, '^([A-Za-z0-9]+)-coated ', 1), '') AS coating FROM (SELECT p_partkey, trim(name) AS name, formula, hint FROM n)),
q AS (
  SELECT p_partkey, formula, 1 AS turn, hint AS text FROM t WHERE NOT whole AND hint <> '' UNION ALL SELECT p_partkey, formula, 2, base FROM t WHERE NOT whole AND name <> ''),
b AS (
  SELECT q.*, lower(regexp_replace(text, '[\s\-_/.,]', '', 'g')) AS k, ge.formula_key AS given_key, oe.formula_key AS own_key FROM q LEFT JOIN e ge ON ge.x = q.formula LEFT JOIN e oe ON oe.x = q.text),
c AS (
  SELECT b.*, a.id AS by_alias, coalesce(g.id, o.id) AS by_formula FROM b LEFT JOIN a ON a.alias_key = b.k LEFT JOIN f g ON g.formula_key = given_key LEFT JOIN f o ON o.formula_key = own_key),
h AS (
  SELECT c.p_partkey, c.turn, min_by(a.id, (-length(a.alias_key), a.alias_key)) AS by_part FROM c JOIN a ON length(a.alias_key) >= 3 AND contains(c.k, a.alias_key) WHERE by_alias IS NULL AND by_formula IS NULL GROUP BY ALL),
r AS (
  SELECT c.p_partkey, c.turn, coalesce(by_alias, by_formula, by_part) AS id, CASE WHEN by_alias IS NOT NULL THEN 'alias' WHEN by_formula IS NOT NULL THEN 'formula' ELSE 'alias-contains' END || CASE WHEN c.turn = 1 THEN '+hint' ELSE '' END AS method
  FROM c LEFT JOIN h USING (p_partkey, turn) WHERE coalesce(by_alias, by_formula, by_part) IS NOT NULL),
w AS (
  SELECT p_partkey, min_by(id, turn) AS id, min_by(method, turn) AS method, min(turn) AS turn FROM r GROUP BY p_partkey),
z AS (
  SELECT t.*, CASE WHEN whole AND name = '1M LiPF6 in EC/DEC' THEN 'LIPF6_DEC-EC' ELSE w.id END AS base_id, CASE WHEN whole AND name = '1M LiPF6 in EC/DEC' THEN 'formulation' ELSE coalesce(method, 'none') END AS norm_method, turn
  FROM t LEFT JOIN w USING (p_partkey))
"""


def _named(d: Tables) -> tuple[DataFrame, DataFrame]:
    key, k, form = F.col("n_nationkey"), F.col("p_size") % 30, F.col("p_partkey") % 10
    vocabulary = d.nation.select(F.concat(F.lit("NCM"), key).alias("id"), F.concat(F.lit("LiNi"), key + 2, F.lit("O2")).alias("formula"), F.array("n_name", F.concat(F.lit("Mat-"), key, F.lit(" X"))).alias("aliases"), key.alias("rank"))
    vocabulary = vocabulary.union(d.region.limit(1).select(F.lit("LIPF6_DEC-EC"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(100)))
    name = (
        F.when(form == 0, "1M LiPF6 in EC/DEC").when(form == 1, "1M LiTFSI in DOL").when(form == 2, F.concat(F.lit("nation "), k)).when(form == 3, F.concat(F.lit("thing "), k % 3))
        .when(form == 4, F.concat(F.lit("NiO2Li"), k + 2)).when(form == 5, F.concat(F.lit("powder of Nation_"), k, F.lit("/batch"))).when(form == 6, "whatever")
        .when(form == 7, F.concat(F.lit("Al2O3-coated NATION_"), k)).when(form == 8, "  ").otherwise(F.concat(F.lit("Mat-"), k, F.lit("-X")))
    )
    hint = F.when(form == 6, F.concat(F.lit("MAT "), k, F.lit(",x"))).when(form == 9, "no such hint")
    return d.part.select("p_partkey", name.alias("name"), F.when(form == 3, F.concat(F.lit("Li1O2Ni"), k + 2)).alias("formula"), hint.alias("hint")), vocabulary


@query(_NAMES + "SELECT p_partkey, base_id, CASE WHEN coating IS NOT NULL AND turn = 2 THEN base_id || '_' || coating || '-coated' ELSE base_id END AS variant_id, norm_method FROM z")
def n4_resolution_cascade(d: Tables) -> DataFrame:
    rows, vocabulary = _named(d)
    return resolution.resolved(rows, vocabulary).select("p_partkey", "base_id", "variant_id", "norm_method")


@query(_NAMES + "SELECT name, formula, count(*) AS n FROM z WHERE norm_method = 'none' AND name <> '' GROUP BY ALL")
def n5_unmatched_queue(d: Tables) -> DataFrame:
    rows, vocabulary = _named(d)
    return resolution.unresolved(resolution.resolved(rows, vocabulary))


_EVIDENCE = """WITH e AS (
  SELECT c.conv_id, c.turn, CASE WHEN c.turn % 5 <> 4 THEN c.role END AS source, CASE WHEN c.conv_id % 3 = 0 THEN 'Cathode NCM811 and graphite' WHEN c.conv_id % 3 = 1 THEN 'Prussian white' END AS scheme,
    CASE (c.conv_id + c.turn) % 6 WHEN 0 THEN 'A Na-ion cell. ' WHEN 1 THEN '锂和钠离子. ' WHEN 2 THEN 'Na3V2 and LITHIUM. ' WHEN 3 THEN '钾离子. ' ELSE '' END || c.text AS text FROM conversations c),
j AS (
  SELECT *, coalesce(length(source), 0) > 0 AND coalesce(length(text), 0) > 0 AS is_evidence, concat_ws(' ', lower(source), lower(text)) AS x, lower(coalesce(scheme, '')) AS y FROM e),
k AS (
  SELECT conv_id, turn, is_evidence, is_evidence AND len(list_filter(['li', '锂', 'lithium', 'ncm', 'lfp', 'lhce', 'lp40'], lambda w: contains(y, w))) > 0
    AND len(list_filter(['钠离子', 'na-ion', 'sodium-ion', '硬碳钠电', 'mose2', 'na3v2', '钾离子', 'k-ion'], lambda w: contains(x, w))) > 0
    AND len(list_filter(['li', '锂', 'lithium'], lambda w: contains(x, w))) = 0 AS is_foreign FROM j)
"""


@query(_EVIDENCE + "SELECT conv_id, turn, is_evidence, is_foreign FROM k")
def f17_foreign_evidence(d: Tables) -> DataFrame:
    at = (F.col("conv_id") + F.col("turn")) % 6
    start = F.when(at == 0, "A Na-ion cell. ").when(at == 1, "锂和钠离子. ").when(at == 2, "Na3V2 and LITHIUM. ").when(at == 3, "钾离子. ").otherwise("")
    scheme = F.when(F.col("conv_id") % 3 == 0, "Cathode NCM811 and graphite").when(F.col("conv_id") % 3 == 1, "Prussian white")
    rows = d.conversations.select("conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("role")).alias("source"), scheme.alias("scheme"), F.concat(start, F.col("text")).alias("text"))
    return labels.foreign_evidence(rows, "scheme", "source", "text").select("conv_id", "turn", "is_evidence", "is_foreign")


@query(r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' 高温固相法' WHEN 1 THEN ' by a Sol - Gel way' WHEN 2 THEN ' PECHINI; (Ni,Mn)CO3' WHEN 3 THEN ' Ni(OH) 2, 碳酸盐共沉淀' ELSE '' END AS x FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(x, '(?:高温)?固相(?:法|合成|烧结|路线|反应)') THEN 'solid_state' END, CASE WHEN regexp_matches(x, '(?i)(?:溶胶[-–—\s]*凝胶|sol[-–—\s]*gel|pechini)') THEN 'sol_gel' END,
  CASE WHEN regexp_matches(x, '(?i)(?:碳酸盐|\([^)]+\)CO3)') THEN 'carbonate_coprecipitation' END, CASE WHEN regexp_matches(x, '(?i)(?:\(OH\)\s*2|氢氧化物)') THEN 'hydroxide_coprecipitation' END) AS routes FROM t
""")
def l11_synthesis_routes(d: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    end = F.when(k == 0, " 高温固相法").when(k == 1, " by a Sol - Gel way").when(k == 2, " PECHINI; (Ni,Mn)CO3").when(k == 3, " Ni(OH) 2, 碳酸盐共沉淀").otherwise("")
    rows = d.documents.select("doc_id", F.concat("text", end).alias("text"))
    return labels.with_routes(rows).select("doc_id", F.array_join("routes", ",").alias("routes"))
