"""Queries of geometry contracts, revisions and evaluations, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anchors, contracts, extractor, rules
from .registry import Tables, query


@query(r"""
WITH q AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 2 = 0 THEN 'NCM811 solid-state diffusion is constant: ' ELSE 'ncm811的固相扩散 (恒定) ' END AS a, (1 + c_custkey % 9) || '.5e-1' || c_custkey % 4 || CASE WHEN c_custkey % 3 = 0 THEN ' cm²/s' ELSE 'cm^2/s' END AS b,
  CAST((1 + c_custkey % 9) || '.5e-1' || c_custkey % 4 AS DOUBLE) AS v FROM customer),
p AS (SELECT pid, 'Intro. ' || a || b || ' at 25 °C by GITT. End' AS text FROM q),
c AS (SELECT o_orderkey, o_custkey AS passage_id, o_orderkey % 14 AS k, CASE o_orderkey % 14 WHEN 1 THEN a || b || ' at 25 °C by GITT!' WHEN 12 THEN a || b ELSE a || b || ' at 25 °C by GITT' END AS quote, CASE o_orderkey % 14 WHEN 2 THEN 'LFP' ELSE 'NCM811' END AS material_id,
  CASE o_orderkey % 14 WHEN 3 THEN 'other' ELSE 'solid_diffusion_coefficient' END AS parameter, CASE o_orderkey % 14 WHEN 8 THEN NULL WHEN 9 THEN v + 1 ELSE v END AS value, CASE o_orderkey % 14 WHEN 7 THEN 'mm2/s' WHEN 10 THEN 'm2/s' ELSE 'cm2/s' END AS unit,
  CASE o_orderkey % 14 WHEN 0 THEN NULL WHEN 5 THEN 300 ELSE CAST(298.15 AS DOUBLE) END AS kelvin, CASE o_orderkey % 14 WHEN 4 THEN 'local' ELSE 'constant_full_soc' END AS applicability, CASE o_orderkey % 14 WHEN 6 THEN 'EIS' ELSE 'gitt' END AS method,
  CASE o_orderkey % 14 WHEN 11 THEN v ELSE v * CAST(0.0001 AS DOUBLE) END AS used FROM orders LEFT JOIN q ON pid = o_custkey),
j AS (SELECT c.*, p.text, list_zip(regexp_extract_all(replace(replace(quote, '²', '2'), '^2', '2'), '([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(cm2/s|m2/s)', 1), regexp_extract_all(replace(replace(quote, '²', '2'), '^2', '2'), '([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(cm2/s|m2/s)', 2)) AS pairs,
  CASE unit WHEN 'm2/s' THEN 1 WHEN 'cm2/s' THEN CAST(0.0001 AS DOUBLE) END AS scale FROM c LEFT JOIN p ON p.pid = passage_id),
z AS (SELECT *, CASE WHEN kelvin IS NULL OR quote IS NULL THEN 'FIELDS_MISSING' WHEN NOT coalesce(contains(text, quote), false) THEN 'QUOTE_NOT_IN_PASSAGE' WHEN material_id <> 'NCM811' OR NOT contains(lower(quote), 'ncm811') THEN 'OTHER_MATERIAL'
  WHEN parameter <> 'solid_diffusion_coefficient' OR NOT regexp_matches(quote, '(?is)solid[ -]?(?:phase|state).*?diffus|固相.*?扩散') THEN 'NOT_SOLID_DIFFUSION' WHEN applicability <> 'constant_full_soc' OR NOT regexp_matches(quote, '(?i)constant|full SOC|恒定|全\s*SOC') THEN 'NOT_CONSTANT'
  WHEN abs(kelvin - 298.15) > 0.1 THEN 'OTHER_TEMPERATURE' WHEN NOT regexp_matches(quote, '(?i)298\.15\s*K|25\s*(?:°\s*C|℃)') THEN 'TEMPERATURE_NOT_QUOTED' WHEN NOT contains(lower(quote), lower(method)) THEN 'METHOD_NOT_QUOTED'
  WHEN scale IS NULL OR value IS NULL OR value <= 0 THEN 'BAD_VALUE_OR_UNIT' WHEN len(list_filter(pairs, lambda x: x[2] = unit AND abs(CAST(x[1] AS DOUBLE) - value) <= CAST(0.000000001 AS DOUBLE) * value)) = 0 THEN 'VALUE_NOT_BESIDE_UNIT'
  WHEN abs(value * scale - used) > CAST(0.000000001 AS DOUBLE) * greatest(value * scale, used) THEN 'OTHER_VALUE_USED' ELSE 'OK' END AS code FROM j)
SELECT o_orderkey, code, CASE WHEN code = 'OK' THEN sha256(text) END AS source_hash FROM z
""")
def e15_diffusion_evidence(d: Tables) -> DataFrame:
    key, c = F.col("o_orderkey") % 14, F.col("c_custkey")
    number = F.concat(1 + c % 9, F.lit(".5e-1"), c % 4)
    told = d.customer.select(
        c.alias("pid"), F.when(c % 2 == 0, "NCM811 solid-state diffusion is constant: ").otherwise("ncm811的固相扩散 (恒定) ").alias("a"),
        F.concat(number, F.when(c % 3 == 0, " cm²/s").otherwise("cm^2/s")).alias("b"), number.alias("v"),
    )
    passages = told.select(F.col("pid").alias("passage_id"), F.concat(F.lit("Intro. "), "a", "b", F.lit(" at 25 °C by GITT. End")).alias("text"))
    o = d.orders.join(told, F.col("o_custkey") == F.col("pid"), "left")
    whole = F.concat("a", "b", F.lit(" at 25 °C by GITT"))
    claims = o.select(
        "o_orderkey", F.col("o_custkey").alias("passage_id"), F.when(key == 1, F.concat(whole, F.lit("!"))).when(key == 12, F.concat("a", "b")).otherwise(whole).alias("quote"),
        F.when(key == 2, "LFP").otherwise("NCM811").alias("material_id"), F.when(key == 3, "other").otherwise("solid_diffusion_coefficient").alias("parameter"),
        F.when(key == 8, "true").when(key == 9, (F.col("v").cast("double") + 1).cast("string")).otherwise(F.col("v")).alias("value"), F.when(key == 7, "mm2/s").when(key == 10, "m2/s").otherwise("cm2/s").alias("unit"),
        F.when(key == 5, "300").when(key != 0, "298.15").alias("temperature_K"), F.when(key == 4, "local").otherwise("constant_full_soc").alias("applicability"), F.when(key == 6, "EIS").otherwise("gitt").alias("method"),
        F.lit("NCM811").alias("material"), F.when(key == 11, F.col("v").cast("double")).otherwise(F.col("v").cast("double") * 1e-4).alias("used"),
    )
    return contracts.evidence_codes(claims, passages).select("o_orderkey", "code", "source_hash")


_ORIGINS = ["llm_design", "model_baseline", "literature", "missing", "not_applicable"]


@query("""
WITH s AS (SELECT c_custkey AS id, ['NCM', 'LFP', 'LCO'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS cathode, ['graphite', 'li_metal', 'Si', 'graphite'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS anode FROM customer),
w AS (SELECT *, ['L_um', 'porosity', 'R_s_um', 'D_s_m2s'][CAST(j % 4 + 1 AS INTEGER)] AS field, CASE WHEN j < 4 THEN 'cathode' ELSE 'anode' END AS component FROM s, (SELECT unnest(range(0, 8)) AS j)),
v AS (SELECT *, (id * 7 + j) % 31 <> 0 AS there, CASE WHEN (id + j) % 11 = 0 THEN NULL WHEN (id + 2 * j) % 17 = 0 THEN 'true' ELSE CAST(j % 6 AS VARCHAR) END AS value, ['llm_design', 'model_baseline', 'literature', 'missing', 'not_applicable', NULL][CAST((id + 3 * j) % 6 + 1 AS INTEGER)] AS origin,
  CASE component WHEN 'cathode' THEN cathode ELSE anode END AS material FROM w),
b AS (SELECT ['NCM', 'LFP', 'graphite'][CAST(n_nationkey % 3 + 1 AS INTEGER)] AS material, ['R_s_um', 'D_s_m2s'][CAST(n_nationkey % 2 + 1 AS INTEGER)] AS field, CAST(n_nationkey AS DOUBLE) AS base FROM nation WHERE n_nationkey < 6),
p AS (SELECT id, j, component || '.' || v.field || ':' || CASE WHEN NOT there OR origin IS NULL THEN 'no_source'
   WHEN value IS NULL THEN CASE WHEN v.field IN ('R_s_um', 'D_s_m2s') AND ((base IS NULL AND origin = 'missing') OR (component = 'anode' AND anode = 'li_metal' AND origin = 'not_applicable')) THEN NULL ELSE 'not_allowed_missing' END
   WHEN value = 'true' THEN 'not_a_number' WHEN origin = 'model_baseline' THEN CASE WHEN v.field IN ('R_s_um', 'D_s_m2s') AND coalesce(CAST(value AS DOUBLE) = base, false) THEN NULL ELSE 'not_the_baseline' END
   WHEN v.field = 'D_s_m2s' THEN CASE WHEN origin <> 'literature' THEN 'unknown_origin' END WHEN origin <> 'llm_design' THEN 'unknown_origin' END AS p FROM v LEFT JOIN b ON b.material = v.material AND b.field = v.field)
SELECT id AS scheme_id, coalesce(string_agg(p, ';' ORDER BY j), '') AS problems FROM p GROUP BY id
""")
def e15_contract_problems(d: Tables) -> DataFrame:
    c, j = F.col("scheme_id"), F.col("j")
    of = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    schemes = d.customer.select(F.col("c_custkey").alias("scheme_id"), of(["NCM", "LFP", "LCO"], F.col("c_custkey") % 3).alias("cathode"), of(["graphite", "li_metal", "Si", "graphite"], F.col("c_custkey") % 4).alias("anode"))
    values = schemes.select("scheme_id", F.posexplode(F.array(*[F.lit(p) for p in contracts.PATHS])).alias("j", "path")).filter((c * 7 + j) % 31 != 0).select(
        "scheme_id", "path", F.when((c + j) % 11 == 0, None).when((c + 2 * j) % 17 == 0, "true").otherwise((j % 6).cast("string")).alias("value"), of([*_ORIGINS, None], (c + 3 * j) % 6).alias("origin"),
    )
    n = F.col("n_nationkey")
    baseline = d.nation.filter("n_nationkey < 6").select(of(["NCM", "LFP", "graphite"], n % 3).alias("material"), of(["R_s_um", "D_s_m2s"], n % 2).alias("field"), n.cast("double").alias("value"))
    return contracts.contract_problems(schemes, values, baseline).select("scheme_id", F.array_join("problems", ";").alias("problems"))


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'VALUE_ILLEGAL' WHEN c_custkey % 7 = 0 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS r1 FROM customer),
e AS (SELECT *, CASE WHEN r1 <> 'OK' THEN 'STALE' WHEN k % 3 = 0 THEN 'FIELD_UNKNOWN' ELSE 'OK' END AS r2, CASE WHEN r1 <> 'OK' THEN 'OK' ELSE 'STALE' END AS r3 FROM c),
f AS (SELECT *, CASE WHEN r1 = 'OK' AND r2 = 'OK' THEN 'EMPTY' ELSE 'STALE' END AS r4 FROM e)
SELECT k AS scheme_id, CAST(CAST(r1 = 'OK' AS INTEGER) + CAST(r2 = 'OK' AS INTEGER) + CAST(r3 = 'OK' AS INTEGER) AS INTEGER) AS revision, CAST(CASE WHEN r1 = 'OK' THEN 60 + k % 50 ELSE 50 + k % 30 END AS DOUBLE) AS thickness,
  CASE WHEN r2 = 'OK' THEN CAST(0.25 AS DOUBLE) WHEN r3 = 'OK' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS porosity, '1:' || r1 || ',2:' || r2 || ',3:' || r3 || ',4:' || r4 AS log FROM f
""")
def e16_locked_revisions(d: Tables) -> DataFrame:
    """Four requests a scheme: on its first state, on the state after that, on the first again, and one without changes on the last."""
    k = F.col("c_custkey")
    at = lambda thickness, porosity: F.create_map(F.lit("cathode.L_um"), thickness.cast("double"), F.lit("cathode.porosity"), F.lit(porosity))
    first, second, third = at(50 + k % 30, 0.3), at(60 + k % 50, 0.3), at(60 + k % 50, 0.25)
    schemes = d.customer.select(k.alias("scheme_id"), F.lit(0).alias("revision"), first.alias("geometry"))
    entry = lambda *kv: F.create_map(*[x if isinstance(x, type(k)) else F.lit(x) for x in kv])
    thickness = F.when(k % 5 == 0, "true").when(k % 7 == 0, "999").otherwise((60 + k % 50).cast("string"))
    changed = F.when(k % 3 == 0, entry("cathode.porosity", "0.2", "anode.colour", "1")).otherwise(entry("cathode.porosity", "0.25"))
    requests = [(1, 0, first, entry("cathode.L_um", thickness)), (2, 1, second, changed), (3, 0, first, entry("cathode.porosity", "0.4")), (4, 2, third, F.create_map().cast("map<string,string>"))]
    each = [F.struct(F.lit(i).alias("request_id"), F.lit(r).alias("base_revision"), contracts.geometry_hash(g).alias("base_hash"), c.alias("changes")) for i, r, g, c in requests]
    asked = d.customer.select(k.alias("scheme_id"), F.explode(F.array(*each)).alias("r")).select("scheme_id", "r.*")
    done = contracts.revised(schemes, asked, {"cathode.L_um": (10, 200), "cathode.porosity": (0.05, 0.7)})
    log = F.array_join(F.transform("log", lambda x: F.concat(x["request_id"].cast("string"), F.lit(":"), x["code"])), ",")
    return done.select("scheme_id", "revision", F.col("geometry")["cathode.L_um"].alias("thickness"), F.col("geometry")["cathode.porosity"].alias("porosity"), log.alias("log"))


@query("""
WITH t AS (SELECT o_orderkey AS id, ['constraint_check', 'combination_recommendation', 'doping'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS kind, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 <> 0 END AS expected, o_orderkey % 5 <> 0 AS found, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice / 1000, 1) END AS energy,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 1000 * (CAST(1 AS DOUBLE) + (o_orderkey % 7) / CAST(500 AS DOUBLE)) END AS estimate, CASE o_orderkey % 6 WHEN 0 THEN '该方案不可行' WHEN 1 THEN 'it violates C1 at 300 Wh/kg' WHEN 2 THEN 'none' ELSE 'reaches ' || CAST(CAST(floor(o_totalprice / 800) AS BIGINT) AS VARCHAR) || ' Wh/kg, then 5 Wh/kg' END AS answer FROM orders),
u AS (SELECT *, contains(answer, '不可行') OR contains(answer, 'violat') AS bad, CAST(nullif(regexp_extract(answer, '([0-9]+(?:\\.[0-9]+)?)\\s*Wh/kg', 1), '') AS DOUBLE) AS claimed FROM t),
w AS (SELECT *, round(abs(nullif(claimed, 0) - estimate) / nullif(estimate, 0), 3) AS error FROM u)
SELECT id AS o_orderkey, kind, CASE kind WHEN 'constraint_check' THEN found = coalesce(expected, true) WHEN 'combination_recommendation' THEN CASE WHEN NOT coalesce(expected, false) THEN true ELSE coalesce(abs(estimate - coalesce(energy, 0)) / greatest(estimate, CAST(0.000000001 AS DOUBLE)) < CAST(0.01 AS DOUBLE), false) END ELSE true END AS consistent,
  CASE kind WHEN 'constraint_check' THEN ((NOT coalesce(expected, false)) = bad) OR bad WHEN 'combination_recommendation' THEN error <= CAST(0.3 AS DOUBLE) END AS hit, CASE kind WHEN 'constraint_check' THEN (NOT coalesce(expected, false)) = bad WHEN 'combination_recommendation' THEN error <= CAST(0.3 AS DOUBLE) END AS strict FROM w
""")
def e8_rule_and_answer_modes(d: Tables) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = F.get(F.array(F.lit("constraint_check"), F.lit("combination_recommendation"), F.lit("doping")), (k % 3).cast("int"))
    answer = F.when(k % 6 == 0, "该方案不可行").when(k % 6 == 1, "it violates C1 at 300 Wh/kg").when(k % 6 == 2, "none").otherwise(F.concat(F.lit("reaches "), F.floor(price / 800), F.lit(" Wh/kg, then 5 Wh/kg")))
    t = d.orders.select(
        "o_orderkey", kind.alias("kind"), F.when(k % 4 != 3, k % 4 != 0).alias("expected"), (k % 5 != 0).alias("found"), F.when(k % 11 != 0, F.round(price / 1000, 1)).alias("energy"),
        F.when(k % 13 != 0, price / 1000 * (1 + (k % 7) / 500)).alias("estimate"), answer.alias("answer"),
    )
    c = F.col
    hit = rules.answer_hit(c("kind"), c("answer"), c("expected"), c("estimate"))
    return t.select("o_orderkey", "kind", rules.task_consistent(c("kind"), c("expected"), c("found"), c("energy"), c("estimate")).alias("consistent"), hit["hit"].alias("hit"), hit["strict"].alias("strict"))


@query("""
WITH k AS (SELECT doc_id, doc_id % 8 AS v, doc_id % 90 AS n, contains(text, '|') AS piped FROM documents)
SELECT doc_id, CASE WHEN v IN (0, 4) THEN 'LiNi0.' || (10 + n) || 'Mn0.1O2' WHEN v = 1 THEN 'LiCo0.' || (10 + n) || 'Al0.1O2' END AS formula,
  CASE v WHEN 0 THEN 'sol_gel' WHEN 1 THEN 'solid_state' WHEN 2 THEN 'hydroxide_coprecipitation' WHEN 3 THEN 'sol_gel' WHEN 5 THEN 'sol_gel' END AS route,
  CAST(CASE v WHEN 0 THEN 800 + n WHEN 1 THEN 700 + n WHEN 3 THEN 850 END AS DOUBLE) AS celsius_low, CAST(CASE v WHEN 0 THEN 800 + n WHEN 1 THEN 910 WHEN 3 THEN 850 END AS DOUBLE) AS celsius_high,
  CAST(CASE v WHEN 0 THEN 12 WHEN 1 THEN 10 END AS DOUBLE) AS hours_low, CAST(CASE v WHEN 0 THEN 12 WHEN 1 THEN 15 END AS DOUBLE) AS hours_high FROM k
""")
def e24_design_anchors(d: Tables) -> DataFrame:
    """Answers behind the documents' own texts: a ranked table, main and other ways, firing beside drying, in eight forms."""
    v, n = F.col("doc_id") % 8, F.col("doc_id") % 90
    say = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    end = (
        F.when(v == 0, say("| Rank | Formula |\n|---|---|\n| 2 | LiCoO2 |\n| **#1** | LiNi0.", 10 + n, "Mn0.1O2 |\n\n路线B: 固相法, 煅烧 600 °C 5 h; Route A: sol-gel; calcination at ", 800 + n, " °C, 12 h"))
        .when(v == 1, say("| 方案 | 配方 | x |\n| :--- | ---: | -- |\n| 首选 | LiCo0.", 10 + n, "Al0.1O2 | y |\n主推 固相合成。 预烧 500 °C 3 h; 升温速率 5 °C/min; 烧结温度 ", 700 + n, "~910℃ 保温 10-15 小时"))
        .when(v == 2, "不推荐 固相法; 对照 sol-gel; Ni(OH)2 氢氧化物共沉淀; 干燥后 煅烧 120 °C")
        .when(v == 3, "溶胶-凝胶 and 固相法\nsintering 850°C/min; 烧结: 850 ℃")
        .when(v == 4, say("| rank | other | formula |\n|---|---|---|\n| 10 | a | LiCoO2 |\n| 1 | b | LiNi0.", 10 + n, "Mn0.1O2 |\n| 1 | c | LiFeO2 |"))
        .when(v == 5, "备选路线 sol-gel, calcination 700 °C 2 h")
        .when(v == 6, "| x | y |\n|---|---|\n| 1 | LiCoO2 |\ntext")
    )
    docs = d.documents.select("doc_id", F.concat("text", F.lit("\n\n"), F.coalesce(end, F.lit(""))).alias("text"))
    return anchors.anchors(docs)


@query(r"""
WITH t AS (SELECT doc_id, text || chr(10) || 'At ' || doc_id % 60 || ' °C LFP and NCM811 give ' || doc_id || '.5 mAh/g; graphite 3.7V, 12 %x' AS text FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s?(mAh/g|Wh/kg|mg/cm2|S/cm|°C|V|%)(?:[^A-Za-z0-9/]|$)', 0)) AS m FROM t)
SELECT doc_id, CASE u WHEN 'mAh/g' THEN 'capacity' WHEN 'Wh/kg' THEN 'energy' WHEN 'mg/cm2' THEN 'loading' WHEN 'S/cm' THEN 'conductivity' WHEN '°C' THEN 'temperature' WHEN 'V' THEN 'voltage' ELSE 'share' END AS property, u AS unit, count(*) AS n, round(sum(x), 4) AS total
FROM (SELECT doc_id, CAST(regexp_extract(m, '^([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS x, regexp_extract(m, '(mAh/g|Wh/kg|mg/cm2|S/cm|°C|V|%)', 1) AS u FROM m) GROUP BY ALL
""")
def x5_extracted_measures(d: Tables) -> DataFrame:
    k = F.col("doc_id")
    docs = d.documents.select("doc_id", F.concat("text", F.lit("\nAt "), k % 60, F.lit(" °C LFP and NCM811 give "), k, F.lit(".5 mAh/g; graphite 3.7V, 12 %x")).alias("text"))
    return extractor.extracted(docs).filter("error is null").groupBy("doc_id", "property", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
