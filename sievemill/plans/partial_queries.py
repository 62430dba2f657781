"""Queries of table blocks, merged components, formulations, seeds, foils and discharges, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import extraction, facts, metadata, physics, rules, segments
from .registry import Tables, query


@query(r"""
WITH t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Table 1. Old one' || chr(10) || 'TABLE S2 Of runs ' || doc_id || chr(10) WHEN 1 THEN 'a table of x' || chr(10) ELSE '' END AS pre,
  '| run | mAh |' || chr(10) || '|---|:-:|' || chr(10) || '| a | ' || doc_id || ' |' || chr(10) || '| b |' || chr(10) || '| c | 3 | x |' || chr(10) || 'after ' || doc_id AS tab FROM documents WHERE NOT contains(text, '|')),
b AS (SELECT *, substr(pre, greatest(length(pre) - 800, 0) + 1) AS back FROM t),
c AS (SELECT *, coalesce(list_extract(regexp_extract_all(back, '(?i)(?:table|表)\s+(?:S[0-9]+[.\s]|[0-9]+[.\s])[^\n]{0,200}'), -1), list_extract(list_filter(string_split(back, chr(10)), lambda x: contains(lower(x), 'table')), -1), '') AS caption,
  regexp_replace(substr(pre, greatest(length(pre) - 400, 0) + 1), '^\s+|\s+$', '', 'g') AS l, regexp_replace(substr(tab, 1, 400), '^\s+|\s+$', '', 'g') AS r FROM b),
d AS (SELECT *, CASE WHEN l <> '' THEN l || chr(10) ELSE '' END || '[TABLE at pos ' || length(pre) || ']' || chr(10) || r AS near FROM c)
SELECT doc_id, CAST(length(pre) AS BIGINT) AS start, md5('TABLE DATA BLOCK' || chr(10) || CASE WHEN trim(caption) <> '' THEN 'Caption or title: ' || trim(caption) || chr(10) ELSE '' END || 'Nearby text: ' || substr(near, 1, 300) || chr(10) || 'Headers: run; mAh' || chr(10) || 'Rows:' || chr(10)
  || 'Row 1: run = a; mAh = ' || doc_id || chr(10) || 'Row 2: b' || chr(10) || 'Row 3: c; 3; x' || chr(10) || 'Column data:' || chr(10) || '  run: a; b; c' || chr(10) || '  mAh: ' || doc_id || '; 3') AS block_md5 FROM d
""")
def g16_table_blocks(d: Tables) -> DataFrame:
    k = F.col("doc_id")
    before = F.when(k % 3 == 0, F.concat(F.lit("Table 1. Old one\nTABLE S2 Of runs "), k, F.lit("\n"))).when(k % 3 == 1, "a table of x\n").otherwise("")
    table = F.concat(F.lit("| run | mAh |\n|---|:-:|\n| a | "), k, F.lit(" |\n| b |\n| c | 3 | x |\nafter "), k)
    docs = d.documents.filter(~F.contains("text", F.lit("|"))).select("doc_id", F.concat("text", F.lit("\n"), before, table).alias("text"))
    return segments.table_blocks(docs).select("doc_id", F.col("start").cast("long").alias("start"), F.md5("block").alias("block_md5"))


@query("""
WITH RECURSIVE s AS (SELECT l_suppkey AS doi, CASE l_returnflag WHEN 'R' THEN 'A' ELSE l_returnflag END AS condition, l_partkey AS material, l_linestatus AS name, l_quantity AS v, CASE WHEN l_linenumber % 2 = 0 THEN 'anode' ELSE 'cathode' END AS c, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY doi, condition, material, name ORDER BY seq, v, c) AS r FROM s),
f AS (SELECT doi, condition, material, name, r, [{'v': v, 'n': 1, 's': [c]}] AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT doi, condition, material, name, r, CASE WHEN hit > 0 THEN list_transform(kept, lambda k, i: CASE WHEN i = hit THEN {'v': k.v, 'n': k.n + 1, 's': list_append(k.s, c)} ELSE k END) ELSE list_append(kept, {'v': v, 'n': 1, 's': [c]}) END
  FROM (SELECT o.*, f.kept, coalesce(list_position(list_transform(f.kept, lambda k: k.v = o.v OR abs(o.v - k.v) / abs(k.v) < CAST(0.02 AS DOUBLE)), true), 0) AS hit FROM f JOIN o ON o.doi = f.doi AND o.condition = f.condition AND o.material = f.material AND o.name = f.name AND o.r = f.r + 1)),
l AS (SELECT doi, condition, material, name, unnest(kept) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doi, condition, material, name ORDER BY r DESC) AS z FROM f) WHERE z = 1)
SELECT doi, condition, material, name, k.v AS value, CAST(k.n AS INTEGER) AS members, array_to_string(list_sort(list_distinct(k.s)), '+') AS sources FROM l
""")
def a4_merged_components(d: Tables) -> DataFrame:
    rows = d.lineitem.select(
        F.col("l_suppkey").alias("doi"), F.when(F.col("l_linenumber") % 2 == 0, "anode").otherwise("cathode").alias("component"), F.col("l_returnflag").alias("condition_id"), F.col("l_partkey").alias("material"),
        F.col("l_linestatus").alias("name"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    remap = d.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("doi"), F.col("l_returnflag").alias("condition_id"), F.lit("A").alias("canonical_id")).distinct()
    return facts.merged_components(rows, remap)


@query("""
WITH p AS (SELECT p_partkey AS k, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b, upper(p_type) AS t FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 3 = 1 THEN k % 5 || '.5M_' WHEN k % 3 = 2 THEN '' ELSE '' END || CASE WHEN k % 3 = 0 THEN array_to_string(list_sort(['LIFSI', b]), '-') ELSE 'LIFSI' END || '_' || array_to_string(list_sort(list_distinct([a, b])), '-')
  || CASE WHEN k % 4 = 0 THEN '_' || t ELSE '' END || CASE WHEN k % 5 = 0 THEN '_dil-' || CASE WHEN k % 10 = 0 THEN 'TTE' ELSE 'BTFE-TTE' END ELSE '' END END AS formulation FROM p
""")
def n1_formulations_in_parts(d: Tables) -> DataFrame:
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    salt = lambda name, amount: F.struct(name.alias("name"), amount.alias("concentration"))
    salts = F.when(k % 3 == 0, F.array(salt(F.lit("LiFSI"), F.lit("2 M")), salt(words[1], F.lit(None).cast("string")))).when(k % 3 == 1, F.array(salt(F.lit(" LiFSI"), F.concat(k % 5, F.lit(".5 M"))))).otherwise(F.array(salt(F.lit("lifsi"), F.lit("1.0 M"))))
    none = F.lit(None).cast("array<string>")
    made = facts.formulation_of(salts, F.when(k % 7 != 0, F.array(words[0], words[1], words[0])), F.when(k % 4 == 0, F.array(F.lower("p_type"), F.lit(" "))), F.when(k % 10 == 0, F.array(F.lit("TTE"))).when(k % 5 == 0, F.array(F.lit("tte"), F.lit("BTFE"))).otherwise(none))
    return d.part.select("p_partkey", made.alias("formulation"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'quote' END, CASE WHEN event_id % 3 = 0 THEN 'value' END, CASE WHEN event_id % 7 = 0 THEN 'relation' END, CASE WHEN event_id % 4 = 1 OR (event_id % 4 = 2 AND user_id % 2 = 1) THEN 'condition' END) AS problems FROM events
""")
def d6_seed_conditions(d: Tables) -> DataFrame:
    """Quotes, values and conditions that the sentence has in other words, has in part, or lacks."""
    k, user = F.col("event_id"), F.col("user_id")
    sentence = F.concat(F.lit("At rates over 2C and 4.3 V, cell-A of user "), user + 1000, F.lit(" gives 7"), k, F.lit(" mAh/g."))
    quote = F.when(k % 5 == 0, "it gives nothing").otherwise(F.concat(F.lit("RATES over  2C and 4.3V")))
    value = F.when(k % 3 == 0, F.concat(F.lit("8"), k, F.lit("9"))).otherwise(F.concat(F.lit("7"), k))
    conditions = (
        F.when(k % 4 == 0, F.create_map(F.lit("rate"), F.lit("> 2C"), F.lit("layer"), F.lit("any SEI"))).when(k % 4 == 1, F.create_map(F.lit("cutoff"), F.lit(">4.3V"), F.lit("heat"), F.lit("99.25 C")))
        .when((k % 4 == 2) & (user % 2 == 1), F.create_map(F.lit("ratio"), F.lit("4.3 to 99.25"))).when(k % 4 == 2, F.create_map(F.lit("ratio"), F.lit("2 to 4.3")))
    )
    p = extraction.seed_problems(sentence, quote, value, F.when(k % 7 == 0, "odd").otherwise("performance"), ["performance"], conditions)
    return d.events.select("event_id", F.array_join(p, ",").alias("problems"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size / CAST(60 AS DOUBLE) > CAST(0.534 AS DOUBLE) THEN 'compaction' END,
  CASE WHEN p_partkey % 3 <> 0 AND abs(p_retailprice / 500 - p_size * CAST(0.0534 AS DOUBLE)) / (p_size * CAST(0.0534 AS DOUBLE)) > CAST(0.25 AS DOUBLE) THEN 'loading' END) AS violations FROM part
""")
def e14_lithium_foils(d: Tables) -> DataFrame:
    size = F.col("p_size").cast("double")
    v = rules.foil_violations(size / 60, F.when(F.col("p_partkey") % 3 == 0, F.lit(0.1)).otherwise(0.0), size, F.col("p_retailprice") / 500)
    return d.part.select("p_partkey", F.array_join(v, ",").alias("violations"))


@query("""
WITH e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, CASE WHEN event_id % 97 <> 5 THEN CAST(2.2 AS DOUBLE) + value / 100 END AS v FROM events),
s AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, v)),
x AS (SELECT user_id, max(t) AS last, arg_min(CASE WHEN v IS NOT NULL AND v0 IS NOT NULL THEN t0 + (t - t0) * (CAST(2.5 AS DOUBLE) - v0) / (v - v0) ELSE t0 END, n) FILTER (n > 1 AND (v IS NULL OR v < 2.5)) AS t_end, arg_min(CASE WHEN v IS NOT NULL AND v0 IS NOT NULL THEN 'voltage_cutoff' ELSE 'stoichiometry_exhausted' END, n) FILTER (n > 1 AND (v IS NULL OR v < 2.5)) AS how FROM s GROUP BY user_id),
y AS (SELECT user_id, coalesce(t_end, last) AS t_end, coalesce(how, 'curve_end') AS termination FROM x),
z AS (SELECT s.user_id, t_end, termination, avg(v) AS mean_v FROM s JOIN y ON y.user_id = s.user_id WHERE t <= t_end AND v IS NOT NULL AND t_end > 0 GROUP BY ALL)
SELECT user_id, round(t_end, 4) AS t_end, termination, round(mean_v, 6) AS mean_v, round(t_end * 2 / 3600, 6) AS capacity_ah, round(t_end * 2 / 3600 / CAST(0.5 AS DOUBLE) * mean_v * CAST(0.45 AS DOUBLE), 4) AS cell_energy FROM z
""")
def e20_discharges(d: Tables) -> DataFrame:
    volts = F.when(F.col("event_id") % 97 != 5, F.lit(2.2) + F.col("value") / 100)
    curves = d.events.select("user_id", F.col("event_id").alias("t"), volts.alias("v"))
    found = physics.discharges(curves, "user_id", "t", "v", current=2.0, active_kg=0.5)
    digits = {"t_end": 4, "mean_v": 6, "capacity_ah": 6, "cell_energy": 4}
    return found.select("user_id", "termination", *[rounded(F.col(c), n).alias(c) for c, n in digits.items()])


@query(r"""
WITH t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN '; 缺少：“循环' || conv_id || '” 数据。' WHEN 1 THEN chr(10) || 'Needs (more) points; lacks cells; Missing: x; need y' ELSE '' END AS text FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?i)(?:缺少|缺乏|补充|missing|lacks|need)[:：\s]*([^。；;\n]{1,30})', 1), lambda x: trim(regexp_replace(x, '["''“”()（）\[\]]', '', 'g'))), lambda x: x <> '')[1:3], '|') AS queries FROM t
""")
def r17_follow_ups(d: Tables) -> DataFrame:
    k = F.col("turn") % 3
    end = F.when(k == 0, F.concat(F.lit("; 缺少：“循环"), "conv_id", F.lit("” 数据。"))).when(k == 1, "\nNeeds (more) points; lacks cells; Missing: x; need y").otherwise("")
    return d.conversations.select("conv_id", "turn", F.array_join(extraction.follow_up_queries(F.concat("text", end)), "|").alias("queries"))


@query("""
SELECT 'doping_design' AS task_type, CASE WHEN p_partkey % 6 = 0 THEN '材料' ELSE p_name END || '经' || CASE WHEN p_partkey % 4 = 0 THEN 'Al,Zr' ELSE 'Nb' END || '掺杂后，' || p_type || '达到多少？（条件：' || CASE WHEN p_partkey % 3 = 0 THEN '无' ELSE 'T=' || p_size || '、rate=1C' END || '）' AS question, CAST(p_retailprice AS VARCHAR) AS expected, 'mAh/g' AS unit FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 0
UNION ALL SELECT 'parameter_design', p_name || '在' || CASE WHEN p_partkey % 3 = 0 THEN '无额外条件' ELSE 'T=' || p_size || '、rate=1C' END || '下的' || p_type || '是多少？', CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_retailprice AS VARCHAR) END, 'mAh/g' FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 <> 0
""")
def e7_design_questions(d: Tables) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "doping").when(k % 7 != 0, "performance").otherwise("compatibility")
    condition = F.when(k % 3 != 0, F.create_map(F.lit("rate"), F.lit("1C"), F.lit("T"), F.col("p_size").cast("string")))
    rows = d.part.select(
        kind.alias("kind"), F.when((k % 6 == 0), " ").otherwise(F.col("p_name")).alias("host"), F.when(k % 4 == 0, F.array(F.lit("Al"), F.lit("Zr"))).otherwise(F.array(F.lit("Nb"))).alias("dopants"),
        F.col("p_type").alias("property"), F.when(k % 10 != 0, F.col("p_retailprice").cast("string")).alias("value"), F.lit("mAh/g").alias("unit"), condition.alias("condition"),
    )
    return rules.design_questions(rows)


@query("""
WITH p AS (SELECT doc_id, list_concat(['# Introduction', repeat('Introduction ', 9)], string_split(text, chr(10))) AS ps FROM documents),
q AS (SELECT doc_id, ps, coalesce(list_position(list_transform(ps, lambda x: length(x) > 80), true), 0) AS i FROM p)
SELECT doc_id, CAST(CASE WHEN i > 0 THEN len(ps) - i + 1 ELSE len(ps) END AS INTEGER) AS kept, CASE WHEN i > 0 THEN md5(ps[i]) ELSE md5(ps[1]) END AS first_md5 FROM q
""")
def g5_body_start(d: Tables) -> DataFrame:
    parts = F.concat(F.array(F.lit("# Introduction"), F.repeat(F.lit("Introduction "), 9)), F.split("text", "\n"))
    kept = d.documents.select("doc_id", segments.body_start(parts).alias("ps"))
    return kept.select("doc_id", F.size("ps").alias("kept"), F.md5(F.get("ps", F.lit(0))).alias("first_md5"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ', B. Roe and C. Poe' WHEN 1 THEN 'Ann and ' || c_name WHEN 2 THEN 'the first, of ' || c_mktsegment END AS authors FROM customer
""")
def m2_authors(d: Tables) -> DataFrame:
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    lines = (
        F.when(k == 0, F.concat(F.lit("University of X, Y\n\n"), name, F.lit(", B. Roe and C. Poe\nlater, one and more"))).when(k == 1, F.concat(F.lit("a@b.org, mail\nshort, a\n  Ann and "), name, F.lit("  ")))
        .when(k == 2, F.concat(F.lit("http://x.org/a,b and c\nAbstract, and more\nthe first, of "), "c_mktsegment")).when(k == 3, "no names on this line").otherwise(F.repeat(F.lit("a, b and "), 60))
    )
    return d.customer.select("c_custkey", metadata.authors(F.concat(F.lit("head, and x y z\n# A title\n"), lines)).alias("authors"))


@query("""
WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cathode' WHEN 1 THEN 'anode' ELSE 'electrolyte' END AS component, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS phase, o_custkey FROM orders)
SELECT id, component, phase, 'p' AS name, CAST(o_custkey AS VARCHAR) AS value, 'V' AS unit, CAST(NULL AS VARCHAR) AS prop_c_rate FROM r WHERE component <> 'cathode'
UNION ALL SELECT id, component, phase, 'p_' || k, CASE k WHEN 'a' THEN CAST(o_custkey AS VARCHAR) ELSE '2' END, '%', NULL FROM r, (SELECT unnest(['a', 'b']) AS k) WHERE component = 'cathode'
""")
def a25_flattened_components(d: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    base = lambda k: d.orders.filter(key % 3 == k)
    common = [key.alias("id"), F.lit("p").alias("name")]
    cathode = base(0).select(*common, F.concat(F.lit('{"a": '), "o_custkey", F.lit(', "b": 2, "unit": "%"}')).alias("value"), F.lit(None).cast("string").alias("unit"))
    anode = base(1).select(*common, F.col("o_custkey").cast("string").alias("value"), F.lit("V").alias("unit"), F.col("o_orderstatus").alias("phase"))
    electrolyte = base(2).select(*common, F.col("o_custkey").cast("string").alias("value"), F.lit("V").alias("unit"))
    return facts.flattened_components({"cathode": cathode, "anode": anode, "electrolyte": electrolyte}, "name", "value", "unit")
