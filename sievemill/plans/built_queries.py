"""Text functions over values that are put together from the tables' columns, so that SQL has to work the results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import facts, labels, segments
from ..sources import tables
from .registry import Tables, query

_ELEMENTS = ["Li", "Ni", "Co", "Mn", "O", "C", "Fe", "P"]
_SOLVENTS = ["EC", "DMC", "DEC", "EMC", "FEC"]


@query(r"""
WITH s AS (SELECT doc_id, replace(text, ',', '') AS s FROM documents),
g AS (SELECT doc_id, s, regexp_extract(s, '([-+]?[0-9]*\.?[0-9]+)\s*[×x*]\s*10\s*\^\s*\{?([-+]?[0-9]+)\}?', 1) AS base, regexp_extract(s, '([-+]?[0-9]*\.?[0-9]+)\s*[×x*]\s*10\s*\^\s*\{?([-+]?[0-9]+)\}?', 2) AS exponent,
  regexp_extract(s, '[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?') AS plain FROM s)
SELECT doc_id, CASE WHEN base <> '' THEN CAST(base AS DOUBLE) * pow(10, CAST(exponent AS DOUBLE)) WHEN plain <> '' THEN CAST(plain AS DOUBLE) END AS number FROM g
""")
def t13_numbers_in_documents(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", t.number_in(F.col("text")).alias("number"))


@query(r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '\([^)]*\)', '', 'g'), '[:：].*$', '', 'g'), '\s+[-+]?[0-9.]+\s*[A-Za-z%°/]*\s*$', '', 'g'), ' ') AS label FROM l
""")
def t28_labels_of_lines(d: Tables) -> DataFrame:
    return segments.lines(d.documents).select("doc_id", F.col("line_no").cast("long").alias("line_no"), t.short_label(F.col("line")).alias("label"))


@query(r"""
WITH e AS (SELECT p_partkey, k, ['Li', 'Ni', 'Co', 'Mn', 'O', 'C', 'Fe', 'P'][1 + (p_partkey * (k + 3) + p_size * k) % 8] AS el, (p_partkey + k * 7) % 5 AS n FROM part, (SELECT unnest(range(0, 4)) AS k)),
s AS (SELECT p_partkey, el, sum(CASE WHEN n = 0 THEN 1 ELSE n END) AS n FROM e GROUP BY p_partkey, el)
SELECT p_partkey, string_agg(el || n, '' ORDER BY el) AS composition FROM s GROUP BY p_partkey
""")
def t12_formula_sums(d: Tables) -> DataFrame:
    part = lambda k: F.concat(
        F.element_at(F.array(*[F.lit(e) for e in _ELEMENTS]), (1 + (F.col("p_partkey") * (k + 3) + F.col("p_size") * k) % 8).cast("int")),
        F.when((F.col("p_partkey") + k * 7) % 5 == 0, "").otherwise(((F.col("p_partkey") + k * 7) % 5).cast("string")),
    )
    return d.part.select("p_partkey", t.formula_key(F.concat(*[part(k) for k in range(4)])).alias("composition"))


_MIX = """
s AS (SELECT c_custkey, list_transform([c_custkey % 5, (c_custkey // 5) % 5, (c_custkey // 25) % 5], lambda i: ['EC', 'DMC', 'DEC', 'EMC', 'FEC'][CAST(i + 1 AS INTEGER)]) AS solvents,
  CASE c_nationkey % 3 WHEN 0 THEN 'LiPF6' WHEN 1 THEN 'LiFSI' ELSE 'LiTFSI' END AS salt, 1 + c_nationkey % 4 AS m FROM customer)
"""


def _solutions(d: Tables) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in _SOLVENTS]), (F.floor(F.col("c_custkey") / n) % 5 + 1).cast("int"))
    salt = F.when(F.col("c_nationkey") % 3 == 0, "LiPF6").when(F.col("c_nationkey") % 3 == 1, "LiFSI").otherwise("LiTFSI")
    text = F.concat(F.lit(" "), 1 + F.col("c_nationkey") % 4, F.lit(" M "), salt, F.lit(" in "), pick(1), F.lit("/"), pick(5), F.lit(" : "), pick(25))
    return d.customer.select("c_custkey", text.alias("text"), (F.col("c_custkey") % 7).alias("ratio"))


@query(f"""
WITH {_MIX}
SELECT c_custkey, m || 'M ' || lower(salt) || ' in ' || array_to_string(list_sort(list_distinct(solvents)), '/') || '(' || (c_custkey % 7) || ':1)' AS electrolyte FROM s
""")
def t16_solutions(d: Tables) -> DataFrame:
    return _solutions(d).select("c_custkey", t.electrolyte(F.concat("text", F.lit(" ("), "ratio", F.lit(" : 1 Vol%)"))).alias("electrolyte"))


@query(f"""
WITH {_MIX}
SELECT c_custkey, CASE WHEN m <> 1 THEN m || 'M_' ELSE '' END || upper(salt) || '_' || array_to_string(list_sort(list_distinct(solvents)), '-') || CASE WHEN c_custkey % 7 > 2 THEN '_VC' ELSE '' END AS formulation FROM s
""")
def n1_formulation_names(d: Tables) -> DataFrame:
    s = F.regexp_replace("text", " : ", "/")
    return _solutions(d).select("c_custkey", facts.formulation_id(F.when(F.col("ratio") > 2, F.concat(s, F.lit(" + "), "ratio", F.lit("% VC"))).otherwise(s)).alias("formulation"))


@query(r"""
WITH z AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aq', '电池') ELSE replace(text, 'qu', '锂') END AS s FROM documents)
SELECT doc_id, length(s) > 0 AND len(regexp_extract_all(s, '[\x{4e00}-\x{9fff}]')) / greatest(length(s), 1) >= CAST(0.05 AS DOUBLE) AS is_zh FROM z
""")
def t5_f12_zh_share(d: Tables) -> DataFrame:
    s = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aq", "电池")).otherwise(F.replace("text", F.lit("qu"), F.lit("锂")))
    return d.documents.select("doc_id", F.coalesce(t.is_zh(s), F.lit(False)).alias("is_zh"))


@query(r"""
WITH s AS (SELECT conv_id, turn, replace(replace(replace(text, 'er', 'Ni²⁺'), 'an', '<sup>3+</sup>'), 'on', 'O₂^{2-}') AS s FROM conversations)
SELECT conv_id, turn, md5(replace(regexp_replace(regexp_replace(regexp_replace(s, '<sup>[^<]*</sup>', '', 'g'), '\^\{?[0-9]*[+\-]\}?', '', 'g'), '[⁰¹²³⁴⁵⁶⁷⁸⁹]*[⁺⁻]', '', 'g'), '₂', '2')) AS plain_md5 FROM s
""")
def t11_valence_in_texts(d: Tables) -> DataFrame:
    s = F.replace(F.replace(F.replace("text", F.lit("er"), F.lit("Ni²⁺")), F.lit("an"), F.lit("<sup>3+</sup>")), F.lit("on"), F.lit("O₂^{2-}"))
    return d.conversations.select("conv_id", "turn", F.md5(t.without_valence(s)).alias("plain_md5"))


@query("""
SELECT conv_id, count(*) AS n_chapters, min_by('Turn ' || turn || ' of ' || role, turn) AS first_title, max_by('Turn ' || turn || ' of ' || role, turn) AS last_title FROM conversations GROUP BY conv_id
""")
def g13_chapters_of_conversations(d: Tables) -> DataFrame:
    section = F.concat(F.lit("## Turn "), "turn", F.lit(" of "), "role", F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#\n]", " "))
    whole = d.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    cut = whole.select("conv_id", segments.chapters(F.col("text")).alias("c"))
    return cut.select("conv_id", F.size("c").cast("long").alias("n_chapters"), F.get("c", F.lit(0))["title"].alias("first_title"), F.element_at("c", -1)["title"].alias("last_title"))


@query("SELECT s_nationkey AS page_id, s_name AS name, CAST(s_suppkey AS VARCHAR) AS number FROM supplier")
def s9_html_table_rows(d: Tables) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td> "), "s_suppkey", F.lit("</td></tr>"))
    html = F.concat(F.lit("<p>x</p><table><thead><tr><th>name</th><th>number</th></tr></thead>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    pages = d.supplier.groupBy(F.col("s_nationkey").alias("page_id")).agg(html.alias("html"))
    return tables.html_rows(pages, "page_id", "html").select("page_id", F.col("cells")["name"].alias("name"), F.col("cells")["number"].alias("number"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(len(list_distinct(list_concat(x, y))) AS BIGINT) AS n FROM p
""")
def u6_union_of_queries(d: Tables) -> DataFrame:
    w = d.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("ws"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("y"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_union("ws", "y")).cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 200")
def o6_o7_constraints_first(d: Tables) -> DataFrame:
    """The first tasks to run, those with a constraint before all others: a limit is the feature."""
    return d.orders.orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority")


@query("""
WITH q AS (SELECT conv_id, turn, trim(CASE turn % 5 WHEN 0 THEN 'NCM ' || text || ' 硅' WHEN 1 THEN text || ' 石墨 vs 硬碳' WHEN 2 THEN '哪种溶剂 ' || text WHEN 3 THEN ' ' ELSE text END, ' ') AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN q = '' THEN NULL WHEN contains(q, 'vs') OR contains(q, '哪种') THEN 'screening' ELSE 'numeric' END AS kind,
  CASE WHEN contains(q, 'NCM') THEN 'cathode' WHEN contains(q, '石墨') OR contains(q, '硅') THEN 'anode' WHEN contains(q, '溶剂') THEN 'electrolyte' END AS component,
  CASE WHEN q = '' THEN 0 ELSE 1 END AS n_queries, CASE WHEN q = '' THEN '' ELSE '目标与路线|推荐材料组合|预期指标|可行性依据|风险评估' END AS outline FROM q WHERE q IS NOT NULL
""")
def x6_plans(d: Tables) -> DataFrame:
    k = F.col("turn") % 5
    q = F.when(k == 0, F.concat(F.lit("NCM "), "text", F.lit(" 硅"))).when(k == 1, F.concat("text", F.lit(" 石墨 vs 硬碳"))).when(k == 2, F.concat(F.lit("哪种溶剂 "), "text")).when(k == 3, " ").otherwise(F.col("text"))
    plans = d.conversations.select("conv_id", "turn", labels.planned(q).alias("p")).filter("p is not null")
    return plans.select("conv_id", "turn", "p.kind", "p.component", F.size("p.queries").alias("n_queries"), F.array_join("p.outline", "|").alias("outline"))
