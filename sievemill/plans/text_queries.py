"""Queries of the text functions, predicates, segmentation, labels and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from ..functions import vocab
from ..operators import labels, metadata, segments
from .registry import Tables, query


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


TOKEN_SQL = t.TOKEN.replace("'", "''")


@query(f"""
WITH k AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN_SQL}'), lambda x: CASE WHEN regexp_matches(x, '^[\\x00-\\x7F]+$') THEN lower(x) ELSE x END) AS ts FROM documents)
SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct, md5(array_to_string(ts, ' ')) AS token_md5 FROM k
""")
def t2_tokens(d: Tables) -> DataFrame:
    ts = d.documents.select("doc_id", t.tokens(F.col("text")).alias("ts"))
    return ts.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"), F.md5(F.array_join("ts", " ")).alias("token_md5"))


@query("""
WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'C:' || chr(92) || 'x' || chr(92) || 'database' || chr(92) || page_id || '.md' ELSE '/home/papers/a/' || page_id || '.md' END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'database/' || page_id || '.md' ELSE 'papers/a/' || page_id || '.md' END AS source FROM s
""")
def t1_source_path(d: Tables) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\x\\database\\"), F.col("page_id"), F.lit(".md"))).otherwise(F.concat(F.lit("/home/papers/a/"), F.col("page_id"), F.lit(".md")))
    return d.pages.select("page_id", t.source_path(path).alias("source"))


@query(r"""
WITH s AS (SELECT p_partkey, '$' || chr(92) || 'mathrm{' || p_brand || '}$ _{' || p_size || '}' || chr(92) || 'alpha x' AS s FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\$', '', 'g'), '\\(?:mathrm|text|mathbf|mathit|rm)\{([^}]*)\}', '\1', 'g'), '\\[a-zA-Z]+', '', 'g'), '[_{}|^]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM s
""")
def t3_latex(d: Tables) -> DataFrame:
    s = F.concat(F.lit("$\\mathrm{"), "p_brand", F.lit("}$ _{"), F.col("p_size"), F.lit("}\\alpha x"))
    return d.part.select("p_partkey", t.plain_latex(s).alias("plain"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, CAST(floor(length(text) * CAST(0.3 AS DOUBLE)) AS INTEGER)) ELSE 0 END AS est_tokens, false AS is_zh FROM documents
""")
def t4_t5_token_estimate(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", t.estimated_tokens(F.col("text")).alias("est_tokens"), t.is_zh(F.col("text")).alias("is_zh"))


@query(r"""
WITH s AS (SELECT page_id, url, 'see ' || url || ' (a) then a b c word' AS s FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(s, 'https?://[^\s]+', '', 'g'), '(?i)(?:^|\s)(?:[a-z]\.?\s){2,}', ' ', 'g') AS s FROM s)
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '(?i)^\([a-z]\)[.,]?$')), ' ') AS cleaned FROM c
""")
def t6_links(d: Tables) -> DataFrame:
    s = F.concat(F.lit("see "), "url", F.lit(" (a) then a b c word"))
    return d.pages.select("page_id", t.without_links(s).alias("cleaned"))


@query(r"""
SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^A-Za-z0-9_\s:/.\-,#%]', ' ', 'g'), '([0-9])\s*\.\s*([0-9])', '\1.\2', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM pages
""")
def t7_paragraph(d: Tables) -> DataFrame:
    return d.pages.select("page_id", F.length(t.clean_paragraph(F.col("html"))).cast("long").alias("n_chars"))


@query(r"""
SELECT p_partkey, lower(regexp_replace(p_name || ' / ' || p_type, '[\s\-_/.,]', '', 'g')) AS k, lower(regexp_replace(p_name || ' / ' || p_type, '[\s!-/:-@\[-`{-~]', '', 'g')) AS bare FROM part
""")
def t8_t9_keys(d: Tables) -> DataFrame:
    s = F.concat("p_name", F.lit(" / "), "p_type")
    return d.part.select("p_partkey", t.key(s).alias("k"), t.bare(s).alias("bare"))


@query(r"""
WITH s AS (SELECT o_orderkey, '10.' || (1000 + o_orderkey % 9000) || '/s' || o_custkey || '-x.' AS doi FROM orders),
n AS (SELECT o_orderkey, replace(regexp_replace(doi, '[.,;:)\]}>]+$', ''), '/', '_') AS name FROM s)
SELECT o_orderkey, name, replace(name, '_', '/') AS doi FROM n
""")
def t10_doi(d: Tables) -> DataFrame:
    doi = F.concat(F.lit("10."), 1000 + F.col("o_orderkey") % 9000, F.lit("/s"), F.col("o_custkey"), F.lit("-x."))
    return d.orders.select("o_orderkey", t.doi_name(doi).alias("name")).withColumn("doi", t.name_doi(F.concat("name", F.lit(".md"))))


@query(r"""
SELECT p_partkey, 'Ni and Mn and Co in H2O ' || p_size AS plain FROM part
""")
def t11_valence(d: Tables) -> DataFrame:
    return d.part.select("p_partkey", t.without_valence(F.concat(F.lit("Ni²⁺ and Mn^4+ and Co<sup>3+</sup> in H₂O "), F.col("p_size"))).alias("plain"))


@query(r"""
WITH s AS (SELECT p_partkey, p_size % 10 AS a, p_size % 7 + 2 AS b FROM part)
SELECT p_partkey, 'Co0.1Li1Ni' || CASE WHEN a = 0 THEN '0' ELSE '0.' || a END || 'O' || (b + 1) AS composition, CAST(b + 1 AS DOUBLE) AS oxygen FROM s
""")
def t12_formula(d: Tables) -> DataFrame:
    a, b = F.col("p_size") % 10, F.col("p_size") % 7 + 2
    formula = F.concat(F.lit("LiNi0."), a, F.lit("Co0.1O"), b, F.lit("O"))
    return d.part.select("p_partkey", t.formula_key(formula).alias("composition"), t.formula_counts(formula)["O"].alias("oxygen"))


@query(r"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 100 WHEN 1 THEN 1000.0 WHEN 2 THEN l_quantity ELSE 1.5 END AS number
FROM lineitem
""")
def t13_t14_numbers(d: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    s = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("about "), q, F.lit(" × 10^{2} S/cm")))
        .when(F.col("l_linenumber") % 4 == 1, F.lit("10^{3} cycles"))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(q, F.lit(".0 mAh")))
        .otherwise(F.lit("1,5.0".replace(",", "")[:0] + "+1.5e0 V"))
    )
    return d.lineitem.select("l_orderkey", "l_linenumber", t.number_in(s).alias("number"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 100 END AS number FROM lineitem
""")
def t15_loose_numbers(d: Tables) -> DataFrame:
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("l_discount") * 100, F.lit("%")))
    return d.lineitem.select("l_orderkey", "l_linenumber", t.loose_number(shown).alias("number"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1M lipf6 in DMC/EC(1:1)' WHEN 1 THEN '1.15M litfsi in DME/DOL' ELSE '1m salt of customer ' || c_custkey END AS electrolyte FROM customer
""")
def t16_electrolyte(d: Tables) -> DataFrame:
    s = F.when(F.col("c_custkey") % 3 == 0, "1 M LiPF6 in EC:DMC (1:1 vol%)").when(F.col("c_custkey") % 3 == 1, "1.15M LiTFSI in DOL, DME").otherwise(F.concat(F.lit("1 M  Salt of customer "), F.col("c_custkey")))
    return d.customer.select("c_custkey", t.electrolyte(s).alias("electrolyte"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'half-cell' WHEN 1 THEN 'full-cell' WHEN 2 THEN 'half-cell' ELSE 'Li||Cu' END AS config FROM customer
""")
def t17_electrode_config(d: Tables) -> DataFrame:
    s = F.when(F.col("c_custkey") % 4 == 0, " Half Cell ").when(F.col("c_custkey") % 4 == 1, "pouch full cell").when(F.col("c_custkey") % 4 == 2, "Li half-cell").otherwise("Li||Cu")
    return d.customer.select("c_custkey", t.electrode_config(s).alias("config"))


@query("""
SELECT event_id, json_extract_string(props, '$.page') AS page, user_id % 2 = 0 AS even_user FROM events
""")
def t18_t19_condition_keys(d: Tables) -> DataFrame:
    names = {"page": "page_no"}
    parsed = F.from_json("props", "map<string,string>")
    renamed = F.transform_keys(parsed, lambda k, v: F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in names.items()], k))
    kept = F.map_filter(renamed, lambda k, v: v.isNotNull() & (v != ""))
    return d.events.select("event_id", kept["page_no"].alias("page"), (F.col("user_id") % 2 == 0).alias("even_user"))


@query("""
SELECT conv_id, turn, text AS answer, '{"turn":' || turn || '}' AS payload FROM conversations
""")
def t20_t21_answers(d: Tables) -> DataFrame:
    s = F.concat(F.lit("<think>plan\nmore</think>"), "text")
    chat = F.concat(F.lit("Sure: ```json\n{\"turn\":"), F.col("turn"), F.lit("}\n``` done"))
    return d.conversations.select("conv_id", "turn", F.when(F.trim("text") == t.without_thinking(s), F.col("text")).alias("answer"), t.json_in(chat).alias("payload"))


@query("""
SELECT page_id, substr(html, 1, 120) AS preview, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' (DOI: 10.1234/' || page_id || ')' AS display FROM pages
""")
def t23_preview(d: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return d.pages.select("page_id", F.substring("html", 1, 120).alias("preview"), t.source_display(title, F.concat(F.lit("10.1234/"), F.col("page_id"))).alias("display"))


@query("""
SELECT page_id, CAST(page_id AS INTEGER) AS first, CAST(page_id + 39 AS INTEGER) AS last FROM pages
""")
def t24_page_range(d: Tables) -> DataFrame:
    name = F.format_string("book_p%04d-%04d.md", F.col("page_id"), F.col("page_id") + 39)
    return d.pages.select("page_id", t.page_range(name).alias("r")).select("page_id", "r.first", "r.last")


@query("""
SELECT p_partkey, p_name || ' of' AS label FROM part
""")
def t28_short_label(d: Tables) -> DataFrame:
    return d.part.select("p_partkey", t.short_label(F.concat("p_name", F.lit(" of (x) 12.5 mAh"))).alias("label"))


_LINES = "SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@query(f"""
WITH l AS ({_LINES}), s AS (SELECT doc_id, line_no, trim(line, ' ') AS s FROM l)
SELECT doc_id, line_no, CASE
  WHEN starts_with(s, '<!--') AND ends_with(s, '-->') THEN 'comment'
  WHEN {_sql_any('lower(s)', vocab.NOISE + vocab.NOISE_IN_EXTRACTS)} THEN 'keyword'
  WHEN regexp_matches(s, '^\\(?[a-zA-Z][0-9]?\\)?$') THEN 'letter'
  WHEN regexp_matches(lower(s), '^(?:fig\\.?|figure|tab\\.?|table|scheme)\\s*') THEN 'caption'
  WHEN regexp_matches(s, '^!\\[.*\\]\\(.*\\)$') THEN 'image'
  WHEN regexp_matches(s, '^[\\s|:-]+$') THEN 'rule'
  WHEN regexp_matches(s, '^https?://') THEN 'url'
  WHEN regexp_matches(lower(s), '^(?:received|revised|accepted|published)\\s*:') THEN 'date'
  WHEN regexp_matches(s, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$') THEN 'mail'
  WHEN regexp_matches(s, '^(?:\\[[0-9]+\\]|\\([0-9]+\\)|[0-9]+\\.|[0-9]+\\))\\s') AND (regexp_matches(s, '20[0-9]{{2}}') OR {_sql_any('s', vocab.JOURNALS)}) THEN 'reference'
  WHEN {' OR '.join(f"starts_with(lower(s), '{c}')" for c in vocab.CHART_STARTS)} THEN 'chart'
  END AS rule FROM s
""")
def f1_noise_lines(d: Tables) -> DataFrame:
    lines = segments.lines(d.documents)
    return lines.select("doc_id", "line_no", p.noise_rule(F.col("line")).alias("rule"))


@query(f"""
WITH l AS ({_LINES})
SELECT doc_id, count(*) FILTER (regexp_matches(lower(trim(line, ' ')), '^(?:fig\\.?|figure|tab\\.?|table|scheme)\\s*[s]?[0-9]+')) AS captions,
       count(*) FILTER (length(line) <= 80 AND {_sql_any('lower(line)', ['university', 'institute', 'department', 'laboratory', 'college', 'school of'])}) AS addresses,
       count(*) FILTER (len(regexp_extract_all(line, '\\|')) >= 3) AS tables,
       count(*) FILTER (regexp_matches(line, '^[0-9]+\\.\\s+[A-Z]|^\\[[0-9]+\\]\\s')) AS refs
FROM l GROUP BY doc_id
""")
def f3_f7_line_kinds(d: Tables) -> DataFrame:
    line, n = F.col("line"), lambda c, name: F.count_if(c).alias(name)
    return segments.lines(d.documents).groupBy("doc_id").agg(n(p.is_caption(line), "captions"), n(p.is_address(line), "addresses"), n(p.is_table_line(line), "tables"), n(p.is_reference_text(line), "refs"))


@query("""
SELECT count(*) AS n, count(*) FILTER (json_extract_string(props, '$.page') IS NOT NULL) AS with_page, count(*) FILTER (value <> 0) AS with_value FROM events
""")
def f8_has_value(d: Tables) -> DataFrame:
    core = F.to_json(F.create_map(F.lit("value"), F.get_json_object("props", "$.page")))
    return d.events.agg(F.count("*").alias("n"), F.count_if(p.has_core_value(core)).alias("with_page"), F.count_if(~p.is_absent(F.col("value"))).alias("with_value"))


@query(r"""
SELECT doc_id, regexp_matches(text, '(?i)[0-9]+(?:\.[0-9]+)?\s*(?:mAh/g|mAh g|Wh/kg|Wh kg|%)') AND NOT regexp_matches(text, '(?i)[0-9]+(?:\.[0-9]+)?\s*C\b|°C|[0-9]+(?:\.[0-9]+)?\s*V\b|cycle|rate') AS unbound,
       regexp_matches(text, '[0-9]\s*[mnckKA°VCΩSgW%]') AS with_unit, length(text) < 50 AS short, length(text) BETWEEN 30 AND 600 AND NOT regexp_matches(text, 'Figure|Table|Fig\.') AND NOT regexp_matches(text, '^[0-9]') AS seed
FROM documents
""")
def f9_f15_claims(d: Tables) -> DataFrame:
    text = F.col("text")
    return d.documents.select("doc_id", p.claim_without_condition(text).alias("unbound"), p.has_number_with_unit(text).alias("with_unit"), (F.length(text) < 50).alias("short"), p.is_seed_sentence(text).alias("seed"))


@query(r"""
SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9])is(?:[^a-z0-9]|$)') AS has_is, contains(lower(text), 'license') AS has_license FROM documents
""")
def f11_words(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", p.has_word(F.col("text"), "is").alias("has_is"), p.has_word(F.col("text"), "License").alias("has_license"))


@query("""
SELECT count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) IS NOT NULL AS summed, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 200000
""")
def f16_outliers(d: Tables) -> DataFrame:
    return d.orders.filter((F.col("o_totalprice") > 0) & (F.col("o_totalprice") <= 200000)).agg(F.count("*").alias("n"), F.sum("o_totalprice").isNotNull().alias("summed"), F.max("o_totalprice").alias("top"))


@query(f"""
WITH l AS ({_LINES}), s AS (
  SELECT doc_id, line_no, line, CASE WHEN contains(lower(line), 'license') THEN 'license' WHEN contains(lower(line), ' the ') THEN 'english' END AS kind FROM l WHERE length(line) BETWEEN 30 AND 600)
SELECT kind, doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, line_no) AS r FROM s WHERE kind IS NOT NULL) WHERE r <= 50
""")
def f18_first_per_type(d: Tables) -> DataFrame:
    line = F.col("line")
    kind = F.when(F.contains(F.lower(line), F.lit("license")), "license").when(F.contains(F.lower(line), F.lit(" the ")), "english")
    typed = segments.lines(d.documents).filter(F.length("line").between(30, 600)).withColumn("kind", kind).filter("kind is not null")
    return labels.first_of_each(typed, "kind", ["doc_id", "line_no"], 50).select("kind", "doc_id", "line_no")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS ss FROM documents),
k AS (SELECT doc_id, len(ss) AS n, len(list_filter(ss, lambda x: contains(lower(x), ' with '))) AS hits FROM s)
SELECT doc_id, CASE WHEN hits > 0 AND hits < n THEN hits ELSE 0 END AS kept FROM k
""")
def f19_clauses(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.size(segments.clauses_with(F.col("text"), " with ")).cast("long").alias("kept"))


@query(f"""
WITH l AS ({_LINES}), f AS (SELECT *, trim(line, ' ') AS s FROM l WHERE trim(line, ' ') <> ''),
k AS (SELECT doc_id, line_no, s, lag(s) OVER w AS prev FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, CASE WHEN prev IS NULL THEN 1 WHEN regexp_matches(s, '^(?:<table|\\(Continued\\))') THEN 1
   WHEN regexp_matches(s, '^[0-9]+\\.\\s+[A-Z]|^\\[[0-9]+\\]\\s') THEN 1
   WHEN NOT regexp_matches(prev, '[.!?。！？]$') OR regexp_matches(s, '^[-*•]\\s|^[0-9]+[.)]\\s|^\\p{{Ll}}') THEN 0 ELSE 1 END AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS para FROM b)
SELECT doc_id, CAST(para AS BIGINT) AS para, md5(string_agg(s, ' ' ORDER BY line_no)) AS text_md5 FROM g GROUP BY doc_id, para
""")
def g7_stitched_paragraphs(d: Tables) -> DataFrame:
    out = segments.stitched(d.documents.select("doc_id", F.split("text", "\n").alias("parts")), "parts", min_length=1)
    return out.select("doc_id", F.posexplode("paragraphs").alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("para"), F.md5("text").alias("text_md5"))


@query("""
WITH w AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT doc_id, text, n, unnest(range(0, greatest(1, CAST(ceil((n - 300) / CAST(2700 AS DOUBLE)) AS BIGINT)))) AS k FROM w)
SELECT doc_id, k AS chunk, md5(substr(text, CAST(k * 2700 + 1 AS BIGINT), 3000)) AS chunk_md5 FROM s
""")
def g12_windows(d: Tables) -> DataFrame:
    chunks = segments.fixed_windows(F.col("text"), 3000, 300)
    return d.documents.select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("c").alias("chunk_md5"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(ss, lambda x: length(x))) AS BIGINT) AS longest FROM s
""")
def g14_sentences(d: Tables) -> DataFrame:
    s = d.documents.select("doc_id", segments.sentences(F.col("text")).alias("ss"))
    return s.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.array_max(F.transform("ss", F.length)).cast("long").alias("longest"))


#: Places of the parts that begin a chunk, of a list ps of parts: {fits} and {joined} are of a (the chunk so far) and x (the part).
_STARTS = """list_reduce(list_transform(ps, lambda p: {{'zh': len(regexp_extract_all(p, '[\u4e00-\u9fff]')), 'n': length(p), 'i': CAST(1 AS BIGINT), 'starts': [CAST(1 AS BIGINT)]}}),
  lambda a, x: CASE WHEN {fits} THEN {{'zh': a.zh + x.zh, 'n': a.n + x.n + {between}, 'i': a.i + 1, 'starts': a.starts}} ELSE {{'zh': x.zh, 'n': x.n, 'i': a.i + 1, 'starts': list_append(a.starts, a.i + 1)}} END).starts"""
_CUT = "SELECT *, unnest(range(1, len(st) + 1)) AS k FROM s"


def _estimate(zh: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN greatest(1, CAST(floor({zh} * CAST(0.6 AS DOUBLE) + ({n} - {zh}) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 0 END"


@query(f"""
WITH p AS (SELECT doc_id, list_filter(string_split(replace(text, '. ', '.' || chr(1)), chr(1)), lambda x: x <> '') AS ps FROM documents WHERE text <> ''),
s AS (SELECT doc_id, ps, {_STARTS.format(fits="a.n + x.n + 1 <= 2000", between=1)} AS st FROM p WHERE len(ps) > 0), c AS ({_CUT})
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk, array_to_string(ps[st[k] : coalesce(st[k + 1] - 1, len(ps))], ' ') AS text FROM c
""")
def g10_packed_chunks(d: Tables) -> DataFrame:
    chunks = segments.packed(F.split(F.col("text"), r"(?<=\.) "), 2000, " ")
    return d.documents.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query(f"""
WITH e AS (SELECT doc_id, text, {_estimate("len(regexp_extract_all(text, '[\u4e00-\u9fff]'))", "length(text)")} AS est FROM documents),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([。.．])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps FROM e WHERE est > 800),
s AS (SELECT doc_id, ps, {_STARTS.format(fits=f"{_estimate('a.zh', 'a.n')} + {_estimate('x.zh', 'x.n')} <= 500", between=0)} AS st FROM p), c AS ({_CUT})
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk, array_to_string(ps[st[k] : coalesce(st[k + 1] - 1, len(ps))], '') AS text FROM c
UNION ALL SELECT doc_id, 0, text FROM e WHERE est <= 800
""")
def g9_token_chunks(d: Tables) -> DataFrame:
    chunks = segments.token_chunks(F.col("text"), 800, 500)
    return d.documents.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query(f"""
WITH t AS (SELECT doc_id, regexp_replace(replace(text, chr(12288), ' '), '(?m)^#+\\s*', '', 'g') AS x FROM documents),
b AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(x, '\\n\\s*\\n'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> '')) AS y, generate_subscripts(list_filter(list_transform(regexp_split_to_array(x, '\\n\\s*\\n'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> ''), 1) AS i FROM t),
p AS (SELECT doc_id, i, list_filter(string_split(regexp_replace(y, '([.！？;])', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') AS ps FROM b WHERE length(y) > 300),
s AS (SELECT doc_id, i, ps, {_STARTS.format(fits="a.n + x.n <= 300", between=0)} AS st FROM p), c AS ({_CUT}),
a AS (SELECT doc_id, i, k, trim(array_to_string(ps[st[k] : coalesce(st[k + 1] - 1, len(ps))], '')) AS text FROM c UNION ALL SELECT doc_id, i, 1, y FROM b WHERE length(y) <= 300)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS passage, text FROM a WHERE length(text) >= 20
""")
def g11_passages(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.posexplode(segments.passages(F.col("text"))).alias("passage", "text"))


@query(f"""
WITH l AS ({_LINES}), s AS (SELECT *, CASE WHEN contains(lower(line), 'license') THEN 'skip' WHEN regexp_matches(line, '^[A-Z][a-z]+ the ') THEN 'keep' END AS mark FROM l),
r AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS state FROM s)
SELECT doc_id, count(*) AS kept, min(line_no) AS first_kept FROM r WHERE state = 'keep' GROUP BY doc_id
""")
def g1_w6_section_states(d: Tables) -> DataFrame:
    line = F.col("line")
    mark = F.when(F.contains(F.lower(line), F.lit("license")), "skip").when(line.rlike("^[A-Z][a-z]+ the "), "keep")
    return segments.running_state(segments.lines(d.documents), mark).filter("state = 'keep'").groupBy("doc_id").agg(F.count("*").alias("kept"), F.min("line_no").cast("long").alias("first_kept"))


@query(f"""
SELECT doc_id, {"CASE " + " ".join(f"WHEN {_sql_any('lower(text)', ws)} THEN '{k}'" for k, ws in vocab.BATTERY_KINDS) + " WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:lithium|li)(?:[^a-z0-9_]|$)') THEN 'Li-ion/Li-metal' END"} AS kind,
       {_sql_any('lower(text)', vocab.REVIEW)} AS is_review, {_sql_any('lower(text)', vocab.RECYCLING)} AS is_recycling FROM documents
""")
def l1_l2_battery_kind(d: Tables) -> DataFrame:
    text = F.col("text")
    return d.documents.select("doc_id", labels.battery_kind(text).alias("kind"), p.contains_any(F.lower(text), vocab.REVIEW).alias("is_review"), p.contains_any(F.lower(text), vocab.RECYCLING).alias("is_recycling"))


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', " + _sql_list(ws) + ")" for i, (name, ws) in enumerate(vocab.PARAGRAPH_LABELS))}) t(o, label, ws)),
s AS (SELECT doc_id, label, o, len(list_filter(ws, lambda w: contains(lower(text), w))) AS n FROM documents, k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN label ELSE '概述' END AS label, CAST(n AS INTEGER) AS score FROM r WHERE r = 1
""")
def l5_paragraph_labels(d: Tables) -> DataFrame:
    return labels.with_label(d.documents.select("doc_id", "text"), vocab.PARAGRAPH_LABELS, vocab.DEFAULT_LABEL).select("doc_id", "label", F.col("score").cast("int").alias("score"))


_MARKERS = [("english", [" the ", " and ", " of "]), ("french", [" les ", " des ", " est "]), ("german", [" der ", " und ", " ist "]), ("spanish", [" los ", " el ", " para "])]


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', " + _sql_list(ws) + ")" for i, (name, ws) in enumerate(_MARKERS))}) t(o, label, ws)),
s AS (SELECT doc_id, lang, label, o, len(list_filter(ws, lambda w: contains(lower(text), w))) AS n FROM documents, k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM s)
SELECT lang, CASE WHEN n > 0 THEN label ELSE 'none' END AS label, count(*) AS n FROM r WHERE r = 1 GROUP BY ALL
""")
def l3_l8_argmax(d: Tables) -> DataFrame:
    return labels.with_label(d.documents.select("lang", "text"), _MARKERS, "none").groupBy("lang", "label").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT doc_id, 3 * CAST(contains(lower(text), ' the ') AS INTEGER) + 2 * CAST(contains(lower(text), 'license') AS INTEGER) + CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS total, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 50 THEN 'skip' WHEN total >= 5 THEN 'extract' WHEN total >= 3 THEN 'include' ELSE 'skip' END AS decision, round(least(CAST(1 AS DOUBLE), total / CAST(6 AS DOUBLE)), 6) AS confidence FROM s
""")
def l6_screening(d: Tables) -> DataFrame:
    text = F.lower("text")
    weights = [(3, F.contains(text, F.lit(" the "))), (2, F.contains(text, F.lit("license"))), (1, F.col("text").rlike("[0-9]"))]
    decision, confidence = labels.screened(weights, F.length("text"), extract=5, include=3, scale=6.0)
    return d.documents.select("doc_id", decision.alias("decision"), F.round(confidence, 6).alias("confidence"))


@query("""
WITH s AS (SELECT conv_id, turn, (length(text) - length(replace(lower(text), 'the', ''))) / 3 AS a, (length(text) - length(replace(lower(text), 'ing', ''))) / 3 AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a + b = 0 THEN CAST(0.7 AS DOUBLE) ELSE round(greatest(CAST(0.1 AS DOUBLE), least(CAST(1 AS DOUBLE), a / (a + b))), 2) END AS w_theory FROM s
""")
def l10_source_weights(d: Tables) -> DataFrame:
    text = F.lower("text")
    a, b = F.regexp_count(text, F.lit("the")), F.regexp_count(text, F.lit("ing"))
    return d.conversations.select("conv_id", "turn", labels.source_weight(a, b, 0.7).alias("w_theory"))


@query("""
SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, regexp_extract(html, '(?:^|[^0-9])(20[0-9][0-9])(?:[^0-9]|$)', 1) AS year, regexp_matches(html, '10\\.[0-9]{4,}/') AS has_doi FROM pages
""")
def m1_m4_metadata(d: Tables) -> DataFrame:
    lines = F.concat(F.lit("noise\n# "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("\nA, B and C\n"))
    html = F.col("html")
    return d.pages.select("page_id", metadata.title(lines).alias("title"), F.coalesce(metadata.year(html), F.lit("")).alias("year"), metadata.doi(html).isNotNull().alias("has_doi"))


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'cust:' || o_custkey WHEN 1 THEN 'name:Customer' || o_custkey ELSE 'none' END AS k1, 'cust:' || (o_custkey + 1) AS k2, o_custkey FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN a.c_custkey END, b.c_custkey) AS found
FROM s LEFT JOIN customer a ON a.c_custkey = s.o_custkey LEFT JOIN customer b ON b.c_custkey = s.o_custkey + 1
""")
def m5_lookup_by_keys(d: Tables) -> DataFrame:
    rows = d.orders.select("o_orderkey", F.array(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("cust:"), F.col("o_custkey"))).otherwise(F.concat(F.lit("none:"), F.col("o_custkey"))),
        F.concat(F.lit("cust:"), F.col("o_custkey") + 1)).alias("keys"))
    index = d.customer.select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("found"))
    return metadata.first_match(rows, "keys", index, "o_orderkey", "found")


@query("""
WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 1 THEN substr(text, 1, 20) END AS title FROM documents)
SELECT doc_id, coalesce(title, arg_min(title, CASE WHEN title IS NOT NULL THEN doc_id END) OVER (PARTITION BY source)) AS title FROM s
""")
def m6_backfill(d: Tables) -> DataFrame:
    s = d.documents.select("doc_id", "source", F.when(F.col("doc_id") % 4 == 1, F.substring("text", 1, 20)).alias("title"))
    return metadata.backfilled(s, "source", "title", "doc_id").select("doc_id", "title")


@query("""
SELECT count(*) AS n, count(*) FILTER (lang IS NOT NULL) AS with_lang, count(*) FILTER (contains(text, 'License')) AS with_license, count(DISTINCT source) AS sources FROM documents
""")
def m8_a17_coverage(d: Tables) -> DataFrame:
    return d.documents.agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count_if(F.contains("text", F.lit("License"))).alias("with_license"), F.countDistinct("source").alias("sources"))


@query(f"""
WITH l AS ({_LINES}), s AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l)
SELECT doc_id, line_no, CASE WHEN s = '' THEN 'blank' {" ".join(f"WHEN regexp_matches(s, '{pattern}')" + (f" AND length(s) < {most}" if most else "") + f" THEN '{name}'" for name, most, pattern in p.PARAGRAPH_LADDER)} END AS rule FROM s
""")
def f2_paragraph_ladder(d: Tables) -> DataFrame:
    return segments.lines(d.documents).select("doc_id", "line_no", p.paragraph_rule(F.col("line")).alias("rule"))


@query("""
SELECT page_id, 2 AS n_chapters, 'One' AS first_title FROM pages
""")
def g13_chapters(d: Tables) -> DataFrame:
    text = F.concat(F.lit("# One\nx\n## Two\ny"), F.col("page_id"))
    return d.pages.select("page_id", F.size(segments.chapters(text)).alias("n_chapters"), segments.chapters(text)[0]["title"].alias("first_title"))


@query("""
SELECT doc_id, greatest(1, len(string_split(text, chr(10))) // 2) AS kept FROM documents
""")
def g4_before_references(d: Tables) -> DataFrame:
    parts = F.split("text", "\n")
    half = F.greatest(F.lit(1), F.floor(F.size(parts) / 2)).cast("int")
    cut = F.concat(F.slice(parts, F.lit(1), half), F.array(F.lit("## References")), parts)
    return d.documents.select("doc_id", F.size(segments.before_references(cut)).cast("long").alias("kept"))


@query(f"""
WITH l AS ({_LINES}) SELECT doc_id, count(*) AS skipped FROM l WHERE line_no BETWEEN 2 AND 3 GROUP BY doc_id
""")
def g18_heading_stack(d: Tables) -> DataFrame:
    lines = segments.lines(d.documents)
    level = F.when(F.col("line_no") == 2, 2).when(F.col("line_no").isin(0, 4), 1)
    return segments.heading_level_state(lines, F.col("line_no") == 2, level).filter("skipped").groupBy("doc_id").agg(F.count("*").alias("skipped"))


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, text, CAST(1 AS BIGINT) AS pos, 0 AS k, CAST(NULL AS VARCHAR) AS piece FROM documents WHERE length(text) > 3000 AND NOT starts_with(text, '<table')
  UNION ALL
  SELECT doc_id, text, CASE WHEN pos + 3000 > length(text) THEN length(text) + 1 ELSE pos + greatest(length(cut) - 300, 1) END, k + 1, cut
  FROM (SELECT *, CASE WHEN pos + 3000 <= length(text) AND strpos(reverse(win), ' .') > 0 AND length(win) - strpos(reverse(win), ' .') - 1 > 1000 THEN substr(win, 1, length(win) - strpos(reverse(win), ' .')) ELSE win END AS cut
        FROM (SELECT *, substr(text, pos, 3000) AS win FROM w WHERE pos <= length(text)))),
o AS (SELECT doc_id, k, trim(piece) AS text FROM w WHERE piece IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS "window", text FROM o WHERE text <> ''
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 3000 OR starts_with(text, '<table')
""")
def g12_overlapping_windows(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.posexplode(segments.overlapping_windows(F.col("text"), 3000, 300)).alias("window", "text"))


@query("""
SELECT page_id, page_id % 2 = 0 AS is_si, CASE page_id % 3 WHEN 0 THEN 'LiDFOB' WHEN 1 THEN 'FEC' ELSE 'xyz' END AS additive, 'a $$x y$$ alt b' AS math, page_id % 2 = 1 AS has_nca, 'out/' || page_id AS path FROM pages
""")
def t22_t25_t29_names(d: Tables) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("_SI.md"))).otherwise("main.md")
    additive = F.when(k % 3 == 0, "LIDFOB").when(k % 3 == 1, " fec").otherwise("xyz")
    text = F.when(k % 2 == 1, "an NCA cell").otherwise("encapsulated")
    return d.pages.select("page_id", t.is_supplement_name(name).alias("is_si"), t.additive_name(additive).alias("additive"), t.one_line_math(F.lit("a $$x\n y$$ ![alt](u) b")).alias("math"), text.rlike(t.term_pattern("NCA")).alias("has_nca"), t.filled("out/{ID}", {"ID": k}).alias("path"))


@query("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'vs') THEN 'screening' END AS question, CASE WHEN contains(lower(text), 'dop') THEN 'doping' WHEN contains(lower(text), 'oxidation') THEN 'compatibility' WHEN contains(lower(text), 'retention') THEN 'performance' END AS relation FROM conversations
""")
def l7_l9_kinds(d: Tables) -> DataFrame:
    low = F.lower("text")
    return d.conversations.select("conv_id", "turn", labels.first_match(low, vocab.QUESTION_KINDS).alias("question"), labels.first_match(low, vocab.RELATION_KINDS).alias("relation"))


@query(f"""
WITH l AS ({_LINES}) SELECT doc_id, count(*) AS kept FROM l WHERE line_no NOT BETWEEN 1 AND 3 GROUP BY doc_id
""")
def g3_details(d: Tables) -> DataFrame:
    n = F.col("line_no")
    lines = segments.lines(d.documents)
    sizes = lines.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    marked = lines.join(sizes, "doc_id").withColumn("line", F.when(n == 1, "<details>").when((n == 3), "</details>").otherwise(F.lit("x")))
    return segments.without_details(marked).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("""
SELECT page_id, '# Methods' AS first_line, 3 AS n_parts FROM pages
""")
def g2_g6_heads_and_equations(d: Tables) -> DataFrame:
    head = F.array(F.lit("# Supporting Information"), F.lit("## Supporting Figures"), F.lit("x"), F.lit("# Methods"), F.col("url"))
    parts = F.array(F.lit("so"), F.lit("$$a$$"), F.lit("Table 1. t"), F.lit("| a | b | c |"), F.lit("end"))
    return d.pages.select("page_id", segments.without_supplement_head(head)[0].alias("first_line"), F.size(segments.with_equations_and_captions(parts)).alias("n_parts"))


@query(f"""
WITH l AS ({_LINES}) SELECT doc_id, count(*) FILTER (len(regexp_extract_all(line, '\\|')) >= 3) AS tables, count(*) AS n FROM l GROUP BY doc_id
""")
def g15_routed(d: Tables) -> DataFrame:
    return segments.routed(segments.lines(d.documents)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count("*").alias("n"))


@query("""
SELECT page_id, 'Table 2. b' AS caption FROM pages
""")
def g16_table_context(d: Tables) -> DataFrame:
    made = d.pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.array(F.lit("Table 1. a"), F.lit("x"), F.lit("Table 2. b"), F.lit("| a | b |  c |"), F.lit("| 1 | 2 | 3 |"), F.lit("y"))).alias("line_no", "line"))
    return segments.table_contexts(made).select(F.col("doc_id").alias("page_id"), "caption")
