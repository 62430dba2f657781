"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as s
from .registry import Tables, query
from .text_queries import TOKEN_SQL

_TOK = f"list_transform(regexp_extract_all({{0}}, '{TOKEN_SQL}'), lambda x: CASE WHEN regexp_matches(x, '^[\\x00-\\x7F]+$') THEN lower(x) ELSE x END)"
_BM25 = f"""
WITH tok AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY doc_id, dl, term),
raw AS (SELECT term, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st),
idf AS (SELECT term, CASE WHEN r < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY query_id, term),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""


def _bench_hits(d: Tables, k: int) -> DataFrame:
    return s.bm25(d.documents.select("doc_id", "text"), d.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k)


@query(_BM25 + "SELECT query_id, doc_id, score FROM rk WHERE rank <= 10")
def r1_bm25(d: Tables) -> DataFrame:
    return _bench_hits(d, 10).select("query_id", "doc_id", "score")


@query(f"""
WITH k AS (SELECT doc_id, len(list_intersect({_TOK.format('text')}, ['the', 'licensed'])) AS score FROM documents)
SELECT doc_id, CAST(score AS INTEGER) AS score FROM k WHERE score > 0
""")
def r1_term_overlap(d: Tables) -> DataFrame:
    return s.term_overlap(d.documents, ["the", "licensed"])


_DOTS = "list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i]) * (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i])))"
_VEC = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS qlabel, round(greatest(CAST(0 AS DOUBLE), 1 - {_DOTS} / 2), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


def _queries(d: Tables) -> DataFrame:
    return d.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("qlabel"))


@query(f"""
WITH p AS ({_VEC}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE label <> 3)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def r2_vector_top_k(d: Tables) -> DataFrame:
    return s.vector_top_k(d.embeddings, _queries(d).select("query_id", "query"), 10, F.col("label") != 3)


@query(f"""
WITH p AS ({_VEC}), m AS (SELECT *, CASE WHEN label = qlabel AND score > CAST(0.9 AS DOUBLE) AND vec_id <> query_id THEN 0 WHEN label = qlabel AND score > CAST(0.4 AS DOUBLE) AND vec_id <> query_id THEN 1 WHEN vec_id <> query_id AND score > CAST(0.3 AS DOUBLE) THEN 2 END AS tier FROM p),
l AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS least FROM m)
SELECT query_id, vec_id, tier FROM l WHERE tier = least
""")
def r3_relaxation(d: Tables) -> DataFrame:
    scored = s.vector_pairs(d.embeddings, _queries(d), above=0.3, carried=["label"])  # no tier takes others
    other, same = F.col("vec_id") != F.col("query_id"), F.col("label") == F.col("qlabel")
    return s.relaxed(scored, [same & (F.col("score") > 0.9) & other, same & (F.col("score") > 0.4) & other, other & (F.col("score") > 0.3)], ["query_id"]).select("query_id", "vec_id", "tier")


@query("""
WITH a AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_nationkey FROM customer),
b AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name DESC, c_custkey) AS rank, c_nationkey FROM customer),
u AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20)
SELECT c_nationkey, c_custkey, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS rrf, round(least(CAST(1 AS DOUBLE), sum(CAST(1 AS DOUBLE) / (60 + rank)) * 61), 4) AS share FROM u GROUP BY c_nationkey, c_custkey
""")
def r4_rrf(d: Tables) -> DataFrame:
    keys = ["c_nationkey", "c_custkey"]
    a = s.ranked(d.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20)
    b = s.ranked(d.customer, ["c_nationkey"], [F.desc("c_name"), F.col("c_custkey")], 20)
    return s.rrf([a, b], keys).withColumnRenamed("score", "rrf").join(s.rrf([a, b], keys, normalised=True).withColumnRenamed("score", "share"), keys)


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE s_acctbal * (CAST(0.3 AS DOUBLE) / CAST(0.7 AS DOUBLE)) END AS score FROM supplier
""")
def r7_u5_cross_library(d: Tables) -> DataFrame:
    literature = d.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return s.cross_library(literature, d.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")), 0.7, 0.3)


@query("""
SELECT l_partkey, max(l_extendedprice) AS l_extendedprice, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 10 + l_linenumber END) AS title FROM lineitem GROUP BY l_partkey
""")
def r8_r18_best_per_passage(d: Tables) -> DataFrame:
    hits = d.lineitem.select("l_partkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(" ").alias("title"))
    return s.best_per_passage(hits, "l_partkey", "l_extendedprice", "seq", "title")


@query("""
WITH h AS (SELECT event_id, user_id, event_type, value / 100 AS score FROM events)
SELECT event_id, round((CASE WHEN event_type <> 'click' THEN score * CAST(0.35 AS DOUBLE) ELSE score END) + CASE WHEN user_id % 5 = 0 THEN CAST(0.12 AS DOUBLE) ELSE 0 END
   + CASE WHEN user_id % 7 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN CAST(0.15 AS DOUBLE) ELSE 0 END, 6) AS score FROM h
""")
def r9_rescored(d: Tables) -> DataFrame:
    hits = d.events.select("event_id", "user_id", "event_type", (F.col("value") / 100).alias("score"))
    user = F.col("user_id")
    return s.rescored(hits, F.col("event_type") != "click", user % 5 == 0, user % 7 == 0, user % 3 == 0).select("event_id", "score")


@query(r"""
SELECT doc_id, round(least(len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?\s*(?:mAh|V|%|°C|S/cm)')), 5) * CAST(0.04 AS DOUBLE), 6) AS bonus FROM documents
""")
def r10_numeric_bonus(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.round(s.numeric_bonus(F.col("text")), 6).alias("bonus"))


@query("""
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice AS score, o_totalprice % 97 / 97 AS rr FROM orders),
m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM h WINDOW w AS (PARTITION BY o_custkey))
SELECT o_orderkey, CAST(floor(1000 * round(CAST(0.3 AS DOUBLE) * CASE WHEN hi = lo THEN CAST(0.5 AS DOUBLE) ELSE (score - lo) / (hi - lo) END + CAST(0.7 AS DOUBLE) * rr, 6) + CAST(0.0001 AS DOUBLE)) AS BIGINT) AS score FROM m
""")
def r12_w4_reranked(d: Tables) -> DataFrame:
    hits = d.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"), (F.col("o_totalprice") % 97 / 97).alias("rr"))
    return s.reranked(hits, ["o_custkey"], "rr").select("o_orderkey", F.floor(1000 * F.col("score") + 0.0001).alias("score"))


@query(r"""
WITH c AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 AS a, (length(lower(text)) - length(replace(lower(text), 'thing', ''))) // 5 AS b FROM documents WHERE length(text) >= 40),
f AS (SELECT *, CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) AS found FROM c)
SELECT doc_id, CAST(least(a, 4) * 3 + least(b, 4) + CASE WHEN found >= 2 THEN found * 4 ELSE 0 END AS INTEGER) AS score FROM f
""")
def r13_keyword_score(d: Tables) -> DataFrame:
    return d.documents.filter(F.length("text") >= 40).select("doc_id", s.keyword_score(F.col("text"), ["license", "thing"], {"license"}).cast("int").alias("score"))


@query(_BM25 + """, m AS (SELECT rk.*, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY score DESC, doc_id) AS copy FROM rk JOIN documents USING (doc_id) WHERE rank <= 30)
SELECT query_id, doc_id FROM m WHERE copy = 1 AND rank <= 30
""")
def r14_u4_distinct_hits(d: Tables) -> DataFrame:
    hits = _bench_hits(d, 30).join(d.documents.select("doc_id", F.md5("text").alias("h")), "doc_id")
    return s.ranked(hits.drop("rank"), ["query_id", "h"], [F.desc("score"), F.col("doc_id")], 1).select("query_id", "doc_id")


@query(_BM25 + """, a AS (SELECT query_id, list(doc_id) AS ds FROM rk WHERE rank <= 10 GROUP BY query_id)
SELECT a.query_id AS qa, b.query_id AS qb, round(len(list_intersect(a.ds, b.ds)) / CAST(len(list_distinct(list_concat(a.ds, b.ds))) AS DOUBLE), 6) AS jaccard FROM a JOIN a b ON a.query_id < b.query_id
""")
def u8_j20_overlap(d: Tables) -> DataFrame:
    sets = _bench_hits(d, 10).groupBy("query_id").agg(F.collect_set("doc_id").alias("ds"))
    a, b = sets.select(F.col("query_id").alias("qa"), F.col("ds").alias("da")), sets.select(F.col("query_id").alias("qb"), F.col("ds").alias("db"))
    return a.join(b, F.col("qa") < F.col("qb")).select("qa", "qb", F.round(F.size(F.array_intersect("da", "db")) / F.size(F.array_union("da", "db")), 6).alias("jaccard"))


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o_orderkey, round(CASE WHEN r > 2 THEN o_totalprice * CAST(0.8 AS DOUBLE) ELSE o_totalprice END, 4) AS score FROM n
""")
def w3_suppressed(d: Tables) -> DataFrame:
    hits = d.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    return s.suppressed(hits, "o_custkey", "o_orderkey").select("o_orderkey", F.round("score", 4).alias("score"))


@query("""
SELECT c.turn, c.conv_id, coalesce(p.text, c.text) AS text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn % 2 = 1
""")
def j9_promoted(d: Tables) -> DataFrame:
    parents = d.conversations.filter("turn = 0").select(F.col("conv_id").alias("id"), "text")
    hits = d.conversations.withColumn("parent_id", F.when(F.col("turn") % 2 == 1, F.col("conv_id")))
    return s.promoted(hits, parents).select("turn", "conv_id", "text")


def _bm25_of(library: str, where: str) -> str:
    """CTEs ending in w_<library> (query_id, doc_id, n): the rank of each document of a library by words."""
    x = library
    return f"""tok_{x} AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents WHERE {where}),
st_{x} AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok_{x}),
post_{x} AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok_{x}) GROUP BY doc_id, dl, term),
raw_{x} AS (SELECT term, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS r FROM (SELECT term, count(*) AS df FROM post_{x} GROUP BY term), st_{x}),
idf_{x} AS (SELECT term, CASE WHEN r < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(r) FROM raw_{x}) ELSE r END AS idf FROM raw_{x}),
sc_{x} AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
  FROM post_{x} JOIN qt USING (term) JOIN idf_{x} USING (term), st_{x} GROUP BY query_id, doc_id),
w_{x} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM sc_{x}),
"""


def _route_of(library: str, routes: str, k: str, wanted: str, factor: str) -> str:
    """CTEs ending in f_<library>: the fused hits of a library."""
    x = library
    fits = "(want IS NULL OR component IS NULL OR lower(trim(component)) = lower(trim(want)))"
    return f"""p_{x} AS (SELECT query_id, {k} AS k, {wanted} AS want, route FROM q WHERE route IN ({routes})),
n0_{x} AS (SELECT v.query_id, v.doc_id, v.n, v.score, p.k, {fits} AS fits, max({fits}) OVER (PARTITION BY v.query_id) AS anyfit FROM v JOIN d USING (doc_id) JOIN p_{x} p ON p.query_id = v.query_id WHERE d.library = '{x}'),
n_{x} AS (SELECT * FROM (SELECT query_id, doc_id, score, k, row_number() OVER (PARTITION BY query_id ORDER BY n) AS n FROM n0_{x} WHERE fits OR NOT anyfit) WHERE n <= greatest(k, 20)),
b0_{x} AS (SELECT w.query_id, w.doc_id, w.n, p.k, {fits} AS fits, max({fits}) OVER (PARTITION BY w.query_id) AS anyfit FROM w_{x} w JOIN d USING (doc_id) JOIN p_{x} p ON p.query_id = w.query_id
  WHERE w.n <= CASE WHEN want IS NOT NULL THEN greatest(5 * p.k, 300) ELSE greatest(p.k, 20) END),
b_{x} AS (SELECT * FROM (SELECT query_id, doc_id, k, row_number() OVER (PARTITION BY query_id ORDER BY n) AS n FROM b0_{x} b WHERE fits OR (NOT anyfit AND NOT EXISTS (SELECT 1 FROM n_{x} o WHERE o.query_id = b.query_id))) WHERE n <= greatest(k, 20)),
u_{x} AS (SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + n)), 6) AS rrf, max(score) AS score, max(word) AS word FROM (SELECT query_id, doc_id, n, NULL AS score, 1 AS word FROM b_{x} UNION ALL SELECT query_id, doc_id, n, score, 0 FROM n_{x}) GROUP BY ALL),
s_{x} AS (SELECT u.query_id, doc_id, p.route, p.k, CASE WHEN bb AND nn THEN rrf WHEN nn THEN u.score ELSE CAST(1 AS DOUBLE) END AS score
  FROM u_{x} u JOIN p_{x} p ON p.query_id = u.query_id JOIN (SELECT query_id, max(word) = 1 AS bb, count(score) > 0 AS nn FROM u_{x} GROUP BY query_id) g ON g.query_id = u.query_id),
f_{x} AS (SELECT query_id, doc_id, '{x}' AS library, round(score * {factor}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM s_{x}) WHERE n <= k),
"""


_DIST = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))"


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ebook' ELSE 'literature' END AS library, CASE WHEN doc_id % 10 <> 0 THEN lang END AS component FROM documents),\n"
       "q AS (SELECT item_id AS query_id, text, 3 + item_id % 5 AS k, CASE WHEN item_id % 2 = 0 THEN 'EN' WHEN item_id % 7 = 0 THEN 'none' END AS want, ['literature', 'textbook', 'both', NULL][CAST(item_id % 4 + 1 AS INTEGER)] AS plan, "
       "coalesce(nullif(['', 'textbook', 'both', ''][CAST(item_id % 4 + 1 AS INTEGER)], ''), 'literature') AS route FROM benchmark),\n"
       f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY query_id, term),\n"
       f"v AS (SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, round(greatest(CAST(0 AS DOUBLE), 1 - {_DIST} / 2), 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(greatest(CAST(0 AS DOUBLE), 1 - {_DIST} / 2), 6) DESC, a.vec_id) AS n "
       "FROM embeddings a JOIN d ON d.doc_id = a.vec_id, embeddings b JOIN benchmark i ON i.item_id = b.vec_id WHERE b.vec_id % 3 = 0) WHERE n <= 30),\n"
       + _bm25_of("literature", "doc_id % 4 <> 0") + _bm25_of("ebook", "doc_id % 4 = 0")
       + _route_of("literature", "'literature', 'both'", "k", "want", "1")
       + _route_of("ebook", "'textbook', 'both'", "CASE WHEN route = 'both' THEN 10 ELSE k END", "CAST(NULL AS VARCHAR)", "CASE WHEN route = 'both' THEN CAST(0.3 AS DOUBLE) / CAST(0.7 AS DOUBLE) ELSE 1 END")
       + """z AS (SELECT u.*, q.k, row_number() OVER (PARTITION BY u.query_id ORDER BY score DESC, library DESC, doc_id) AS rank FROM (SELECT * FROM f_literature UNION ALL SELECT * FROM f_ebook) u JOIN q ON q.query_id = u.query_id)
SELECT query_id, doc_id, library, score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= k
""")  # fmt: skip
def r5_r6_r16_routed(d: Tables) -> DataFrame:
    key, item = F.col("doc_id"), F.col("item_id")
    docs = d.documents.select("doc_id", "text", F.when(key % 4 == 0, "ebook").otherwise("literature").alias("library"), F.when(key % 10 != 0, F.col("lang")).alias("component"))
    none = F.lit(None).cast("double")
    queries = d.benchmark.select(
        item.alias("query_id"), F.col("text").alias("query"), (3 + item % 5).alias("k"), F.when(item % 2 == 0, "EN").when(item % 7 == 0, "none").alias("wanted"),
        F.when(item % 4 == 0, "literature").when(item % 4 == 1, "textbook").when(item % 4 == 2, "both").alias("route"), none.alias("w_literature"), none.alias("w_ebook"),
    )
    vectors = d.embeddings.join(d.documents.select(key.alias("vec_id")), "vec_id", "left_semi")
    asked = d.embeddings.join(d.benchmark.select(item.alias("vec_id")), "vec_id", "left_semi").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = s.vector_top_k(vectors, asked, 30).withColumnRenamed("vec_id", "doc_id")
    return s.routed(docs, queries, near)
