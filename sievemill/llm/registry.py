"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, decontaminate, html_text, licenses, line_dedup, mixing, packing, simhash, toxicity, url_filter, warc, whitening
from .common import WORD_REGEX, stored, table, word_count


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("n_words")))  # the texts are read once
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs), size="n_words")
    out = mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
        F.round(F.get("mix_copies", F.lit(0))["position"], 6).alias("first_position"),
    )
    order = F.col("first_position").asc_nulls_last(), F.col("doc_id")  # rows that are not taken have no position
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ((row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3) + 1 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size / w AS ratio FROM s),
o AS (
  SELECT *, sum(3 * source_size) OVER a AS used, sum(w) OVER () - sum(w) OVER a AS open_w,
         sum(source_size) OVER () AS total
  FROM r WINDOW a AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (
  SELECT *, coalesce(lag(used) OVER (ORDER BY ratio, source), 0) AS used_before,
         open_w + w AS open_before FROM o),
q AS (
  SELECT max((total - used_before) / open_before) AS level FROM p),
t AS (
  SELECT s.source, s.source_size, s.w, round(least(CAST(3 * s.source_size AS DOUBLE), q.level * s.w), 6) AS target FROM s, q),
c AS (
  SELECT d.*, t.source_size, t.target, CAST(t.w AS DOUBLE) AS w,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CAST(round(target) AS BIGINT) AS want FROM c),
-- schedules: 2 at first, w half way, 2 * w - 2 at last; the area of each half up to the document's first word, then its inverse
f AS (
  SELECT *, least(w * st / target, (2 + w) * CAST(0.25 AS DOUBLE)) AS area_1 FROM e),
g AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), least(w * st / target - area_1, (w + (2 * w - 2)) * CAST(0.25 AS DOUBLE))) AS area_2 FROM f),
h AS (
  SELECT *, 2 + sqrt(greatest(CAST(0 AS DOUBLE), 4 + 4 * (w - 2) * area_1)) AS root_1, w + sqrt(greatest(CAST(0 AS DOUBLE), w * w + 4 * (w - 2) * area_2)) AS root_2 FROM g)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, want - st)) + greatest(0, least(size, want - st - source_size))
            + greatest(0, least(size, want - st - 2 * source_size)) AS BIGINT) AS taken,
       CASE WHEN least(size, want - st) > 0 THEN round(least(CAST(0.5 AS DOUBLE), 2 * area_1 / root_1) + least(CAST(0.5 AS DOUBLE), 2 * area_2 / root_2), 6) END AS first_position
FROM h
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", F.col("hit_words").alias("n_words"), hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        decontaminate.digest().alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(len(ws), 10) AS w, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
dw AS (
  SELECT doc_id, i, w, array_to_string(ws[i : i + w - 1], ' ') AS k
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM bw) l WHERE len(ws) >= w)),
occ AS (
  SELECT doc_id, i, dw.w, item FROM dw JOIN bw ON dw.w = bw.w AND dw.k = bw.k),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM (SELECT DISTINCT doc_id, i, w FROM occ)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_evidence").alias("evidence"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), host="source")
    return cleaned.select("doc_id", "line_total", "line_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, ls[i] AS line, trim(translate(ls[i], chr(9) || chr(13), '  '), ' ') AS k, len(ls) AS n
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
p AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (
  SELECT c.source, c.k FROM (SELECT source, k, count(*) AS pages FROM (SELECT DISTINCT doc_id, source, k FROM l WHERE k <> '') GROUP BY source, k) c
  JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE pages >= 5 AND pages > total * CAST(0.02 AS DOUBLE)),
m AS (
  SELECT l.*, b.k IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k),
t AS (
  SELECT doc_id, count(*) AS line_total, count(*) FILTER (gone) AS line_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(line_total, 0) AS BIGINT) AS line_total, CAST(coalesce(line_dropped, 0) AS BIGINT) AS line_dropped,
       CAST(length(t.text) AS BIGINT) AS n_chars, sha256(t.text) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


#: (verdict, host, path) of the rules for pages.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule.rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl of ``pages``: each page is a full response, a minute after the one
    before, and half a day later the server says that it is not modified since."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    full = F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"))
    fresh = F.create_map(F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("Content-Length"), F.lit("0"))
    response = pages.select(F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("at"), F.lit(200).alias("status"), full.alias("headers"), F.col("html").cast("binary").alias("body"))
    revisit = pages.select(F.concat(F.lit("v"), F.col("page_id")), F.lit("revisit"), "url", at + F.expr("INTERVAL 12 HOURS"), F.lit(304), fresh, F.lit(None).cast("binary"))
    return response.union(revisit)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "canonical", "outcome", "response_id", F.sha2("body", 256).alias("body_sha256"), F.to_json("headers").alias("headers"))


OP3_SQL = r"""
WITH t AS (
  SELECT page_id, html, regexp_replace(url, '(?s)#.*$', '') AS u FROM pages),
p AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '(?s)^.*?://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(u, '(?s)^.*?://[^/?]*([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(u, '(?s)\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|gclid|fbclid|ref)(=|$)'))) AS q, u
  FROM t),
c AS (
  SELECT page_id, html, '"' || md5(coalesce(html, '')) || '"' AS tag,
         CASE WHEN contains(u, '://') THEN base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE u END AS canonical
  FROM p),
j AS (
  SELECT v.page_id, v.canonical, v.tag, max(r.page_id) AS rid
  FROM c v LEFT JOIN c r ON r.canonical = v.canonical AND r.page_id < v.page_id + 720 GROUP BY v.page_id, v.canonical, v.tag)
SELECT 'v' || j.page_id AS record_id, j.canonical,
       CASE WHEN rid IS NULL THEN 'missing' WHEN r.tag = j.tag THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN r.tag = j.tag THEN 'r' || rid END AS response_id, CASE WHEN r.tag = j.tag THEN sha256(coalesce(r.html, '')) END AS body_sha256,
       CASE WHEN r.tag = j.tag THEN '{"cache-control":"max-age=3600","content-type":"text/html","etag":"' || chr(92) || '"' || replace(j.tag, '"', '') || chr(92) || '""}'
            ELSE '{"cache-control":"max-age=3600","content-length":"0","etag":"' || chr(92) || '"' || replace(j.tag, '"', '') || chr(92) || '""}' END AS headers
FROM j LEFT JOIN c r ON r.page_id = j.rid
"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("license_matches").cast("long").alias("n_matches"), F.col("license_matches").alias("matches"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    cut = packing.pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained])
    each = whitening.transform(vectors, model, "vec_id").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD_REGEX), F.lit(0))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different")).alias("words"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text)).alias("C"), text.rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    known = audit.repeats_smaller(stored(docs), "key", "doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    n, different = F.col("words.n"), F.col("words.different")
    fails = {"A": n < 200, "B": 100 * different.cast("long") < 50 * n.cast("long"), "C": F.col("C"), "D": F.col("D"), "E": F.col("repeats")}
    found = audit.audit(known.join(labels, "doc_id", "left"), fails, F.col("part"), {"good": F.col("good"), "toxic": F.col("toxic")})
    return found.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT text, min(doc_id) AS first FROM t GROUP BY text),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > m.first, false) AS e
  FROM t JOIN m USING (text) LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (
  SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits, [p.letter, q.letter, r.letter, s.letter, t.letter] AS letters
  FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
s AS (
  SELECT filter_order, step, letters[step] AS letter, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
c AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM c
"""


_QUERIES = {"op1_mixing": op1_mixing, "op2_simhash": op2_simhash, "op3_warc": op3_warc, "op4_decontamination": op4_decontamination, "op5_ann": op5_ann, "op6_licenses": op6_licenses, "op7_line_dedup": op7_line_dedup, "op8_toxicity": op8_toxicity, "op9_url_filters": op9_url_filters, "op10_html_extraction": op10_html_extraction, "op11_packing": op11_packing, "op12_whitening": op12_whitening, "op13_filter_audit": op13_filter_audit}
_SQL = {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_line_dedup": OP7_SQL, "op13_filter_audit": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
