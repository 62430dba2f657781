"""Retrieval: BM25 over stored tokens, exact vector search, rank fusion, rescoring, and plans of retrieval by query.

A query reads the terms it has. Queries and vocabularies are small tables by contract and are broadcast behind a check of their size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as t
from .storage import small, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Vectors and queries that one task compares, and queries that it compares at once.
BLOCK_ROWS, BLOCK_QUERIES, TILE = 32_768, 4_096, 64


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ts (tokens) of every document."""
    return docs.select(F.col(doc_id).alias("doc_id"), t.tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))


def inverse_frequencies(tokens: DataFrame, n: int) -> DataFrame:
    """term, idf of ``tokenised`` documents: ln(n - df + 0.5) - ln(df + 0.5); a negative one is EPSILON times the mean of all."""
    df = tokens.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = stored(df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score: every document that has a term of a query (query_id, query); a term counts as often as it is
    in the query.

    Documents are tokenised once. All their terms are counted for the frequencies, on the map side first; places of terms that no query
    has are dropped before anything is grouped by document."""
    tokens = stored(tokenised(docs))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl")).first()
    terms = queries.select("query_id", F.explode(t.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = stored(terms.join(inverse_frequencies(tokens, stats["n"]), "term"))
    asked = small(weighted.select("term").distinct())
    index = tokens.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = index.join(small(weighted), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * part), 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, as in ``bm25_scores``. Ties go to the smaller doc_id."""
    return ranked(bm25_scores(docs, queries, k1, b), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """``rank`` from 1 within each key; the first k only."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def term_overlap(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, score: how many of the distinct words the document has; the fallback without BM25."""
    tokens = F.array_distinct(t.tokens(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select("doc_id", F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))).alias("score")).filter("score > 0")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``dim`` doubles, and their lengths: -1 where it or a component is null."""
    arrays = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(int)
    values, row = arrays.flatten(), np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), dim))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values.to_numpy(zero_copy_only=False)
    lengths[arrays.is_null().to_numpy(zero_copy_only=False)] = -1
    lengths[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def _scores(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarities of all pairs with 6 digits, summed from the first component to the last; 0 where lengths differ."""
    far = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        diff = x[:, j, None] - y[None, :, j]
        far += diff * diff
    score = np.floor(np.maximum(0.0, 1 - far / 2) * 1e6 + 0.5) / 1e6
    return np.where((nx[:, None] == ny[None]) & (nx[:, None] >= 0), score, 0.0)


def vector_pairs(vectors: DataFrame, queries: DataFrame, k: int | None = None, above: float | None = None, carried: list[str] | None = None) -> DataFrame:
    """Pairs of a query (query_id, query, others) and a vector (vec_id, embedding): the queries' columns but query,
    vec_id, ``carried`` columns of the vectors, score (max(0, 1 - d/2) of the squared distance; exact).

    Only pairs with a score over ``above``. With ``k`` each task hands on at most the k best of a query, ties to the
    smaller vec_id. Both sides are dealt into blocks, and each pair of blocks is a task: neither has to be small."""
    own, kept = [c for c in queries.columns if c != "query"], ["vec_id", *(carried or [])]
    vectors, queries = stored(vectors.select(*kept, "embedding")), stored(queries)
    n, m = vectors.count(), queries.count()
    rows = max(-(-n // BLOCK_ROWS), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    parts = max(-(-m // BLOCK_QUERIES), 1)
    at = F.xxhash64("_metadata.file_name", "_metadata.row_index")  # a row's place in its stored table: a task that runs again deals it alike
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)).cast("array<bigint>"))
    left = vectors.select(*kept, "embedding", F.pmod(at, F.lit(rows)).alias("__a")).withColumn("__b", every(parts))
    right = queries.select(*queries.columns, F.pmod(at, F.lit(parts)).alias("__b")).withColumn("__a", every(rows))
    schema = StructType([*(queries.schema[c] for c in own), *(vectors.schema[c] for c in kept), StructField("score", DoubleType())])

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        taken, wanted, found = [], [], []
        if len(block) and len(asked):
            dim = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (block["embedding"], asked["query"]))
            (x, nx), (y, ny) = _matrix(block["embedding"], dim), _matrix(asked["query"], dim)
            ids = block["vec_id"].combine_chunks()
            valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            for q in range(0, len(y), TILE):
                # a tile of vectors at a time, so that the sums stay in the cache
                near = np.concatenate([_scores(x[i : i + 1024], nx[i : i + 1024], y[q : q + TILE], ny[q : q + TILE]) for i in range(0, len(x), 1024)])
                for j in range(near.shape[1]):
                    own_score = near[:, j]
                    rank = np.where(np.isnan(own_score), -np.inf, -own_score)
                    row = np.arange(len(x)) if above is None else np.flatnonzero(rank < -above)
                    if k is not None:
                        if len(row) > k:
                            row = row[rank[row] <= np.partition(rank[row], k - 1)[k - 1]]
                        row = row[np.lexsort((ids[row], valid[row], rank[row]))][:k]
                    taken.append(row)
                    wanted.append(np.full(len(row), q + j))
                    found.append(own_score[row])
        empty = np.zeros(0, int)
        take, of = (pa.array(np.concatenate([empty, *c]).astype(int)) for c in (taken, wanted))
        score = pa.array(np.concatenate([np.zeros(0), *found]))
        return pa.Table.from_arrays([*(asked[c].take(of) for c in own), *(block[c].take(take) for c in kept), score], [*own, *kept, "score"])

    return left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInArrow(run, schema)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar of each query (query_id, query), as in ``vector_pairs``."""
    base = vectors if where is None else vectors.filter(where)
    return ranked(vector_pairs(base, queries.select("query_id", "query"), k), ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score", "rank")


def relaxed(rows: DataFrame, tiers: list[Column], keys: list[str]) -> DataFrame:
    """The rows of each key's first tier that has any: ``tiers`` are conditions, the strictest first."""
    tier = F.lit(None).cast("int")
    for i, condition in reversed(list(enumerate(tiers))):
        tier = F.when(condition, F.lit(i)).otherwise(tier)
    marked = rows.withColumn("tier", tier)
    return marked.withColumn("__least", F.min("tier").over(Window.partitionBy(*keys))).filter("tier = __least").drop("__least")


def rrf(rankings: list[DataFrame], keys: list[str], k: int = RRF_K, normalised: bool = False) -> DataFrame:
    """keys, score: reciprocal ranks of all rankings (each with keys and rank) summed; 6 digits, or as a
    share of the best possible with 4."""
    union = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select(*keys, "rank"))
    total = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))
    score = F.round(F.least(F.lit(1.0), total * (k + 1)), 4) if normalised else F.round(total, 6)
    # dealt by all keys: rankings made by windows over some of the keys only do not stand in for that
    return union.repartition(*keys).groupBy(*keys).agg(score.alias("score"))


def cross_library(literature: DataFrame, books: DataFrame, w_literature: float, w_books: float) -> DataFrame:
    """id, score of both; book scores are scaled by the weights' ratio, and on a clash literature wins."""
    ratio = w_books / max(w_literature, 0.01)
    union = literature.select("id", "score", F.lit(0).alias("library")).union(books.select("id", F.col("score") * ratio, F.lit(1)))
    return union.groupBy("id").agg(F.min_by("score", F.struct("library", -F.col("score"))).alias("score"))


def best_per_passage(hits: DataFrame, passage: str, score: str, order: str, title: str) -> DataFrame:
    """The best score of each passage, and the first title that is not blank."""
    blank = F.when(F.trim(title) != "", F.col(order))
    return hits.groupBy(passage).agg(F.max(score).alias(score), F.min_by(title, blank).alias(title))


def rescored(hits: DataFrame, off_component: Column | None = None, previous: Column | None = None, exclude: Column | None = None, boost: Column | None = None) -> DataFrame:
    """Scores times 0.35 off the component, plus 0.12 if seen before, minus 0.5 with an excluded term, plus 0.15
    with a boosted one."""
    score = F.col("score")
    if off_component is not None:
        score = F.when(off_component, score * 0.35).otherwise(score)
    for condition, bonus in ((previous, 0.12), (exclude, -0.5), (boost, 0.15)):
        if condition is not None:
            score = score + F.when(condition, bonus).otherwise(0.0)
    return hits.withColumn("score", F.round(score, 6))


def numeric_bonus(text: Column) -> Column:
    """0.04 a number with a unit, five at most."""
    return F.least(F.regexp_count(text, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*(?:mAh|V|%|°C|S/cm)")), F.lit(5)) * 0.04


def suppressed(hits: DataFrame, paper: str, order: str, keep: int = 2, factor: float = 0.8) -> DataFrame:
    """From the third hit of a paper on, in the order given, scores times ``factor``."""
    n = F.row_number().over(Window.partitionBy(paper).orderBy(order))
    return hits.withColumn("score", F.when(n > keep, F.col("score") * factor).otherwise(F.col("score")))


def min_max(score: str, keys: list[str]) -> Column:
    """Scores from 0 to 1 within each key; 0.5 if all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(F.col(score) - low, high - low))


def reranked(hits: DataFrame, keys: list[str], rerank: str, alpha: float = 0.7) -> DataFrame:
    """``score``: (1 - alpha) of the min-max score and alpha of the rerank score."""
    return hits.withColumn("score", F.round((1 - alpha) * min_max("score", keys) + alpha * F.col(rerank), 6))


def keyword_score(text: Column, terms: list[str], core: set[str]) -> Column:
    """Up to 4 occurrences of each term, core terms three times, and 4 a term if at least two are there."""
    low, total, found = F.lower(text), F.lit(0), F.lit(0)
    for term in terms:
        n = F.regexp_count(low, F.lit(rf"\b{term}\b")) if len(term) <= 2 else F.regexp_count(low, F.lit(term))
        total = total + F.least(n, F.lit(4)) * (3 if term in core else 1)
        found = found + F.when(n > 0, 1).otherwise(0)
    return total + F.when(found >= 2, found * 4).otherwise(0)


def promoted(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (id, parent_id, text) with the text of their parent (id, text) where there is one."""
    full = parents.select(F.col("id").alias("parent_id"), F.col("text").alias("__full"))
    return hits.join(full, "parent_id", "left").withColumn("text", F.coalesce("__full", "text")).drop("__full")


# The least number of hits that a channel fetches; those that are fetched before a filter by component; the libraries' weights.
LEAST_DEPTH, FILTERED_DEPTH = 20, (5, 300)
WEIGHTS = {"literature": 0.7, "ebook": 0.3}
#: Hits of the other library that a query of both takes.
OTHER_DEPTH = 10


def depth(k: Column) -> Column:
    """How many hits a channel hands on for k results."""
    return F.greatest(k, F.lit(LEAST_DEPTH))


def fetched(k: Column, filtered: Column) -> Column:
    """How many hits a channel looks at: more where a filter follows."""
    return F.when(filtered, F.greatest(k * FILTERED_DEPTH[0], F.lit(FILTERED_DEPTH[1]))).otherwise(depth(k))


def in_component(hits: DataFrame, other: DataFrame, rank: str = "rank") -> DataFrame:
    """``hits`` (query_id, doc_id, rank, k, wanted, component) of the word channel after its filter: those of the wanted component or of
    none, numbered anew; without any such hit all of them, unless ``other`` (query_id) has hits of that query from elsewhere."""
    fits = F.col("wanted").isNull() | F.col("component").isNull() | (F.lower(F.trim("component")) == F.lower(F.trim("wanted")))
    marked = hits.withColumn("__fits", fits).withColumn("__any", F.max("__fits").over(Window.partitionBy("query_id")))
    alone = marked.join(other.select("query_id", F.lit(True).alias("__other")).distinct(), "query_id", "left")
    kept = alone.filter(F.col("__fits") | (~F.col("__any") & F.col("__other").isNull())).drop("__fits", "__any", "__other")
    return ranked(kept.withColumnRenamed(rank, "__before"), ["query_id"], [F.col("__before")]).filter(F.col("rank") <= depth(F.col("k"))).drop("__before")


def fused_channels(words: DataFrame, vectors: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score: reciprocal ranks where both channels (query_id, doc_id, rank, and of the vectors score) have hits of a query;
    of the vectors alone their own scores; of the words alone 1 for each."""
    both = words.select("query_id").distinct().join(vectors.select("query_id").distinct(), "query_id").withColumn("__both", F.lit(True))
    ranks = rrf([words, vectors], ["query_id", "doc_id"], k).join(both, "query_id", "left_semi")
    lone = lambda hits, score: hits.join(both, "query_id", "left_anti").select("query_id", "doc_id", score.alias("score"))
    return ranks.unionByName(lone(words, F.lit(1.0))).unionByName(lone(vectors, F.col("score")))


def routed(docs: DataFrame, queries: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """query_id, doc_id, library, score, rank: each query by its own plan, all of them in one job.

    queries: query_id, query, k, route (literature, textbook or both; anything else is literature), wanted (a component, or null),
    w_literature and w_ebook (null: WEIGHTS). docs: doc_id, text, library (literature or ebook), component. vector_hits: query_id,
    doc_id, rank, score, of the same libraries; a query without any goes by words alone. A component filters literature only. A
    query of both takes the best OTHER_DEPTH of the books, scaled by the ratio of the weights. Ties: literature, then the smaller doc_id."""
    asked = stored(queries.select("query_id", "query", "k", "wanted", *[F.coalesce(f"w_{n}", F.lit(w)).alias(f"w_{n}") for n, w in WEIGHTS.items()], F.when(F.col("route").isin("textbook", "both"), F.col("route")).otherwise("literature").alias("route")))
    meta, vector_hits = docs.select("doc_id", "library", "component"), stored(vector_hits)
    found = []
    for library, routes in (("literature", ["literature", "both"]), ("ebook", ["textbook", "both"])):
        mine = asked.filter(F.col("route").isin(*routes))
        # of both, a fixed number of books, whatever k is
        own_k = F.col("k") if library == "literature" else F.when(F.col("route") == "both", F.lit(OTHER_DEPTH)).otherwise(F.col("k"))
        wanted = F.col("wanted") if library == "literature" else F.lit(None).cast("string")
        plan = small(mine.select("query_id", own_k.alias("k"), wanted.alias("wanted"), "route", "w_literature", "w_ebook"))
        shelf = docs.filter(F.col("library") == library)
        words = ranked(stored(bm25_scores(shelf, mine.select("query_id", "query"))), ["query_id"], [F.desc("score"), F.col("doc_id")])
        words = words.join(plan, "query_id").filter(F.col("rank") <= fetched(F.col("k"), F.col("wanted").isNotNull()))
        near = vector_hits.join(meta.filter(F.col("library") == library), "doc_id").join(plan, "query_id")
        fits = F.col("wanted").isNull() | F.col("component").isNull() | (F.lower(F.trim("component")) == F.lower(F.trim("wanted")))
        near = near.withColumn("__fits", fits).withColumn("__any", F.max("__fits").over(Window.partitionBy("query_id"))).filter("__fits or not __any")
        near = stored(ranked(near.withColumnRenamed("rank", "__before"), ["query_id"], [F.col("__before")]).filter(F.col("rank") <= depth(F.col("k"))).select("query_id", "doc_id", "rank", "score"))
        words = stored(in_component(words.join(shelf.select("doc_id", "component"), "doc_id"), near).select("query_id", "doc_id", "rank"))
        hits = fused_channels(words, near).join(plan, "query_id")
        factor = F.when(F.col("route") == "both", F.col("w_ebook") / F.greatest("w_literature", F.lit(0.01))).otherwise(1.0) if library == "ebook" else F.lit(1.0)
        first = ranked(hits, ["query_id"], [F.desc("score"), F.col("doc_id")]).filter(F.col("rank") <= F.col("k"))
        found.append(first.select("query_id", "doc_id", F.lit(library).alias("library"), F.round(F.col("score") * factor, 6).alias("score")))
    every = found[0].unionByName(found[1]).join(small(asked.select("query_id", "k")), "query_id")
    order = [F.desc("score"), F.desc("library"), F.col("doc_id")]
    return ranked(every, ["query_id"], order).filter(F.col("rank") <= F.col("k")).select("query_id", "doc_id", "library", "score", "rank")
