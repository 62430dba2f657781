"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words that two of the examples have. A text's vector has (1 + ln tf) * idf for each of its terms,
idf counted over all documents, and unit length. Labels add to that: words that toxic examples do not have
significantly more often than others (log-likelihood ratio against the number of terms) count WEAK times as much,
since over all words alike long random prose hides the few words that matter; and beginnings of words (4 to 7
characters) that toxic examples have so much more often are terms too.

Examples form an inverted index. The short posting lists, of terms in few examples, are read one text at a time. The
long ones are rows of a matrix, and a few dozen texts are multiplied with it at once. Of the cosines so found the k-th
largest maximum of a block bounds the k-th best from below; those that reach it are summed again, in an order that depends
on the text alone, so the nearest are exact. Votes are weighted by cosine;
isotonic regression on the votes of all examples, each left out in turn, makes them scores.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, byte_rows, stored

#: Labelled rows that a model is fitted on at most (the first by a hash of doc_id).
FIT_ROWS = 8_000
#: Examples that have a term at least; weight of terms that labels do not tell apart.
LEAST_EXAMPLES, WEAK = 2, 0.3
#: Share of the examples beyond which a term's posting list is long: from there on a product of matrices costs less.
LONG = 0.08
#: Examples in a block; texts that are compared at once, and texts whose scores a task remembers.
NEIGHBOURS, BLOCK, AT_ONCE, REMEMBERED = 15, 16, 64, 20_000
PREFIXES = (4, 5, 6, 7)
PRIOR = 0.25


def terms_of(word: bytes) -> list[str]:
    """A word and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [f"={text}", *(f"^{text[:n]}" for n in PREFIXES if len(text) > n)]


class Terms:
    """Numbers of the kept terms. often: examples that have each; frequent words lie together, which makes look-ups faster."""

    def __init__(self, terms: list[str], often: Sequence[int] = ()):
        self.size = len(terms)
        order = np.argsort(-np.asarray(often), kind="stable").tolist() if len(often) else range(len(terms))
        self.whole = {terms[i][1:].encode(): i for i in order if terms[i][0] == "="}
        self.starts = {t[1:].encode(): i for i, t in enumerate(terms) if t[0] == "^"}
        self.sizes = sorted({len(t) for t in self.starts})
        self.heads = {t[: PREFIXES[0]] for t in self.starts}  # their first bytes, to pass over most words

    def _begun(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """Each word with each kept term that it begins with and goes on from."""
        for word in [w for w in words if w[: PREFIXES[0]] in self.heads] if self.heads else ():
            for n in self.sizes:
                if n < len(word) and word[:n] in self.starts:
                    yield word, self.starts[word[:n]]

    def distinct(self, text: bytes | None) -> list[int]:
        """Kept terms of a whole text, each once."""
        words = set(alnum_words(text or b""))
        return [i for i in map(self.whole.get, words) if i is not None] + list({i for _, i in self._begun(words)})

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Kept terms of a whole text, ascending, and how often they are in it."""
        times = Counter(alnum_words(text or b""))
        found = {i: n for i, n in zip(map(self.whole.get, times), times.values(), strict=True) if i is not None}
        for word, i in self._begun(times):
            found[i] = found.get(i, 0) + times[word]
        terms = np.fromiter(found, np.int64, len(found))
        order = np.argsort(terms)
        return terms[order], np.fromiter(found.values(), float, len(found))[order]


class Examples:
    """Labelled vectors in an inverted index, the long lists as a matrix."""

    def __init__(self, rows: list[tuple[object, int, np.ndarray, np.ndarray]], n_terms: int, long: float = LONG):
        rows = sorted(rows, key=lambda r: (len(r[2]), np.asarray(r[2]).tobytes(), np.asarray(r[3]).tobytes(), r[1], str(r[0])))
        self.ids, self.labels, n = [r[0] for r in rows], np.array([r[1] for r in rows], float), len(rows)
        self.number = {d: i for i, d in enumerate(self.ids)}
        sizes = [len(r[2]) for r in rows]
        term, weight = (np.concatenate([np.zeros(0, kind), *(np.asarray(r[i], kind) for r in rows)]) for i, kind in ((2, np.int64), (3, float)))
        example = np.repeat(np.arange(n, dtype=np.int32), sizes)
        is_long = np.bincount(term, minlength=n_terms) > max(1, long * n)
        self.long = np.where(is_long, np.cumsum(is_long) - 1, -1)  # a long list's number
        self.blocks = -(-n // BLOCK)
        inside = is_long[term]
        self.dense = np.zeros((int(is_long.sum()), BLOCK * self.blocks))  # long lists as weights by example
        self.dense[self.long[term[inside]], example[inside]] = weight[inside]
        term, example, weight = term[~inside], example[~inside], weight[~inside]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))  # of each short list

    def _light(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What terms with short lists add to each example's cosine."""
        lo, hi = self.first[terms], self.first[terms + 1]
        lists = [slice(*x) for x in zip(lo.tolist(), hi.tolist(), strict=True)]
        if not lists:
            return np.zeros(self.dense.shape[1])
        products = np.concatenate([self.weight[x] for x in lists])
        products *= np.repeat(weights, hi - lo)
        return np.bincount(np.concatenate([self.example[x] for x in lists]), products, minlength=self.dense.shape[1])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_of`` for a single vector."""
        return self.nearest_of([(terms, weights)], k, [without])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: Sequence[int] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector numbers and cosines of the k nearest examples, all that tie with the last
        included; only those with a common term, and not its own number in ``without``. Ordered by cosine, then number."""
        heavy = np.zeros((len(vectors), len(self.dense)))
        for row, (terms, weights) in zip(heavy, vectors, strict=True):
            long = self.long[terms]
            row[long[long >= 0]] = weights[long >= 0]
        sums, found = heavy @ self.dense, []  # last digits depend on the vectors beside it
        for at, (terms, weights) in enumerate(vectors):
            short = self.long[terms] < 0
            light, whole = self._light(terms[short], weights[short]), sums[at]
            whole += light
            if len(without) and without[at] >= 0:
                whole[without[at]] = 0
            most, least = whole.reshape(BLOCK, self.blocks).max(axis=0), 0.0
            if len(most) < k:
                most = whole
            if len(most) > k:
                least = np.partition(most, -k)[-k]
            near = np.flatnonzero((whole > 0) & (whole >= least - 1e-9))
            mine = np.flatnonzero(heavy[at])
            cosines = light[near] + (heavy[at, mine][:, None] * self.dense[mine[:, None], near]).sum(axis=0)
            if len(cosines) > k:
                reach = cosines >= np.partition(cosines, -k)[-k] - 1e-12
                near, cosines = near[reach], cosines[reach]
            order = np.lexsort((near, -np.round(cosines, 12)))
            found.append((near[order], cosines[order]))
        return found

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """Mean of the labels (toxic 1, else -1), weighted by cosine over all k votes: far
        neighbours, or too few, leave it near 0."""
        n = max(NEIGHBOURS, len(numbers))
        return float(np.sum(cosines * (2 * self.labels[numbers] - 1)) / n)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the best rising step function (pool adjacent violators); levels are
    smoothed by half a row of each label."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    """A fitted scorer. scale: idf of the terms by their weight; empty: the score of texts without a kept term."""

    def __init__(self, terms: Terms, scale: np.ndarray, examples: Examples, empty: float):
        self.terms, self.scale, self.examples, self.empty = terms, scale, examples, empty
        self.centres, self.levels = np.array([-1.0, 1.0]), np.array([PRIOR, PRIOR])
        self.known: dict[bytes, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.scale[ids]
        size = float(np.sqrt(np.sum(weights * weights)))
        return weights / size if size else weights

    def scores(self, texts: Iterable[bytes | None], evidence: bool = True) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score, and numbers and cosines of the nearest examples (None without ``evidence``), of each text."""
        texts = iter(texts)
        while some := list(islice(texts, AT_ONCE)):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            keys = [hashlib.blake2b(t or b"", digest_size=16, person=b"evidence" * evidence).digest() for t in some]
            new = {key: t for key, t in zip(keys, some, strict=True) if key not in self.known}
            counted = [self.terms.counts(t) for t in new.values()]
            found = self.examples.nearest_of([(ids, self.vector(ids, tf)) for ids, tf in counted], NEIGHBOURS)
            for key, (numbers, cosines) in zip(new, found, strict=True):
                score = float(np.interp(self.examples.vote(numbers, cosines), self.centres, self.levels)) if len(numbers) else self.empty
                self.known[key] = (score, numbers[:NEIGHBOURS].astype(np.int32), cosines[:NEIGHBOURS].copy()) if evidence else (score, None, None)
            yield from [self.known[key] for key in keys]


def held_out(doc_id: str = "doc_id") -> Column:
    """Column: the rows that labels are never learned from; a null doc_id is one."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to (term, toxic rows with it, other rows with it)."""
    with_it, without = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
            found = {t for w in set(alnum_words(text or b"")) for t in terms_of(w)}
            (with_it if toxic else without).update(found)
    terms = chain(with_it, (t for t in without if t not in with_it))
    while some := list(islice(terms, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([with_it[t] for t in some], pa.int64()), pa.array([without[t] for t in some], pa.int64())], ["term", "p", "n"])


def _likelihood(p: Column, n: Column, toxic: int, other: int) -> Column:
    """G-squared of a term's rows by label."""
    total = toxic + other

    def part(seen: Column, rows: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (rows * share))).otherwise(0.0)

    has, lacks = p + n, total - p - n
    return 2 * (part(p, has, toxic / total) + part(n, has, other / total) + part(toxic - p, lacks, toxic / total) + part(other - n, lacks, other / total))


def _frequencies(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and those of them that have each term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts, rows = np.zeros(own.size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in byte_rows(batch.column(0)):
                counts[own.distinct(text)] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(counts[seen], rows), pa.int64())], ["term", "n"])

    # a row for each term of the examples
    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (found.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(terms.size, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows that are not held out.

    labels: doc_id and the label (0 or 1); rows with a null in either are left out, a doc_id with
    several labels takes the more frequent one (toxic if even). Texts that are the same count once, by the more frequent of
    their labels (toxic if even) and the smallest doc_id.
    Document frequencies are counted over all rows of ``docs``. Without usable labels every score is PRIOR."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out())
    chosen = usable.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    kind = docs.schema["doc_id"].dataType
    sample = F.broadcast(spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], T.StructType([T.StructField("doc_id", kind), T.StructField("y", T.IntegerType())])))
    found = docs.join(sample, "doc_id").groupBy(F.xxhash64("text").alias("h"))
    read = stored(found.agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y"), F.min("text").alias("text")).drop("h"))
    totals = read.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    toxic, other = int(totals[0]), int(totals[1] - totals[0])
    terms, weak = Terms([]), np.zeros(0)
    if toxic and other:
        tallies = stored(read.select("y", "text").mapInArrow(_count_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
        n_terms = tallies.count()
        telling = (F.col("p") * other > 4 * F.col("n") * toxic) & (_likelihood(F.col("p"), F.col("n"), toxic, other) > 2 * log(n_terms + 1) + 8)
        seen = tallies.filter(F.col("p") + F.col("n") >= LEAST_EXAMPLES).select("term", telling.alias("telling"), (F.col("p") + F.col("n")).alias("often"))
        kept = seen.filter(F.col("telling") | F.startswith("term", F.lit("="))).orderBy("term").toArrow()
        terms, weak = Terms(kept.column("term").to_pylist(), kept.column("often").to_numpy()), np.where(kept.column("telling").to_numpy(), 1.0, WEAK)
    n_docs, df = _frequencies(docs, terms)
    model = Model(terms, np.log((n_docs + 1) / (df + 1)) * weak, Examples([], terms.size), PRIOR)
    labelled = stored(vectors(read, terms, keep="y"))
    bare = labelled.filter(F.size("terms") == 0).agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    model.empty = (float(bare[0]) + 2 * PRIOR) / (float(bare[1]) + 2)
    rows = labelled.filter(F.size("terms") > 0).toArrow()
    each = zip(rows.column("doc_id").to_pylist(), rows.column("y").to_pylist(), *(rows.column(c) for c in ("terms", "tfs")), strict=True)
    vector = lambda ids, tf: (ids, model.vector(ids, tf))
    model.examples = Examples([(d, y, *vector(ids.values.to_numpy(), tf.values.to_numpy().astype(float))) for d, y, ids, tf in each], terms.size)
    if rows.num_rows:
        votes = _votes(labelled.filter(F.size("terms") > 0), model).toArrow()  # one for each example
        model.centres, model.levels = isotonic(votes.column("vote").to_numpy(), votes.column("y").to_numpy())
    return model


def _votes(labelled: DataFrame, model: Model) -> DataFrame:
    """vote double and y: of each example, by the others."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, votes = zip(batch.column(0), batch.column(2), batch.column(3), strict=True), []
            while some := list(islice(rows, AT_ONCE)):
                each = [(ids.values.to_numpy(), own.vector(ids.values.to_numpy(), tf.values.to_numpy().astype(float))) for _, ids, tf in some]
                votes += [own.examples.vote(*x) for x in own.examples.nearest_of(each, NEIGHBOURS, [own.examples.number[d.as_py()] for d, _, _ in some])]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(1).cast(pa.float64())], ["vote", "y"])

    few = labelled.repartition(max(labelled.sparkSession.sparkContext.defaultParallelism, 1))
    return few.mapInArrow(run, "vote double, y double").orderBy("vote", "y")


def vectors(docs: DataFrame, terms: Terms, keep: str | None = None) -> DataFrame:
    """doc_id (and ``keep``), terms array<int> and tfs array<int> of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    chosen = docs.select("doc_id", *([keep] if keep else []), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            counts = [own.counts(t) for t in byte_rows(batch.column(batch.num_columns - 1))]
            lists = [pa.array([c[i].astype(np.int32) for c in counts], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "terms", "tfs"])

    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return chosen.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, text: str = "text", below: float | None = None) -> DataFrame:
    """All columns of ``docs`` and tox_score double, tox_evidence array<struct<doc_id string,
    cosine double, toxic int>> (nearest labelled examples). Columns with those names are replaced.
    With ``below``, only rows with a lower score, and their own columns only.

    Null and empty texts, and others without a kept term or an example that shares one, score what examples without
    terms do on average.
    Texts of any length are read whole; a row's score depends on its text alone. No rows: no rows."""
    base = docs if below is not None else docs.drop("tox_score", "tox_evidence")
    shared, spot = docs.sparkSession.sparkContext.broadcast(model), base.columns.index(text)
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids, labels = pa.array(map(str, own.examples.ids), pa.string()), pa.array(own.examples.labels.astype(np.int32))
        for batch in batches:
            found = own.scores(byte_rows(batch.column(spot)), evidence=below is None)
            if below is not None:
                yield batch.filter(pa.array([s < below for s, _, _ in found], pa.bool_()))
                continue
            found = list(found)
            numbers, cosines = (np.concatenate([np.zeros(0, of), *(x[i] for x in found)]) for i, of in ((1, np.int32), (2, float)))
            lists = pa.array(np.cumsum([0, *(len(n) for _, n, _ in found)]), pa.int32())
            evidence = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([ids.take(pa.array(numbers)), pa.array(cosines), labels.take(pa.array(numbers))], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _, _ in found], pa.float64()), evidence], [*batch.schema.names, "tox_score", "tox_evidence"])

    if below is not None:
        return base.mapInArrow(run, base.schema)
    schema = T.StructType([*base.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_evidence", T._parse_datatype_string("array<struct<doc_id:string,cosine:double,toxic:int>>"))])
    return base.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold`` by a model fitted on them and
    ``labels``, with their columns as they are."""
    return score(docs, fit(docs, labels, **options), text=options.get("text", "text"), below=threshold)
