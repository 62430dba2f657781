"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced k-means over a bounded sample. Every vector is put into the
list of its nearest centroid, and a vector near a boundary into those of the other centroids
that are almost as near; how near is fitted so that about REPLICATED of the vectors are.
Centroids are searched through an in-memory neighbour graph: a walk from some entries that goes on from
whatever is near enough, and has distances to the centroids that it meets only. A query reads the lists whose
centroids are within a ratio of its nearest one's distance (or of the usual such distance, if that
is larger: a query may lie on a centroid); the ratio is the least that covers COVER of the true
neighbours in the sample. Distances in the lists are exact.

Half of the sample makes the centroids, the other half the ratios. There are at most FIT_ROWS / 2 / SAMPLE_ROWS_A_LIST centroids: beyond LIST_ROWS times as many vectors the
lists grow, and are dealt into blocks, unless ``fit_rows`` grows too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that centroids are fitted on at most (the first by a hash of their id).
FIT_ROWS = 16_384
#: Vectors a list holds on average, before replication, as long as the sample gives as many centroids.
LIST_ROWS, SAMPLE_ROWS_A_LIST = 64, 16
#: Share of the vectors that are put into other lists too, and how many times as far as the nearest those lists' centroids are at most.
REPLICATED, BOUNDARY = 0.15, 1.1
#: Share of the sample's true neighbours that the pruning ratio has to cover.
COVER = 0.98
#: Edges of a centroid, where walks begin, and how many of the nearest met so far they go on from at least.
DEGREE, ENTRIES, BEAM = 16, 8, 4
CALIBRATION_QUERIES = 512
#: Vectors and queries of a list that one task compares.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 16_384
#: Neighbours that a task holds before it merges them by query.
HELD_ROWS = 400_000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, in double precision; row by row, so that they do not
    depend on what else is compared."""
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        diff = y - x[i]
        out[i] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances for choosing lists, by the inner product."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k centroids; a cluster above the mean size counts as further away, so sizes even out."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    penalty = np.zeros(len(centres))
    for _ in range(rounds):
        near = _near(x, centres)
        owner = (near + penalty).argmin(1)
        sizes = np.bincount(owner, minlength=len(centres))
        spread = float(near[np.arange(len(x)), owner].std()) or 1e-9
        penalty = np.maximum(0.0, penalty + 0.1 * spread * (sizes / (len(x) / len(centres)) - 1))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class Index:
    """Centroids, their neighbour graph, the boundary and the pruning ratio."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 42):
        self.dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        sample = sample[rng.permutation(len(sample))]
        # centroids lie nearer to the vectors that they are made of than to others: ratios are fitted on others
        made, held = (sample, sample) if len(sample) < 64 else (sample[: len(sample) // 2], sample[len(sample) // 2 :])
        k = max(1, min(-(-n // LIST_ROWS), len(made) // SAMPLE_ROWS_A_LIST))
        self.centres = balanced_centroids(made, k, seed=seed)
        k = len(self.centres)
        apart = _near(self.centres, self.centres)
        linked = np.zeros((k, k), bool)
        nearest = np.argsort(apart, axis=1)[:, 1 : DEGREE + 1]
        linked[np.repeat(np.arange(k), nearest.shape[1]), nearest.reshape(-1)] = True
        linked |= linked.T
        self.edges, self.edge_at = np.nonzero(linked)[1], np.concatenate([[0], np.cumsum(linked.sum(1))])
        entries = [int(apart.sum(1).argmin())]  # far from each other, the most central first
        while len(entries) < min(ENTRIES, k):
            entries.append(int(apart[entries].min(0).argmax()))
        self.entries = np.array(sorted(set(entries)))
        self.boundary, self.ratio, self.usual = 1.0, np.inf, 0.0
        chosen = np.arange(len(held))[:CALIBRATION_QUERIES]
        to = _near(held[chosen], self.centres)
        if k > 1:
            two = np.partition(to, 1, axis=1)[:, :2]
            self.boundary = min(BOUNDARY, float(np.quantile(two[:, 1] / np.maximum(two[:, 0], 1e-300), REPLICATED, method="lower")))
        if len(held) > 11:
            # ten neighbours among n vectors are so many, on average, within the held ones
            true = np.argsort(_near(held[chosen], held), axis=1)[:, 1 : 1 + max(1, -(-10 * len(held) // n))]
            few = np.unique(true)
            lists = dict(zip(few.tolist(), self.lists_of(held[few]), strict=True))
            reach = np.array([[to[i, lists[j]].min() for j in true[i].tolist()] for i in range(len(chosen))])
            self.usual = float(np.median(to.min(1)))
            need = (reach / np.maximum(to.min(1), max(self.usual, 1e-300))[:, None]).reshape(-1)
            self.ratio = max(1.0, float(np.quantile(need, COVER, method="higher"))) * (1 + 1e-9)

    def walk(self, x: np.ndarray, ratio: float, usual: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, centroid, distance) of the centroids that walks through the graph meet, by row. A walk goes on from
        the BEAM nearest, and from all within ``ratio`` of the nearest (or of ``usual``)."""
        k = len(self.centres)
        met = np.zeros((len(x), k), bool)
        row, centre = np.repeat(np.arange(len(x)), len(self.entries)), np.tile(self.entries, len(x))
        beam = np.full((len(x), min(BEAM, k)), np.inf)
        found = []
        while len(row):
            met[row, centre] = True
            diff = x[row] - self.centres[centre]
            far = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            found.append((row, centre, far))
            order = np.lexsort((far, row))
            row, centre, far = row[order], centre[order], far[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < beam.shape[1]
            new = np.full_like(beam, np.inf)
            new[row[best], place[best]] = far[best]
            beam = np.sort(np.concatenate([beam, new], axis=1), axis=1)[:, : beam.shape[1]]
            # the limit only falls: what is beyond it now is never gone on from
            limit = np.maximum(np.maximum(beam[:, 0], usual) * ratio, beam[:, -1])
            on = far <= limit[row]
            row, centre = row[on], centre[on]
            count = self.edge_at[centre + 1] - self.edge_at[centre]
            next_row = np.repeat(row, count)
            next_centre = self.edges[np.repeat(self.edge_at[centre] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            pairs = np.unique((next_row * k + next_centre)[~met[next_row, next_centre]])
            row, centre = pairs // k, pairs % k
        row, centre, far = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((centre, far, row))
        return row[order], centre[order], far[order]

    def _within(self, x: np.ndarray, ratio: float, usual: float) -> list[np.ndarray]:
        out = []
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            row, centre, far = self.walk(part, ratio, usual)
            cuts = np.searchsorted(row, np.arange(len(part) + 1))
            limit = np.maximum(far[cuts[:-1]], usual) * ratio
            own = far <= limit[row]
            stops = np.concatenate([[0], np.cumsum(own)])[cuts]
            out += np.split(centre[own], stops[1:-1])
        return out

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector is put into, its nearest first."""
        return self._within(x, self.boundary, 0.0)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads."""
        return self._within(x, self.ratio, self.usual)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id long and v array<double> of the vectors that take part: those with an id, finite
    components and a length of their own, of the most frequent number of components."""
    v = F.col(embedding).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _deal(rows: DataFrame, index: Index, queries: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = (own.probes if queries else own.lists_of)(_matrix(part.column(1), own.dim))
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in lists]))
                if len(take):
                    taken = pa.Table.from_batches([part]).take(take).combine_chunks().to_batches()
                    yield from (pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), *b.columns], ["list", "vec_id", "v"]) for b in taken)

    return rows.mapInArrow(run, "list int, vec_id long, v array<double>")


def _compare(dim: int, k: int):
    """Tasks of (list, row block, query block), queries first: the k nearest of each block."""

    def best(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(q[None], x)[0]
        own = np.flatnonzero(ids != query)
        for least in (k, len(own)):  # all, where rows with one id and distance leave fewer than k
            near = own[far[own] <= np.partition(far[own], least - 1)[least - 1]] if len(own) > least else own
            order = near[np.lexsort((ids[near], far[near]))]
            order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(far[order]) != 0)])[: len(order)]]
            if len(order) >= k:
                break
        return ids[order[:k]], far[order[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, queries = None, []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, id, distance; of all lists of this task
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, ids, far = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, far, q))
            q, ids, far = q[order], ids[order], far[order]
            new = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(ids) != 0) | (np.diff(far) != 0)])  # a vector may be in several lists
            q, ids, far = q[new], ids[new], far[new]
            first = np.searchsorted(q, q)
            best_of = np.arange(len(q)) - first < k
            return q[best_of], ids[best_of], far[best_of]

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)  # list, block, query block, kind
            ids, x = batch.column(4).to_numpy(zero_copy_only=False), _matrix(batch.column(5), dim)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                task, kind = tuple(marks[a][:3].tolist()), marks[a][3]
                if task != last:
                    last, queries = task, []
                if kind == 0:
                    queries += list(zip(ids[a:b].tolist(), x[a:b], strict=True))
                    continue
                for q, v in queries:
                    found = best(ids[a:b], x[a:b], q, v)
                    held.append((np.full(len(found[0]), q), *found))
                    n += len(found[0])
                    if n >= HELD_ROWS:
                        held = [merged()]
                        n = len(held[0][0])
                        if n >= HELD_ROWS // 2:  # many queries: hand on what is there
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "score"])
                            held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["query_id", "vec_id", "score"])

    return run


def lists(rows: DataFrame, queries, fit_rows: int = FIT_ROWS) -> tuple[int, DataFrame, DataFrame, dict[int, int], dict[int, int]]:
    """Components of a vector (0: no rows), postings and asked (list, vec_id, v: the vectors and the queries by list), and the rows of each by list."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").collect()
    if not sample:
        return 0, rows, rows, {}, {}
    index = Index(np.array([r["v"] for r in sample]), n)
    wide = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    postings = stored(_deal(rows.repartition(max(wide, n // 50_000)), index, queries=False))
    asked = stored(_deal(rows.filter(queries).repartition(wide), index, queries=True))
    sizes, probes = ({r["list"]: r["count"] for r in t.groupBy("list").count().collect()} for t in (postings, asked))  # a row for each centroid
    return index.dim, postings, asked, sizes, probes


def nearest(vectors: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score double: for each usable row that
    fulfils ``queries`` (a condition on vec_id) the k nearest found among all other rows.

    A vector that is null or zero, has a null or non-finite component or another number of components than
    most, or a null id, takes no part. Rows with the query's own id are left out, and several
    rows with one id and distance count once. Ties go to the smaller id. Fewer than k rows:
    all. No rows: no rows. Lists with many rows or queries are dealt into blocks, and each pair of blocks is a task."""
    rows = stored(usable(vectors, vec_id, embedding).distinct())  # a repeated row would take several of the k places
    dim, postings, asked, sizes, probes = lists(rows, queries, fit_rows)
    if not dim:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    spark = vectors.sparkSession
    blocks = spark.createDataFrame([(c, -(-sizes[c] // BLOCK_ROWS), -(-probes[c] // BLOCK_QUERIES)) for c in sorted(sizes.keys() & probes.keys())], "list int, rows int, queries int")
    hashed = F.xxhash64("vec_id", "v")
    some = F.broadcast(blocks)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = postings.join(some, "list").withColumn("a", F.pmod(hashed, F.col("rows")).cast("int")).withColumn("b", every("queries"))
    right = asked.join(some, "list").withColumn("b", F.pmod(hashed, F.col("queries")).cast("int")).withColumn("a", every("rows"))
    tasks = left.select("list", "a", "b", F.lit(1).alias("kind"), "vec_id", "v").union(right.select("list", "a", "b", F.lit(0).alias("kind"), "vec_id", "v"))
    near = tasks.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b", "kind").mapInArrow(_compare(dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
