"""Whitening of embeddings: moments merged pairwise by Chan's formula, eigenvectors on the driver, a second pass that verifies.

The entries c of a vector count as whole numbers x = floor(1024 c) + 100000, so that sums are exact. A task holds a batch of vectors
and moments of one dimension by another; the driver holds the latter only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of at least this size count as non-finite: the whole numbers of a double end there.
TOO_LARGE = 2.0**42
#: A component with less variance than this share of the largest has none.
NO_VARIANCE = 1e-12
#: Partitions merge in a tree of this depth.
DEPTH = 3


@dataclass
class Moments:
    """Count, sums and centred scatter (sum of outer products of differences from the mean). Sums of whole numbers are Python's own, without bounds."""

    n: int
    sums: Any
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula. The difference of the means is taken exactly where the sums are."""
        n = self.n + other.n
        delta = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], np.float64)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n)))


def _whole_moments(x: np.ndarray) -> Moments:
    """Of rows of int64."""
    sums = [int(a) * (1 << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), strict=True)]
    centred = _centred(x, len(x), sums)
    return Moments(len(x), sums, centred.T @ centred)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, the whole part subtracted as whole numbers."""
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _real_moments(x: np.ndarray) -> Moments:
    centred = x - x.mean(0)
    return Moments(len(x), x.sum(0).tolist(), centred.T @ centred)


def _moments(rows: DataFrame, of: Callable[[pa.RecordBatch], Moments], number: type) -> Moments:
    """The moments of ``of(batch)``'s rows: one a partition, merged in a tree. Sums are of type ``number``. There has to be a row."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                found = part if found is None else found.merged(part)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.n]), pa.array([[repr(s) for s in found.sums]]), pa.array([found.scatter.tobytes()], pa.binary())], ["n", "sums", "scatter"])

    parts = rows.mapInArrow(local, "n long, sums array<string>, scatter binary").rdd
    parts = parts.map(lambda r: Moments(r.n, [number(s) for s in r.sums], np.frombuffer(r.scatter).reshape(len(r.sums), -1)))
    return parts.treeReduce(Moments.merged, DEPTH)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, all of them present, finite and below TOO_LARGE."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= TOO_LARGE))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~bad)


@dataclass
class Whitening:
    """n, exact sums, eigenvalues by falling size, components as columns; ``identity_error`` once verified (None without any variance)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    vector: str
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        """Share of the variance of each component; null if there is none at all."""
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows x - S / n on the components over the root of their eigenvalues."""
        return _centred(x, self.n, self.sums) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exact; null beyond a long."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole, strict=True)]
        near = x - np.array(whole, np.int64)
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * near - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = (((self.n * near.astype(object)) - np.array(rest, object)) ** 2).sum(1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors, verified by a second pass. None if there are none.

    A covariance needs one dimension: it is that of most vectors (a tie: the longer), and others take no part.
    Repeated rows count each. At most as many components as dimensions; a component without variance (of constant or too few
    vectors) whitens to null and takes no part in the identity error. Equal eigenvalues have any basis of their space; the entry
    largest by size of a component is positive."""
    sound = usable(rows, vector).select(F.col(f"`{vector}`").alias("v"))
    usual = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return None
    sound = sound.filter(F.size("v") == usual.d)

    def whole(batch: pa.RecordBatch) -> Moments:
        return _whole_moments(_matrix(batch.column(0)))

    moments = _moments(sound, whole, int)
    covariance = moments.scatter / moments.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    values = np.where(values > NO_VARIANCE * max(values[0], 1e-300), values, 0.0)
    model = Whitening(moments.n, moments.sums, values, vectors, float(np.trace(covariance)), vector)
    varied = int((values > 0).sum())
    if varied:
        narrow = Whitening(model.n, model.sums, values[:varied], vectors[:, :varied], model.trace, vector)

        def real(batch: pa.RecordBatch) -> Moments:
            return _real_moments(narrow.whitened(_matrix(batch.column(0))))

        check = _moments(sound, real, float)
        model.identity_error = float(np.abs(check.scatter / check.n - np.eye(varied)).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_column: str) -> DataFrame:
    """id_column, deviation long, whitened array<double> of each usable row (null entries where a component has no variance)."""
    d, values = len(model.sums), model.eigenvalues
    varied = int((values > 0).sum())
    narrow = Whitening(model.n, model.sums, values[:varied], model.components[:, :varied], model.trace, model.vector)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            white = np.full((len(x), len(values)), np.nan)
            white[:, :varied] = narrow.whitened(x)
            flat = pa.array(white.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), lists], [id_column, "deviation", "whitened"])

    kind = T.StructType([rows.schema[id_column], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    sound = usable(rows, model.vector)
    return sound.filter(F.size(F.col(f"`{model.vector}`")) == d).select(F.col(f"`{id_column}`"), F.col(f"`{model.vector}`")).mapInArrow(apply, kind)
