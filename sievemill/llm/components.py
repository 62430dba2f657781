"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots_of(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Roots of ``nodes`` in the forest ``parent``."""
    at = parent[nodes]
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Join the trees of ``a[i]`` and ``b[i]``; the smaller root stays. True if any changed."""
    changed = False
    while True:
        x, y = roots_of(parent, a), roots_of(parent, b)
        apart = x != y
        if not apart.any():
            return changed
        changed = True
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        parent[np.maximum(x, y)] = np.minimum(x, y)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as the stars of their components, block by block."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(len(nodes))
        unite(parent, index[: len(a)], index[len(a) :])
        root = roots_of(parent, parent)
        out = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges: a long, b long, none null. Returns node long, label long: every node of an edge
    between two nodes, and the smallest node of its component.

    Large star: each node sends its larger neighbours to its smallest one. Small star: each
    node sends its smaller neighbours, and itself, to the smallest of them. They end in one star a
    component. Smallest neighbours are stored tables, so that a hub's edges are dealt over
    several tasks by the adaptive skew join."""
    spark = edges.sparkSession
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contract, "a long, b long").distinct())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
