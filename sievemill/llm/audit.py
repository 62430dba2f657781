"""Audit of filters in all orders: a trie of permutations whose nodes with the same filters applied are one state.

The states are visited depth first. Each holds the survivors of its filters as a persisted DataFrame of small rows, filtered from its
parent's, and is visited once, whatever order leads to it; what each further filter removes from it is counted and written.
There are 2^k states for k filters, and at most k of them are persisted at a time."""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: So many filters have 5,040 orders; each part's rows are seven times as many.
MOST_FILTERS = 7
#: Parts that the rows of one key are dealt into.
SALTS = 16


def audit(rows: DataFrame, fails: dict[str, Column], part: Column, losses: dict[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step int, kept, removed, redundant, unique_fails, lost_<name> of ``losses``, shapley (all long).

    fails: condition under which a row fails the filter of that one-letter name (null: it passes). losses: conditions to be counted among
    what a step removes. One row for each part, order of all filters and step, zeros included. redundant: rows that fail
    the step's filter and went before. unique_fails: rows that fail this filter only. shapley: what the filter removes, summed over all
    orders. Repeated rows count each; no rows give no rows."""
    losses, names = losses or {}, list(fails)
    if not 0 < len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"one to {MOST_FILTERS} filters of one letter each")
    flags = {f"fails{i}": F.coalesce(fails[n], F.lit(False)) for i, n in enumerate(names)}
    counted = {f"lost{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(losses.values())}
    survivors = stored(rows.select(part.alias("part"), *[c.alias(n) for n, c in (flags | counted).items()]))
    edges = _removals(survivors, len(names), len(losses))
    return _by_order(edges, names, list(losses))


def _removals(start: DataFrame, k: int, n_losses: int) -> DataFrame:
    """part, mask, filter, kept, removed, losses array<long>: what filter number ``filter`` removes from the survivors of the
    filters of the bits ``mask``. Parts without survivors have no row."""
    path, seen = f"{shared_dir(start.sparkSession)}/audit-{uuid.uuid4().hex}", set()

    def counts(survivors: DataFrame, mask: int) -> DataFrame:
        found = []
        for f in range(k):
            if not mask >> f & 1:
                goes = F.col(f"fails{f}")
                found += [F.count_if(goes).alias(f"removed{f}"), *[F.count_if(goes & F.col(f"lost{i}")).alias(f"loss{f}_{i}") for i in range(n_losses)]]
        totals = survivors.groupBy("part").agg(F.count("*").alias("here"), *found)
        edge = lambda f: F.struct(
            F.lit(f).alias("filter"), (F.col("here") - F.col(f"removed{f}")).alias("kept"), F.col(f"removed{f}").alias("removed"),
            F.array(*[F.col(f"loss{f}_{i}") for i in range(n_losses)]).cast("array<bigint>").alias("losses"),
        )
        return totals.select("part", F.explode(F.array(*[edge(f) for f in range(k) if not mask >> f & 1])).alias("e")).select("part", "e.*")

    def visit(survivors: DataFrame, mask: int) -> None:
        seen.add(mask)
        survivors.persist()
        try:
            counts(survivors, mask).write.parquet(f"{path}/mask={mask}")
            for f in range(k):
                after = mask | 1 << f
                if after not in seen and after != (1 << k) - 1:
                    visit(survivors.filter(f"not fails{f}"), after)
        finally:
            survivors.unpersist()

    visit(start, 0)
    return start.sparkSession.read.schema("part string, filter int, kept long, removed long, losses array<bigint>, mask int").parquet(path)


def _by_order(edges: DataFrame, names: list[str], losses: list[str]) -> DataFrame:
    k = len(names)
    weight = [math.factorial(n) * math.factorial(k - 1 - n) for n in range(k)]
    size = F.bit_count("mask")
    orders_through = F.element_at(F.array(*[F.lit(w).cast("long") for w in weight]), size + 1)
    only = F.expr(f"{(1 << k) - 1} ^ shiftleft(1, filter)")
    of_filter = edges.groupBy("part", "filter").agg(
        F.max(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails"), F.coalesce(F.max(F.when(F.col("mask") == only, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders_through).alias("shapley"),
    )
    steps = [
        ("".join(names[i] for i in order), at + 1, sum(1 << i for i in order[:at]), order[at])
        for order in itertools.permutations(range(k)) for at in range(k)
    ]
    paths = F.broadcast(edges.sparkSession.createDataFrame(steps, "filter_order string, step int, mask int, filter int"))
    zero = F.lit(0).cast("long")
    lost = [F.coalesce(F.get("losses", F.lit(i)), zero).alias(f"lost_{n}") for i, n in enumerate(losses)]
    return of_filter.join(paths, "filter").join(edges, ["part", "filter", "mask"], "left").select(
        "part", "filter_order", "step", F.coalesce("kept", zero).alias("kept"), F.coalesce("removed", zero).alias("removed"),
        (F.col("fails") - F.coalesce("removed", zero)).alias("redundant"), "unique_fails", *lost, "shapley",
    )


def repeats_smaller(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """``rows`` and ``repeats`` boolean: whether a row with a smaller ``id_column`` has the same ``key`` (never null). A null id is
    neither smaller nor larger; rows of one id do not repeat each other.

    Only keys of several rows are looked up. The rows of a key are dealt over SALTS parts, each of which meets the key's smallest id."""
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(id_column).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    first = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__own", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, (F.col(key) == F.col("__key")) & (F.col("__own") == F.col("__salt")), "left")
    return joined.withColumn("repeats", F.coalesce(F.col(id_column) > F.col("__first"), F.lit(False))).select(*rows.columns, "repeats")
