"""Relational building blocks: as-of joins, prioritised dedup, append and upsert, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import quotient
from .storage import merged_by_sort, small, stored

#: Blocks that the rows of a key are dealt into where a key has many rows on both sides.
BLOCKS = 16


def as_of(points: DataFrame, anchors: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """``points`` with ``value`` of the last anchor at or before each point: one sort by key and
    position, no inequality join. Anchors stand before points at the same position."""
    a = anchors.select(key, position, F.lit(0).alias("__kind"), F.col(value).alias(value), F.lit(None).cast("struct<x:int>").alias("__row"))
    rows = points.select(key, position, F.lit(1).alias("__kind"), F.lit(None).cast(anchors.schema[value].dataType).alias(value), F.struct(*[F.col(c) for c in points.columns]).alias("__row"))
    both = a.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).unionByName(rows)
    before = Window.partitionBy(key).orderBy(position, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(before)).filter("__kind = 1").select("__row.*", value)


def dealt_pairs(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` with all ``names`` of their key. A key's rows are dealt into blocks, each with a copy of the key's names, so that a few
    keys with many pairs are more tasks than keys. If neither side has a row twice, no pair comes twice."""
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*rows.columns), F.lit(BLOCKS)))
    copies = names.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return dealt.join(merged_by_sort(copies), [key, "__block"]).drop("__block")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows whose keys are not there yet, once each."""
    return first_by(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows with the last incoming row of each key in their place, and new keys."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return first_by(both, keys, [F.desc("__new"), F.desc(order)]).drop("__new")


def suffixed_ids(rows: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """Repeated ids get ``|dup1``, ``|dup2`` and so on."""
    n = F.row_number().over(Window.partitionBy(id_column).orderBy(*order)) - 1
    return rows.withColumn(id_column, F.when(n > 0, F.concat(F.col(id_column).cast("string"), F.lit("|dup"), n)).otherwise(F.col(id_column).cast("string")))


def in_order(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` and their places (long, from 0) when sorted by ``order``, which has to tell them apart. They are range-sorted, so that no task sees all
    of them; only a row of totals for each partition meets in one."""
    sorted_ = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = sorted_.groupBy("__part").agg(F.count("*").alias("__size"))
    before = totals.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return sorted_.join(F.broadcast(before), "__part").withColumn(name, inside + F.col("__before")).drop("__part", "__before")


def numbered_by_first(rows: DataFrame, field: str, order: str, prefix: str = "C") -> DataFrame:
    """``number``: C001, C002 ... by first appearance of a value. Only the distinct values are ranked, by a range sort."""
    firsts = rows.groupBy(field).agg(F.min(order).alias("__first"))
    ranked = in_order(firsts, ["__first", field], "__place")
    number = F.concat(F.lit(prefix), F.lpad((F.col("__place") + 1).cast("string"), 3, "0"))
    return rows.join(ranked.select(field, number.alias("number")), field)


def budgeted(rows: DataFrame, key: str, order: list[Column], cost: Column, budget: int, least: int) -> DataFrame:
    """The first rows whose costs fit the budget; the first that does not is kept cut (``kept`` less than its
    cost) if more than ``least`` is left, and nothing after it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    c = rows.withColumn("__cost", cost).withColumn("__used", F.coalesce(F.sum("__cost").over(before), F.lit(0)))
    left = F.lit(budget) - F.col("__used")
    kept = F.when(F.col("__cost") <= left, F.col("__cost")).when(left > least, left)
    return c.withColumn("kept", kept).filter("kept is not null").drop("__cost", "__used")


def gaps(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``gap``: how much lies between each row and the end of the one before."""
    w = Window.partitionBy(key).orderBy(start, end)
    return rows.withColumn("gap", F.greatest(F.lit(0), F.col(start) - F.lag(end).over(w) - 1))


def crossing(rows: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """key, at: where the value is first below ``least`` behind a row with a value, between the two rows by a straight line. Infinite
    if both have the same value, which only the first two of a key can."""
    w = Window.partitionBy(key).orderBy(order)
    steps = rows.select(key, order, value, F.lag(order).over(w).alias("__t"), F.lag(value).over(w).alias("__v"))
    below = steps.filter((F.col(value) < least) & F.col("__v").isNotNull())
    at = F.col("__t") + quotient((F.col(order) - F.col("__t")) * (F.lit(least) - F.col("__v")), F.col(value) - F.col("__v"))
    return below.groupBy(key).agg(F.min_by(at, F.col(order)).alias("at"))


def accepted_prefix(rows: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """``status``: PASSED up to the first row that is not ok, PENDING from there."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("status", F.when(F.min(ok.cast("int")).over(before) == 1, "PASSED").otherwise("PENDING"))


def contained_names(rows: DataFrame, text: str, names: DataFrame, row_id: str, least: int = 2) -> DataFrame:
    """row_id, name of every alias (name, alias) that stands in the text, beginning with a whole word. Texts and aliases meet
    by the alias's first word, an equi-join of words only; the whole alias is then looked for in the texts that have such a word."""
    word = F.lower(F.regexp_extract("alias", r"^([A-Za-z0-9]+)", 1))
    vocabulary = names.filter(F.length("alias") >= least).withColumn("__word", word)
    words = rows.select(row_id, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)))).alias("__word"))
    asked = words.join(small(vocabulary), "__word").select(row_id, "name", "alias").distinct()
    found = rows.select(row_id, F.col(text).alias("__text")).join(asked, row_id)
    return found.filter(F.contains(F.lower("__text"), F.lower("alias"))).select(row_id, "name", "alias").distinct()


def longest_alias(rows: DataFrame, text: str, names: DataFrame, row_id: str, least: int = 2) -> DataFrame:
    """row_id, name of the longest alias in each text (ties: the first alias by text)."""
    hits = contained_names(rows, text, names, row_id, least)
    return hits.groupBy(row_id).agg(F.min_by("name", F.struct(-F.length("alias"), F.col("alias"))).alias("name"))
