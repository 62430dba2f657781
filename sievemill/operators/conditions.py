"""Test conditions of a paper, in order: each joins the first known one that it is compatible with, which gains the fields
that it lacked; else it is a new one. In a batch and over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fields = tuple[str | None, ...]


def fits(known: Fields, new: Fields, share: bool) -> bool:
    """Equal wherever both have a field; with ``share`` at least one field has to be there on both sides."""
    met = False
    for a, b in zip(known, new, strict=True):
        if a is not None and b is not None:
            if a != b:
                return False
            met = True
    return met or not share


def place(kept: list[Fields], new: Fields, share: bool) -> int:
    """The place in ``kept`` that ``new`` joins or takes; ``kept`` is changed."""
    for at, known in enumerate(kept):
        if fits(known, new, share):
            kept[at] = tuple(b if a is None else a for a, b in zip(known, new, strict=True))
            return at
    kept.append(new)
    return len(kept) - 1


def _any_field(fields: list[str]) -> Column:
    return F.coalesce(*[F.col(f) for f in fields]).isNotNull()


def numbered(rows: DataFrame, key: str, order: str, fields: list[str], share: bool = False) -> DataFrame:
    """``rows`` and number int: the condition of its ``key`` that a row belongs to, from 1 by first appearance; null for a row
    without any field. fields: strings, null where absent. Rows of one order are taken by their fields.

    Without ``share`` a condition that comes again joins what it joined first and adds nothing, whatever came between: those before it
    that it does not fit never lose a field. So only the first of each different condition of a key is folded. With ``share`` an earlier one may
    have gained a field in common, so each order counts. The fold is a stream over sorted rows that holds the known
    conditions of one key; all rows get their number by a join."""
    own = [order] if share else []
    firsts = rows.filter(_any_field(fields)).groupBy(key, *own, *fields).agg(F.min(order).alias("__first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, current = [], object()
        for batch in batches:
            keys, numbers = batch.column(0).to_pylist(), []
            for k, *new in zip(keys, *[c.to_pylist() for c in batch.columns[2:]], strict=True):
                if k != current:
                    kept, current = [], k
                numbers.append(place(kept, tuple(new), share) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], ["__key", "__at", *[f"__f{i}" for i in range(len(fields))], "number"])

    kind = T.StructType([T.StructField("__key", rows.schema[key].dataType), T.StructField("__at", rows.schema[order].dataType), *[T.StructField(f"__f{i}", T.StringType()) for i in range(len(fields))], T.StructField("number", T.IntegerType())])
    sorted_ = firsts.repartition(key).sortWithinPartitions(key, "__first", *fields).select(key, "__first", *fields)
    known = sorted_.mapInArrow(fold, kind)
    on = F.col(key).eqNullSafe(F.col("__key"))
    if share:
        on = on & F.col(order).eqNullSafe(F.col("__at"))
    for i, f in enumerate(fields):
        on = on & F.col(f).eqNullSafe(F.col(f"__f{i}"))
    return rows.join(known, on, "left").select(*rows.columns, "number")


def merged(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, number, members long, fields: the conditions of ``numbered`` rows. A field is that of the first row that has it."""
    have = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(order, f))).alias(f) for f in fields]
    return rows.filter("number is not null").groupBy(key, "number").agg(F.count("*").alias("members"), *have)
