"""Shared pieces of the training-data operators: storage of intermediate tables,
tokenisation of whole texts as UTF-8 bytes, and row access in Arrow batches."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regular expression of a word: a run of anything but space and \x09-\x0D.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z lower-cased, everything else as it is.
ASCII_LOWER = bytes.maketrans(_UPPER, _LOWER)


def _alnum_table() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if c.isupper():
            table[b] = ord(c.lower())
        elif not c.isalnum():
            table[b] = 32
    return bytes(table)


#: A-Z lower-cased and every ASCII byte outside 0-9 and a-z turned into a space.
ALNUM_LOWER = _alnum_table()


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (space and \\x09-\\x0D) after lower-casing A-Z."""
    return text.translate(ASCII_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of digits, lower-cased letters and non-ASCII characters."""
    return text.translate(ALNUM_LOWER).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor and the driver can reach.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, as in local tests, a folder of
    this machine is set; a cluster's executors could not reach that, so it raises there."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sievemill-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no recomputation of what stands before. The folder is the cluster's to clear."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemill-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], stem: str = "x") -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    return next(n for n in (f"__{stem}{i}" for i in itertools.count()) if n not in taken)


def in_order(df: DataFrame, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` and rank long (places before a row when all rows are sorted by the columns ``order``,
    nulls first), and for each column x of ``sums`` x_before: its sum over those places, null as 0.

    ``order`` has to tell all rows apart. The rows are range-sorted, so that none of the tasks sees
    all of them; only a row of totals for each partition meets in one."""
    placed = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    value = {c: F.coalesce(F.col(c), F.lit(0)) for c in sums}
    totals = placed.groupBy("part").agg(F.count("*").alias("rank_p"), *[F.sum(v).alias(f"{c}_p") for c, v in value.items()])
    totals = totals.select("part", *[F.coalesce(F.sum(f"{c}_p").over(parts), F.lit(0)).alias(f"{c}_p") for c in ("rank", *sums)])
    inside = placed.withColumns({"rank": F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)), **{f"{c}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in value.items()}})
    added = {"rank": F.col("rank") + F.col("rank_p"), **{f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_p") for c in sums}}
    return inside.join(F.broadcast(totals), "part").withColumns(added).select(*df.columns, *added)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from byte_rows(chunk)
        return
    column = column.cast(pa.large_string()) if pa.types.is_string_view(column.type) else column
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, int)
    data = column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = None if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    bounds = offsets.tolist()
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else bytes(view[bounds[i] : bounds[i + 1]])


def word_count(text: str = "text"):
    """Column: number of words of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def small_rows(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
