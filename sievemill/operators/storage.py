"""Tables between steps, in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast.
SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """With a broadcast hint if it is as small as that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merged_by_sort(df: DataFrame) -> DataFrame:
    """With a hint that joins sort and merge it. Spark's estimate of a table takes what explode makes for as many rows as went in, and would
    broadcast millions of them, through the driver."""
    return df.hint("merge")


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset one of this machine, which a cluster's
    executors could not reach: it raises there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sievemill-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: what uses it more than once does not compute it again."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
