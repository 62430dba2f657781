"""Incremental processing with Structured Streaming: new files only, checkpoint after each batch,
keys seen before are skipped."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.storage import work_dir


def append_new(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A streaming query that appends to the table at ``path`` the rows whose keys it lacks (a table that such
    queries write). Each batch is written under the name of its stream and number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = relational.first_by(batch, keys, [F.col(order)])
        name = f"s{hashlib.md5(checkpoint.encode()).hexdigest()[:8]}-{number}"
        for existing in _others(spark, path, name):
            fresh = fresh.join(existing.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={name}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _others(spark: SparkSession, path: str, name: str) -> list[DataFrame]:
    """Rows that are at ``path`` already, of this stream or another, but for those of the batch itself."""
    try:
        return [spark.read.parquet(path).filter(F.col("batch") != name)]
    except AnalysisException:  # nothing yet
        return []


def replayed(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` sent through ``append_new`` as two files that overlap: each key arrives once."""
    base = work_dir(spark)
    rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows.filter(F.pmod(F.xxhash64(key), F.lit(2)) == 0).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = append_new(stream, f"{base}/out", f"{base}/state", [key], key)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def folded(spark: SparkSession, events: DataFrame) -> DataFrame:
    """user_id, steps, high, last_event: a running fold per user over a stream of files, updated batch by
    batch in the state store and written as the last state of each user."""
    base = work_dir(spark)
    events.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    state = stream.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("value") > 50).alias("high"), F.max("event_id").alias("last_event"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return relational.first_by(spark.read.parquet(f"{base}/out"), ["user_id"], [F.desc("batch")]).select("user_id", "steps", "high", "last_event")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Beyond parity: counts in tumbling event-time windows, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Beyond parity: sessions of each key, ended by a gap."""
    return rows.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))
