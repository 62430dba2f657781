"""Growing lists of conditions over a stream of paragraphs: keyed state, paragraphs in their own order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import conditions
from ..operators.storage import work_dir

#: The state of transformWithState needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that papers are dealt into; a checkpoint holds for one number.
BUCKETS = 4096


class Growing(StatefulProcessor):
    """State of a bucket of papers, as JSON: each paper, its next paragraph's number, its known conditions, and paragraphs that came before
    their turn. Papers share buckets since a call or a look at the state costs as much as hundreds of paragraphs; it is read and written once for
    each bucket that has news."""

    def __init__(self, fields: list[str], share: bool):
        self.fields, self.share = fields, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.papers = handle.getValueState("papers", T.StructType([T.StructField("papers", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = self.papers.get()
        papers = {paper: (turn, [tuple(k) for k in kept], {seq: tuple(new) for seq, new in waiting}) for paper, turn, kept, waiting in json.loads(state[0])} if state else {}
        came: dict[str | None, dict[int, conditions.Fields]] = {}
        for batch in rows:
            for paper, seq, *new in batch[["key", "seq", *self.fields]].itertuples(index=False, name=None):
                paper, new = (tuple(None if x is None or x != x else x for x in xs) for xs in ((paper,), new))
                turn, _, waiting = papers.setdefault(paper[0], (0, [], {}))
                if seq >= turn and seq not in waiting:  # what came first stays; of one batch the least
                    late = came.setdefault(paper[0], {})
                    late[seq] = min(late[seq], new, key=lambda f: [(x is not None, x or "") for x in f]) if seq in late else new
        out = []
        for paper, late in came.items():
            turn, kept, waiting = papers[paper]
            waiting |= late
            while turn in waiting:
                new = waiting.pop(turn)
                at = None if all(x is None for x in new) else conditions.place(kept, new, self.share)
                out.append((paper, turn, None if at is None else at + 1, len(kept), *(new if at is None else kept[at])))
                turn += 1
            papers[paper] = turn, kept, waiting
        self.papers.update((json.dumps([(paper, turn, kept, [*waiting.items()]) for paper, (turn, kept, waiting) in papers.items()], separators=(",", ":")),))
        if out:
            frame = pd.DataFrame(out, columns=["key", "seq", "number", "known", *self.fields])
            yield frame.astype({"number": "Int32", "known": "int32"})

    def close(self) -> None:
        pass


def growing(stream: DataFrame, key: str, fields: list[str], share: bool = False) -> DataFrame:
    """key, seq, number int, known int, fields: for each paragraph of ``stream`` (key, seq long, fields), once all before it have
    come, the condition that it joins (null without any field), how many there are then, and that condition's fields. The list after
    a paragraph is the last row of each number up to it.

    seq counts a key's paragraphs from 0 without gaps; one that comes before its turn waits in the state, one that comes
    again is passed over. key is of a type that comes back from its text. The result is that of ``conditions.numbered``, however the paragraphs
    are dealt over files and batches."""
    kind = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("known", T.IntegerType()),
        *[T.StructField(f, T.StringType()) for f in fields],
    ])
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
    rows = stream.select(bucket, F.col(key).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), *fields)
    grown = rows.groupBy("bucket").transformWithStateInPandas(Growing(fields, share), kind, "Append", "None")
    return grown.withColumn("key", F.col("key").cast(stream.schema[key].dataType))


def run(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str, fields: list[str], share: bool = False, files: int = 1) -> None:
    """Works off the Parquet files that are at ``source`` and were not there before, ``files`` in a batch, and adds ``growing``'s rows to
    ``target``. A batch that is run again writes its own folder again. The session of the stream is its own, for the state store that it needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    growing(stream, key, fields, share).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(rows: DataFrame, key: str, fields: list[str], share: bool = False) -> DataFrame:
    """``rows`` (key, seq, fields), best a stored table, sent through ``run`` in three parts that hold later and earlier paragraphs of a key
    mixed, each a batch of as many files as the table has tasks, the last of them by a second run from the checkpoint."""
    spark, base = rows.sparkSession, work_dir(rows.sparkSession)
    dealt = rows.select(key, "seq", *fields).withColumn("__file", F.pmod(F.xxhash64(key, "seq"), F.lit(3)))
    files = 0
    for part in (2, 0, 1):
        dealt.filter(F.col("__file") == part).drop("__file").write.mode("append").parquet(f"{base}/in")
        files = files or len(spark.read.parquet(f"{base}/in").inputFiles())
        if part != 2:
            run(spark, f"{base}/in", rows.select(key, "seq", *fields).schema, f"{base}/out", f"{base}/state", key, fields, share, files)
    return spark.read.parquet(f"{base}/out").drop("batch").withColumnRenamed("key", key)
