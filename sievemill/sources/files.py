"""Readers and writers of documents and fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import relational
from ..operators.storage import stored

COMPONENTS = ("anode", "cathode", "electrolyte")


def read_documents(spark: SparkSession, path: str, components: tuple[str, ...] = COMPONENTS, skip: str = "Solid_State") -> DataFrame:
    """source_file, component, doi, text of the markdown files below ``path`` that lie in a component's folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("wholetext", True).text(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.contains("path", F.lit(skip)))
    component = F.regexp_extract("path", "/(" + "|".join(components) + ")/", 1)
    return rows.withColumn("component", component).filter("component <> ''").select(t.source_path(F.col("path")).alias("source_file"), "component", t.name_doi(F.regexp_extract("path", r"([^/]+)$", 1)).alias("doi"), "text")


def unprocessed(files: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Files (component, doi, ...) that are not in ``done``, one for each component and doi; the first ``limit``
    if that is given."""
    fresh = relational.new_rows(files, done, ["component", "doi"], [F.col("source_file")])
    return fresh.orderBy("source_file").limit(limit) if limit else fresh


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Pretty-printed JSON arrays, by a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def write_facts(rows: DataFrame, path: str, by: str = "doi") -> None:
    """A fact table as CSV, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_snapshot(rows: DataFrame, path: str, stamp: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={stamp}")


def insert_absent(rows: DataFrame, path: str, keys: list[str], order: list[Column] | None = None) -> int:
    """Append the rows whose keys the table at ``path`` lacks; how many there were. Of several rows of a key the first in
    ``order`` (left out: by all columns)."""
    existing = rows.sparkSession.read.parquet(path)
    fresh = stored(relational.new_rows(rows, existing, keys, order or [F.col(c) for c in rows.columns]))
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def read_sheet(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """A spreadsheet saved as CSV: for each name of ``wanted`` the first column whose header has its text (without regard
    to case), null where none has; all strings."""
    sheet = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    found = {n: next((c for c in sheet.columns if part.lower() in c.lower()), None) for n, part in wanted.items()}
    return sheet.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()])


def append_trace(events: DataFrame, path: str, seq: str = "seq") -> None:
    """Events as JSON lines, added to what is at ``path``; ``seq`` numbers them."""
    events.withColumnRenamed(seq, "seq").write.mode("append").json(path)


def write_json(rows: DataFrame, path: str, by: str) -> None:
    """A pretty-printed JSON array for each value of ``by``, in a folder of its own."""
    columns = [c for c in rows.columns if c != by]
    whole = rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"pretty": "true"}).alias("value"))
    whole.repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def latest_rows(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The last n events of a JSON-lines trace by ``seq``."""
    return spark.read.schema(schema).json(path).orderBy(F.desc("seq")).limit(n)
