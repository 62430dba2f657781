"""From documents to a training mix: each stage works on what the one before has kept, which
is written as Parquet and read again.

Every stage takes any further columns along, whatever their names, reads texts whole, and gives no rows for no rows. Rows
with a null doc_id, source or text stay unless their stage says otherwise; repeated rows are rows of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from sievemill.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples call toxic go. A null or empty text scores what examples without terms do; equal
    texts score alike."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many documents of a source go; n_chars, if there, follows the text. Exact copies count once: SimHash drops
    them later, and needs the text of the one that stays. A null text stays null, a null source is one of its own.
    Columns named line_total or line_dropped are replaced by those counts."""
    cleaned = line_dedup.drop_boilerplate(docs, host="source", copies_once=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by their fingerprints, the one with the smallest doc_id stays; of its repeated rows one.
    Null and empty texts are alike, and one of them stays. Rows with a null doc_id stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go. Null and empty texts stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each time a document is taken, in order of its position. Documents without words are
    never taken. Added: position, words (columns of documents with those names are replaced)."""
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs))
    return mixing.training_order(mixed).drop("mix_size", "mix_source_size", "mix_target", "mix_taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL has no fingerprints of words and no exact nearest examples.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
