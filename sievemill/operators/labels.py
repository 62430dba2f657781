"""Keyword classification: first match, count with ties in order, weighted ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import vocab
from . import matching


def first_match(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first label with any keyword in the text, null if none."""
    out = None
    for name, words in table:
        hit = p.contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def battery_kind(text: Column) -> Column:
    low = F.lower(text)
    fallback = F.when(low.rlike(r"(?:^|[^a-z0-9_])(?:lithium|li)(?:[^a-z0-9_]|$)"), "Li-ion/Li-metal")
    return F.coalesce(first_match(low, vocab.BATTERY_KINDS), fallback)


def with_label(rows: DataFrame, table: list[tuple[str, list[str]]], default: str, text: str = "text") -> DataFrame:
    """``label`` with the most keywords in the text (ties: the earlier in the table) and its
    ``score``; ``default`` if there is none. A null text has no keywords."""
    none = F.array_repeat(F.lit(0), len(table))
    counted = rows.withColumn("__counts", F.coalesce(matching.keyword_counts(F.lower(F.col(text)), table), none)).withColumn("score", F.array_max("__counts"))
    label = F.element_at(F.array(*[F.lit(name) for name, _ in table]), F.array_position("__counts", F.col("score")).cast("int"))
    return counted.withColumn("label", F.when(F.col("score") > 0, label).otherwise(default)).drop("__counts")


def screened(weights: list[tuple[int, Column]], length: Column, extract: int, include: int, scale: float, least: int = 50) -> tuple[Column, Column]:
    """(decision, confidence) of a weighted sum of conditions; short texts are skipped."""
    total = sum((F.when(c, w).otherwise(0) for w, c in weights), F.lit(0))
    decision = F.when(length < least, "skip").when(total >= extract, "extract").when(total >= include, "include").otherwise("skip")
    return decision, F.least(F.lit(1.0), total / F.lit(scale))


def source_weight(theory: Column, experiment: Column, default: float) -> Column:
    """The share of theory words, from 0.1 to 1, two digits; ``default`` without any word."""
    total = theory + experiment
    return F.when(total == 0, F.lit(default)).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.try_divide(theory, total))), 2))


def planned(question: Column) -> Column:
    """struct<kind, component, labels, queries, outline>: the plan of a question by rules, without a model. A blank
    question has no component, labels, queries or outline; a null one has no plan."""
    q = F.trim(question)
    blank = F.length(q) == 0
    none = F.array().cast("array<string>")
    listed = lambda words: F.when(blank, none).otherwise(F.array(*[F.lit(w) for w in words]))
    kind = F.when(p.contains_any(q, vocab.PLAN_SCREENING), "screening").otherwise("numeric")
    queries = F.when(blank, none).otherwise(F.array(q))
    plan = F.struct(
        F.when(~blank, kind).alias("kind"), first_match(q, vocab.PLAN_COMPONENTS).alias("component"), listed(vocab.PLAN_LABELS).alias("labels"), queries.alias("queries"), listed(vocab.PLAN_OUTLINE).alias("outline"),
    )
    return F.when(question.isNotNull(), plan)


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def with_routes(rows: DataFrame, text: str = "text") -> DataFrame:
    """``routes`` array<string>: the ways of synthesis that a text names, in the order of ``vocab.ROUTES``; empty for a null text."""
    named = [F.when(F.col(text).rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in vocab.ROUTES]
    return rows.withColumn("routes", F.array_compact(F.array(*named)))


def foreign_evidence(rows: DataFrame, scheme: str, source: str, text: str) -> DataFrame:
    """``is_evidence``: there is a text and a source. ``is_foreign``: it names a chemistry of another metal and none of lithium's words,
    though the scheme is of lithium. One pass over each text for both lists of words."""
    have = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    whole = F.lower(F.concat_ws(" ", F.col(source), F.col(text)))
    found = matching.keyword_counts(whole, [("foreign", vocab.FOREIGN_CHEMISTRY), ("lithium", vocab.LITHIUM_IN_EVIDENCE)])
    of_lithium = p.contains_any(F.lower(F.coalesce(scheme, F.lit(""))), vocab.LITHIUM_IN_SCHEMES)
    judged = rows.withColumn("is_evidence", have(source) & have(text)).withColumn("__found", found)
    return judged.withColumn("is_foreign", F.col("is_evidence") & of_lithium & (F.col("__found")[0] > 0) & (F.col("__found")[1] == 0)).drop("__found")
