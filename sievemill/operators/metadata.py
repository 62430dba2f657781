"""Document metadata: title, authors, year, DOI; lookups under several keys; backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small

# Headings that are no title.
NOT_TITLES = ["abstract", "introduction", "keywords", "highlights", "references", "graphical abstract", "article info", "contents", "supporting information", "acknowledg", "received", "table of contents", "research article", "communication"]


def title(text: Column) -> Column:
    """The first level-one heading that is a title, null if none."""
    heads = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike("^# ")), lambda x: F.trim(F.substring(x, 3, 1 << 30))), lambda x: (x != ""))
    noise = "^(?:" + "|".join(NOT_TITLES) + ")"
    return F.get(F.filter(heads, lambda x: ~F.lower(x).rlike(noise)), F.lit(0))


def authors(text: Column) -> Column:
    """The first line after the title that lists names."""
    rest = F.split(F.regexp_extract(text, r"(?ms)^# [^\n]*\n(.*)", 1), "\n")
    return F.get(F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: F.length(x).between(11, 299) & ~x.rlike("(?i)@|http|university|abstract") & (F.contains(x, F.lit(",")) | F.contains(x, F.lit(" and ")))), F.lit(0))


def year(text: Column) -> Column:
    """The year after ``Published:``, else after ``Cite This:``, else the first of this century; null
    if none."""
    get = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(get(r"Published:[^\n]*?(20[0-9]{2})"), get(r"Cite This:[^\n]*?(20[0-9]{2})"), get(r"(?:^|[^0-9])(20[0-9][0-9])(?:[^0-9]|$)"))


def doi(text: Column) -> Column:
    """The first DOI, one broken by spaces after its slash included; null if none."""
    found = F.nullif(F.regexp_extract(F.regexp_replace(text, r"(10\.[0-9]{4,}/)\s+", "$1"), r"(10\.[0-9]{4,}/[a-zA-Z0-9._()/%\-]+)", 1), F.lit(""))
    return F.regexp_replace(found, r"[.,;:)]+$", "")


def first_match(rows: DataFrame, keys: str, index: DataFrame, row_id: str, value: str) -> DataFrame:
    """row_id and ``value`` of the first key that ``index`` (key, value) has; null if none. One
    equi-join over the exploded keys."""
    each = rows.select(row_id, F.posexplode(keys).alias("__at", "key"))
    found = each.join(index, "key", "left")
    return found.groupBy(row_id).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias(value))


def backfilled(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``value``, where missing the first one of the same key in ``order``."""
    whole = Window.partitionBy(key)
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).over(whole)
    return rows.withColumn(value, F.coalesce(value, first))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows, and of those with each column."""
    return rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"with_{c}") for c in columns])


def longest_contained(rows: DataFrame, text: str, names: DataFrame, row_id: str, most: int = 4) -> DataFrame:
    """row_id, name: the longest names (a small table) in each text, up to ``most``."""
    hits = rows.join(small(names), F.contains(F.lower(rows[text]), F.lower(names["name"])))
    rank = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc(F.length("name")), "name"))
    return hits.withColumn("__rank", rank).filter(F.col("__rank") <= most).select(row_id, "name")
