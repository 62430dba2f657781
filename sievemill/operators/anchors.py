"""Anchors of a design in a markdown answer: the formula of the first-ranked row, the main way of synthesis, and its calcination.

Texts are taken apart into lines and clauses, candidates are found in each of them, and the first by rule and then by place stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from . import segments

# Patterns of table rules, headers, first ranks, tags of main and other ways, negations, and of heating that is no calcination.
RULE = r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"
RANK_HEADER = r"(?i)排名|排序|推荐序|推荐位|优先级|推荐档|档位|rank|priority|tier"
FORMULA_HEADER = r"(?i)名义化学式|化学式|配方|正极(?:化学式|材料)?|formula|composition|candidate"
OPTION_HEADER = r"(?i)方案|类型|候选|推荐|级别|candidate|option|序号"
FIRST_RANK = r"(?i)^(?:#?\s*1(?![0-9.])|rank\s*[=:#]?\s*1(?![0-9.])|no\.?\s*1(?![0-9.])|top\s*1(?![0-9.])|第\s*[1一]\s*[位名]?|首选|主推荐|主推|主选|优先推荐)(?:$|[\s（(\[,，:：\-—].*)"
FORMULA = r"(?:Li|Na)[0-9.]*(?:[A-Z][a-z]?[0-9.]*){2,}"
MAIN = r"(?i)(?:合成)?路线\s*A|Route\s*A|主推荐|主推|主路线|首选"
OTHER = r"(?i)(?:合成)?路线\s*[BC]|Route\s*[BC]|对照(?:路线|组|方法)?|备选(?:路线|方法)?|参比(?:路线)?"
NOT_THIS = r"(?:不建议|不应|不推荐|避免|非|并非)"
FIRING = r"(?i)(?:主烧|主煅烧|最终烧结|高温烧结|煅烧|烧结|calcination|sintering)\s*(?:温度|条件)?[:：为于]?\s*(?:at\s+)?([0-9]{3,4}(?:\.[0-9]+)?)(?:\s*[~–—\-到至]\s*([0-9]{3,4}(?:\.[0-9]+)?))?\s*°?\s*[C℃](?!\s*/\s*(?:min|h|s))(?:\s*(?:[/,，、]|for|下|保温|维持|恒温|持续)*\s*([0-9]+(?:\.[0-9]+)?)(?:\s*[~–—\-到至]\s*([0-9]+(?:\.[0-9]+)?))?\s*(?:h\b|小时))?"
NO_FIRING = r"(?i)预烧|预煅烧|pre-?calc|烘干|干燥|除水|退火|升温速率|速率"


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[*`]+", "")))


def _place(cells: Column, pattern: str) -> Column:
    """Place (from 0) of the first cell that the pattern is in, null without any."""
    at = F.array_position(F.transform(cells, lambda c: c.rlike(pattern)), True)
    return F.when(at > 0, at.cast("int") - 1)


def first_ranked(lines: DataFrame) -> DataFrame:
    """doc_id, formula: of the first table row of rank one that has a formula, in its formula's column before others. lines: doc_id, line_no, line.

    A table ranks if it has a header of rank, or one of formulas and a first header of options; its first column then holds the rank."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    is_rule, is_row = F.col("line").rlike(RULE), F.contains("line", F.lit("|"))
    marked = lines.withColumns({"__rule": is_rule, "__head": F.when(is_rule, F.lag("line").over(w)), "__break": F.when(~is_row, 1).otherwise(0)})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__breaks", F.sum("__break").over(running))
    marked = marked.withColumn("__table", F.last(F.when(F.col("__rule") & F.contains("__head", F.lit("|")), F.struct(F.col("__head").alias("head"), F.col("__breaks").alias("breaks"))), ignorenulls=True).over(running))
    rows = marked.filter(is_row & ~F.col("__rule") & (F.col("__table.breaks") == F.col("__breaks"))).select("doc_id", "line_no", _cells(F.col("line")).alias("cells"), _cells(F.col("__table.head")).alias("heads"))
    rank, formula = _place(F.col("heads"), RANK_HEADER), _place(F.col("heads"), FORMULA_HEADER)
    at = F.coalesce(rank, F.when(formula.isNotNull() & F.get("heads", F.lit(0)).rlike(OPTION_HEADER), F.lit(0)))
    ordered = F.concat(F.array(F.get("cells", formula)), F.col("cells"))
    found = F.filter(F.transform(ordered, lambda c: F.regexp_extract(c, FORMULA, 0)), lambda x: x != "")
    rows = rows.filter(F.get("cells", at).rlike(FIRST_RANK)).withColumn("formula", F.get(found, F.lit(0))).filter("formula is not null")
    return rows.groupBy("doc_id").agg(F.min_by("formula", "line_no").alias("formula"))


def clauses(lines: DataFrame) -> DataFrame:
    """doc_id, clause_no, clause, scope: main from a clause with a main tag on, other from one with another tag on, in order; null before any. A
    heading or a rule of dashes ends a scope."""
    parts = lines.select("doc_id", "line_no", F.posexplode(F.split("line", "[；;。]")).alias("part_no", "clause"))
    order = Window.partitionBy("doc_id").orderBy("line_no", "part_no")
    parts = parts.withColumn("clause_no", F.row_number().over(order))
    ends = (F.col("part_no") == 0) & F.col("clause").rlike(r"^\s*(?:#{1,4}\s|-{3,}\s*$|\*{3,}\s*$|={3,}\s*$)")
    mark = F.when(F.col("clause").rlike(OTHER), "other").when(F.col("clause").rlike(MAIN) & ~F.col("clause").rlike(NOT_THIS), "main").when(ends, "none")
    scope = F.nullif(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("none"))
    return parts.select("doc_id", "clause_no", "clause", mark.alias("mark"), scope.alias("scope"))


def main_route(parts: DataFrame) -> DataFrame:
    """doc_id, route: that of the first clause with a main tag and a way; else the first way that no clause of another tag names; else the
    first named at all. Of several in a clause the one that begins first. A way right behind a negation is not named."""
    found = []
    for i, (name, pattern) in enumerate(vocab.ROUTES):
        place = F.regexp_instr(F.col("clause"), F.lit(f"(?i){pattern}"))
        before = F.substr(F.col("clause"), F.lit(1), F.greatest(place - 1, F.lit(0)))
        found.append(F.when((place > 0) & ~before.rlike(NOT_THIS + r"[^\n；;。]{0,12}$"), F.struct(place.alias("place"), F.lit(i).alias("n"), F.lit(name).alias("route"))))
    first = F.array_min(F.array_compact(F.array(*found)))
    tier = F.when(F.col("mark") == "main", 0).when(F.coalesce(F.col("mark"), F.lit("")) != "other", 1).otherwise(2)
    named = parts.withColumn("first", first).filter("first is not null")
    return named.groupBy("doc_id").agg(F.min_by("first.route", F.struct(tier.alias("tier"), F.col("clause_no"))).alias("route"))


def calcination(parts: DataFrame) -> DataFrame:
    """doc_id, celsius_low, celsius_high, hours_low, hours_high: of the first clause that tells a temperature behind a word of firing and none of
    drying, pre-firing, annealing or rates before it; of the main way's clauses before others, and never of another way's. Null hours if there are none."""
    get = lambda g: F.nullif(F.regexp_extract("clause", FIRING, g), F.lit("")).cast("double")
    place = F.regexp_instr(F.col("clause"), F.lit(FIRING))
    before = F.substr(F.col("clause"), F.lit(1), F.greatest(place - 1, F.lit(0)))
    told = parts.filter((place > 0) & ~before.rlike(NO_FIRING) & (F.coalesce("scope", F.lit("")) != "other"))
    values = F.struct(get(1).alias("celsius_low"), F.coalesce(get(2), get(1)).alias("celsius_high"), get(3).alias("hours_low"), F.coalesce(get(4), get(3)).alias("hours_high"))
    order = F.struct(F.when(F.col("scope") == "main", 0).otherwise(1).alias("tier"), F.col("clause_no"))
    return told.groupBy("doc_id").agg(F.min_by(values, order).alias("v")).select("doc_id", "v.*")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, formula, route, celsius_low, celsius_high, hours_low, hours_high of each document (doc_id, text); nulls for what it does not tell.
    Documents of one doc_id count as one."""
    lines = segments.lines(docs.filter("text is not null").dropDuplicates(["doc_id"]))
    parts = clauses(lines)
    found = [first_ranked(lines), main_route(parts), calcination(parts)]
    return reduce(lambda a, b: a.join(b, "doc_id", "left"), found, docs.select("doc_id").distinct())
