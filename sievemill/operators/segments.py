"""Ordered segmentation of texts: folds over arrays, and running states over lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no long (from 0), line."""
    return docs.select(doc_id, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def running_state(rows: DataFrame, mark: Column, key: str = "doc_id", order: str = "line_no", start: str | None = None) -> DataFrame:
    """``state``: the last mark that is not null up to each row of its document."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(start)))


def _joins_previous(before: Column, part: Column) -> Column:
    """Whether a paragraph goes on with the one before it."""
    table = F.startswith(part, F.lit("<table")) | F.startswith(part, F.lit("(Continued)")) | F.startswith(F.ltrim(before), F.lit("<table"))
    goes_on = ~F.rtrim(before).rlike(r"[.!?。！？]$") | part.rlike(r"^[-*•]\s|^[0-9]+[.)]\s|^\p{Ll}")
    return ~table & ~p.is_reference_text(part) & goes_on


def stitched(docs: DataFrame, parts: str, min_length: int = 50, long: int = 7500) -> DataFrame:
    """``paragraphs``: the parts that are long enough, those over ``long`` cut at numbered
    references, each joined to the one before unless that ends a sentence or either is a table or a reference."""
    squeezed = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"[ \t]+", " "), r"\n+", " "))
    enough = F.filter(squeezed, lambda x: F.length(x) >= min_length)
    cut = F.flatten(F.transform(enough, lambda x: F.when(F.length(x) > long, F.filter(F.transform(F.split(x, r"(?=[0-9]+\.\s+[A-Z]|\[[0-9]+\])"), lambda x: F.trim(x)), lambda y: y != "")).otherwise(F.array(x))))

    def paragraphs(done: Column) -> Column:
        # what is joined to ends as its last part does, and a table stands alone: the part before tells
        begins = lambda i: (i == 0) | ~_joins_previous(F.get(done, i - 1), F.get(done, i))
        starts = F.filter(F.transform(done, lambda _, i: i), begins)
        return _once(starts, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(done, a + 1, F.coalesce(F.get(at, k + 1), F.size(done)) - a), " ")))

    return docs.withColumn("paragraphs", _once(cut, paragraphs))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not again for each element that a lambda of ``body`` sees."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``overlap`` before the end of the last; one that reaches
    the end is the last."""
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(size - overlap))).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substr(text, k * (size - overlap) + 1, F.lit(size)))


def overlapping_windows(text: Column, size: int = 7500, overlap: int = 750) -> Column:
    """Windows of at most ``size`` characters as array<string>, cut back to the last ``. `` if it is past a third.
    The next window starts ``overlap`` before the end of the one that was cut, so no text is
    lost. A text that fits, or a table, is its own window."""
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    steps = F.sequence(F.lit(0), F.ceil(F.length(text) / F.lit(float(max(1, size // 3 - overlap)))).cast("int"))

    def step(s: Column, _: Column) -> Column:
        window = F.substr(text, s["at"], F.lit(size))
        ends = s["at"] + size > F.length(text)
        back = F.length(window) - F.instr(F.reverse(window), " .")
        cut = F.when(~ends & (F.instr(F.reverse(window), " .") > 0) & (back - 1 > size // 3), F.substr(window, F.lit(1), back)).otherwise(window)
        after = F.when(ends, F.length(text) + 1).otherwise(s["at"] + F.greatest(F.length(cut) - overlap, F.lit(1)))
        return F.when(s["at"] > F.length(text), s).otherwise(F.struct(after.alias("at"), F.concat(s["out"], F.array(F.trim(cut))).alias("out")))

    whole = (F.length(text) <= size) | F.startswith(text, F.lit("<table"))
    return F.when(whole, F.array(text)).otherwise(F.filter(F.aggregate(steps, state, step)["out"], lambda x: x != ""))


def _first_parts(sizes: Column, kind: str, fits: Callable[[Column, Column], Column], joined: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the parts that begin a chunk, of the parts' sizes: a part stays in the chunk if it ``fits`` beside the chunk's
    size so far, which is then ``joined``. One pass; what is carried is a size and the places, no text."""
    start = F.struct(F.lit(None).cast(kind).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        stays = s["size"].isNotNull() & fits(s["size"], x)
        return F.struct(F.when(stays, joined(s["size"], x)).otherwise(x).alias("size"), (s["n"] + 1).alias("n"), F.when(stays, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["n"]))).alias("starts"))

    return F.aggregate(sizes, start, step, lambda s: s["starts"])


def _chunks(parts: Column, starts: Column, separator: str) -> Column:
    """The parts from each start to the next one, joined."""
    return _once(starts, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a), separator)))


def packed(parts: Column, limit: int, separator: str) -> Column:
    """Neighbouring parts joined as long as the whole stays within ``limit`` characters. Empty parts are left out."""
    between = len(separator)

    def chunks(full: Column) -> Column:
        starts = _first_parts(F.transform(full, F.length), "int", lambda size, x: size + x + between <= limit, lambda size, x: size + x + between)
        return _chunks(full, starts, separator)

    return _once(F.filter(parts, lambda x: x != ""), chunks)


def token_chunks(text: Column, keep: int = 3000, limit: int = 2000) -> Column:
    """A text of at most ``keep`` estimated tokens as it is, else its sentences packed to ``limit``: a sentence's estimate
    and that of the chunk before it are added."""
    estimate = lambda c: F.when(c["n"] > 0, F.greatest(F.lit(1), F.floor(c["zh"] * 0.6 + (c["n"] - c["zh"]) * 0.3).cast("int"))).otherwise(0)
    counts = lambda x: F.struct(F.regexp_count(x, F.lit(t.CJK)).alias("zh"), F.length(x).alias("n"))

    def chunks(full: Column) -> Column:
        both = lambda a, b: F.struct((a["zh"] + b["zh"]).alias("zh"), (a["n"] + b["n"]).alias("n"))
        starts = _first_parts(F.transform(full, counts), "struct<zh:int,n:int>", lambda a, b: estimate(a) + estimate(b) <= limit, both)
        return _chunks(full, starts, "")

    cut = _once(F.filter(F.split(text, r"(?<=[。.．])"), lambda x: x != ""), chunks)
    return F.when(t.estimated_tokens(text) <= keep, F.array(text)).otherwise(cut)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.;])\s+")


def passages(text: Column, least: int = 20, most: int = 300) -> Column:
    """Passages of ``least`` to ``most`` characters: paragraphs, longer ones by their sentences."""
    plain = F.regexp_replace(F.regexp_replace(text, "\u3000", " "), r"(?m)^#+\s*", "")
    parts = F.filter(F.transform(F.split(plain, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    cut = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(packed(F.split(x, r"(?<=[.！？;])"), most, ""))))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def clauses_with(text: Column, term: str) -> Column:
    """The sentences that mention a term, if some but not all do."""
    parts = F.filter(F.split(text, r"\."), lambda x: F.trim(x) != "")
    found = F.filter(parts, lambda x: F.contains(F.lower(x), F.lit(term)))
    return F.when(F.size(found) < F.size(parts), found).otherwise(F.array().cast("array<string>"))


def chapters(text: Column) -> Column:
    """array<struct<title, body>> at headings of one to three marks; what stands before is ``(前言)``."""
    parts = F.split(text, r"(?m)^(?=#{1,3} )")
    titled = F.transform(parts, lambda x: F.struct(F.when(x.rlike("^#{1,3} "), F.regexp_extract(x, r"^#{1,3} +([^\n]*)", 1)).otherwise("(前言)").alias("title"), F.trim(F.regexp_replace(x, r"^#{1,3} [^\n]*\n?", "")).alias("body")))
    return F.filter(titled, lambda c: c["body"] != "")


def before_references(parts: Column, zh: bool = False) -> Column:
    """The parts before a heading that begins the references."""
    words = "references|bibliography" + ("|参考文献" if zh else "")
    at = F.array_position(F.transform(parts, lambda x: F.lower(F.trim(x)).rlike(rf"^#*\s*(?:{words})\s*$")), True)
    return F.when(at > 0, F.slice(parts, 1, F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(parts)


def body_start(parts: Column, least: int = 80) -> Column:
    """The parts from the first one of over ``least`` characters that is no introduction heading."""
    first = F.array_position(F.transform(parts, lambda x: (F.length(x) > least) & ~F.lower(x).rlike(r"^#*\s*(?:[0-9.]*\s*)?introduction\s*$")), True)
    return F.when(first > 0, F.slice(parts, first.cast("int"), F.size(parts))).otherwise(parts)


def heading_level_state(rows: DataFrame, skip: Column, level: Column, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """``skipped``: whether an open heading (level 1 to 6, null for other rows) is one to skip."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, flags = rows.withColumn("__level", level), []
    for n in range(1, 7):
        mark = F.when(F.col("__level") == n, F.when(skip, 1).otherwise(0)).when(F.col("__level") < n, 0)
        flags.append(F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)))
    return out.withColumn("skipped", F.greatest(*flags) == 1).drop("__level")


def without_details(rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Lines outside ``<details>`` blocks: a running depth of opened minus closed ones."""
    opens, closes = F.col("line").rlike(r"(?i)^\s*<details"), F.col("line").rlike(r"(?i)^\s*</details>\s*$")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__depth", depth).filter((F.col("__depth") <= 0) & ~opens & ~closes).drop("__depth")


def without_supplement_head(parts: Column, within: int = 10) -> Column:
    """Lines from the first other heading on, if one of the first lines begins supporting information."""
    low = F.transform(parts, lambda x: F.lower(F.trim(x)))
    start = F.array_position(F.transform(F.slice(low, 1, within), lambda x: F.startswith(x, F.lit("# supporting information"))), True)
    heading = F.transform(low, lambda x, i: (i >= start) & x.rlike(r"^#") & ~x.rlike(r"^#+\s*(?:supporting (?:information|figures|tables)|figure |table )"))
    at = F.array_position(heading, True)
    return F.when((start > 0) & (at > 0), F.slice(parts, at.cast("int"), F.size(parts))).otherwise(parts)


def with_equations_and_captions(parts: Column) -> Column:
    """Paragraphs with each ``$$`` block joined to the one before, and each table caption to the table after."""
    line = F.lit("\n")

    def add(done: Column, part: Column) -> Column:
        last, s = F.element_at(done, -1), F.trim(part)
        equation = F.startswith(s, F.lit("$$")) & F.endswith(s, F.lit("$$"))
        table = F.trim(last).rlike(r"(?i)^(?:table|表)\s*[s]?[0-9]") & ~F.contains(last, line) & p.is_table_line(s)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, line, part)))
        return F.when(F.size(done) == 0, F.array(part)).when(equation | table, joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def routed(rows: DataFrame) -> DataFrame:
    """``kind`` of each line: table, figure, meta or text."""
    line = F.col("line")
    kind = F.when(p.is_table_line(line), "table").when(p.is_caption(line) | F.trim(line).rlike(r"^!\["), "figure").when(p.is_noise(line), "meta").otherwise("text")
    return rows.withColumn("kind", kind)


def table_contexts(rows: DataFrame, reach: int = 8, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first line of each table with its nearest caption among the ``reach`` lines before, and the lines around it."""
    line, w = F.col("line"), Window.partitionBy(key).orderBy(order)
    is_table = p.is_table_line(line)
    caption = F.last(F.when(p.is_caption(line), F.trim(line)), ignorenulls=True).over(w.rowsBetween(-reach, -1))
    around = F.concat_ws("\n", F.lag("line", 1).over(w), F.lead("line", 1).over(w))
    first = is_table & ~F.coalesce(F.lag(is_table).over(w), F.lit(False))
    return rows.withColumns({"caption": caption, "around": around, "__first": first}).filter("__first").drop("__first")


def table_blocks(docs: DataFrame, look_back: int = 800, around: int = 400, shown: int = 300, same: int = 200) -> DataFrame:
    """doc_id, start (characters before the table), block: each pipe table of a document (doc_id, text) as text for extraction: its caption, nearby text,
    headers, rows as ``header = cell`` (as cells where their number differs), and the cells of each column.

    The caption is the last one within ``look_back`` characters before the table, else the last line there that speaks of a table. Blocks of a
    document that begin with the same ``same`` characters, white space squeezed, count once, the first. Documents of one doc_id count as one."""
    texts = docs.filter("text is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    running, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    piped, rule = F.contains("line", F.lit("|")), F.col("line").rlike(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
    marked = lines(texts).withColumn("__at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    marked = marked.withColumns({"__breaks": F.sum(F.when(~piped, 1).otherwise(0)).over(running), "__rule": rule, "__head": F.when(rule, F.struct(F.lag("line").over(w).alias("line"), F.lag("__at").over(w).alias("start")))})
    opened = F.last(F.when(F.col("__rule") & F.contains("__head.line", F.lit("|")), F.struct("__head", "__breaks")), ignorenulls=True).over(running)
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    body = marked.withColumn("__table", opened).filter(piped & ~F.col("__rule") & (F.col("__table.__breaks") == F.col("__breaks")) & (F.col("__at") > F.col("__table.__head.start")))
    tables = body.groupBy("doc_id", F.col("__table.__head.start").alias("start"), F.col("__table.__head.line").alias("head")).agg(F.array_sort(F.collect_list(F.struct("line_no", cells(F.col("line")).alias("cells")))).alias("rows"))
    t_ = tables.join(texts, "doc_id").withColumns({"heads": cells(F.col("head")), "rows": F.transform("rows", lambda r: r["cells"])})
    start, text = F.col("start").cast("int"), F.col("text")
    back = F.substr(text, F.greatest(start - look_back, F.lit(0)) + 1, F.least(start, F.lit(look_back)))
    captions = F.regexp_extract_all(back, F.lit(r"(?i)(?:table|表)\s+(?:S[0-9]+[.\s]|[0-9]+[.\s])[^\n]{0,200}"), F.lit(0))
    speaking = F.filter(F.split(back, "\n"), lambda x: F.contains(F.lower(x), F.lit("table")))
    caption = F.trim(F.coalesce(F.try_element_at(captions, F.lit(-1)), F.try_element_at(speaking, F.lit(-1)), F.lit("")))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    left, right = strip(F.substr(text, F.greatest(start - around, F.lit(0)) + 1, F.least(start, F.lit(around)))), strip(F.substr(text, start + 1, F.lit(around)))
    near = strip(F.concat(F.when(left != "", F.concat(left, F.lit("\n"))).otherwise(""), F.lit("[TABLE at pos "), start, F.lit("]\n"), right))
    joined = lambda xs: F.array_join(xs, "; ")
    pairs = lambda r: F.when(F.size(r) == F.size("heads"), joined(F.zip_with("heads", r, lambda h, c: F.concat(h, F.lit(" = "), c)))).otherwise(joined(r))
    numbered = F.transform("rows", lambda r, i: F.concat(F.lit("Row "), i + 1, F.lit(": "), pairs(r)))
    columns = F.transform("heads", lambda h, i: F.concat(F.lit("  "), h, F.lit(": "), joined(F.transform(F.filter("rows", lambda r: F.size(r) > i), lambda r: F.get(r, i)))))
    head = F.array(F.lit("TABLE DATA BLOCK"), F.when(caption != "", F.concat(F.lit("Caption or title: "), caption)), F.concat(F.lit("Nearby text: "), F.substr(near, F.lit(1), F.lit(shown))), F.concat(F.lit("Headers: "), joined(F.col("heads"))), F.lit("Rows:"))
    block = F.array_join(F.array_compact(F.concat(head, numbered, F.array(F.lit("Column data:")), columns)), "\n")
    blocks = t_.select("doc_id", "start", block.alias("block"))
    sign = F.regexp_replace(F.substr(F.col("block"), F.lit(1), F.lit(same)), r"\s+", " ")
    return blocks.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", sign).orderBy("start"))).filter("__n = 1").drop("__n")
