"""Line dedup by site-relative frequency: within a host, the share of its pages that contain a
line; lines above a ratio are boilerplate and are dropped from that host's pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: A line is boilerplate on more than this share of its host's pages ...
RATIO = 0.02
#: ... and on at least this many of them.
MIN_PAGES = 5
#: Boilerplate lines of all hosts together up to which they are broadcast.
BROADCAST_LINES = 200_000
#: Parts that a host's pages are dealt into where boilerplate has to be shuffled to them.
SALTS = 64


def line_key(line: Column) -> Column:
    """A line's identity: XXH64 of its text without spaces, tabs and carriage returns at the ends."""
    return F.xxhash64(F.trim(F.translate(line, "\t\r", "  ")))


def _lines(text: str) -> Column:
    return F.split(F.col(f"`{text}`"), "\n", -1)


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`")), F.lit("n"))


def _is_blank(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\r", "  "))) == 0


def boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """host (as hashed key ``__host``), line long (``line_key``), pages long, ratio double.

    Each page counts once for a line, however often it holds it; with ``copies_once`` all pages of
    a host that have one text are one page, so that copies do not make their own body boilerplate.
    Only hashes are shuffled, summed on the map side first; a host's lines spread over all tasks. A
    host has fewer than (lines a page) / ratio such lines, whatever its size."""
    key = _host_key(host).alias("__host")
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: ~_is_blank(x)), line_key))
    each = pages.select(key, keys.alias("lines"))
    if copies_once:
        each = pages.select(key, keys.alias("lines"), F.xxhash64(text).alias("copy")).distinct()
    counts = each.select("__host", F.explode("lines").alias("line")).groupBy("__host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = each.groupBy("__host").agg(F.count("*").alias("total"))
    return counts.join(totals, "__host").filter(F.col("pages") > F.col("total") * F.lit(ratio)).select("__host", "line", "pages", (F.col("pages") / F.col("total")).alias("ratio"))


def drop_boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES,
    copies_once: bool = False,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and line_total, line_dropped long.
    Columns with those names are replaced; all other columns stay as they are.

    Columns of any names are carried. Blank lines stay and are never boilerplate. Texts of any length are read whole. A null text stays null with 0 lines; one whose
    lines all go becomes empty. Null hosts are a host of their own. Repeated pages count each,
    unless ``copies_once``. No rows: no rows. The texts are not shuffled unless boilerplate passes ``broadcast_lines``."""
    found = stored(boilerplate(pages, host, text, ratio, min_pages, copies_once))
    base = pages.drop("line_total", "line_dropped")
    key, salt, lines, drop = (free_name(base.columns, c) for c in "ksld")
    sets = found.groupBy("__host").agg(F.collect_list("line").alias(drop)).withColumnRenamed("__host", key)
    marked = base.withColumn(key, _host_key(host))
    if found.count() <= broadcast_lines:
        marked = marked.join(F.broadcast(sets), key, "left")
    else:
        salted = marked.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)))
        marked = salted.join(sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [key, salt], "left")
    each = F.transform(_lines(text), lambda x: F.struct(x.alias("line"), F.when(~_is_blank(x), line_key(x)).alias("key")))
    none = F.array().cast("array<bigint>")

    def left(found: Column) -> Column:
        # a page's own boilerplate first: a look-up in that, not in all of the host's for each line
        own = F.coalesce(F.array_intersect(F.transform(found, lambda x: x["key"]), F.col(drop)), none)
        kept = _once(own, lambda known: F.filter(found, lambda x: x["key"].isNull() | ~F.array_contains(known, x["key"])))
        return F.struct(F.size(found).alias("total"), F.transform(kept, lambda x: x["line"]).alias("lines"))

    marked = marked.withColumn(lines, F.when(F.col(f"`{text}`").isNotNull(), _once(each, left)))
    rest = [F.array_join(F.col(f"`{lines}`.lines"), "\n").alias(c) if c == text else F.col(f"`{c}`") for c in base.columns]
    total = F.coalesce(F.col(f"`{lines}`.total"), F.lit(0)).cast("long")
    stay = F.coalesce(F.size(F.col(f"`{lines}`.lines")), F.lit(0)).cast("long")
    return marked.select(*rest, total.alias("line_total"), F.least(total - stay, total).alias("line_dropped"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not again for each element that a lambda of ``body`` sees."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
