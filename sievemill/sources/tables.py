"""Tables inside documents: pipe tables as column expressions, HTML tables by a parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pipe_rows(text: Column) -> Column:
    """array<map<header, cell>> of the rows under the first header and rule of a pipe table."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    is_rule = F.transform(lines, lambda x: x.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$"))
    at = F.array_position(is_rule, True).cast("int")
    head = cells(F.get(lines, at - 2))
    body = F.slice(lines, at + 1, F.size(lines))
    padded = lambda x: F.slice(F.concat(cells(x), F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))
    return F.when(at > 1, F.transform(body, lambda x: F.map_from_arrays(head, padded(x)))).otherwise(F.array().cast("array<map<string,string>>"))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str | None) -> list[dict[str, str]]:
    """Rows of all tables of a page; the first row of a table is its header."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for table in parser.tables:
        rows = [r for r in table if r]
        for r in rows[1:]:
            out.append({(rows[0][i] if i < len(rows[0]) and rows[0][i] else f"col{i}"): c for i, c in enumerate(r)})
    return out


def html_rows(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, row_no, cells map: the rows of every table of every page."""
    key = pages.schema[page_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, r) for i, h in zip(frame[page_id], frame[html], strict=True) for k, r in enumerate(parse_tables(h))]
            yield pd.DataFrame(rows, columns=[page_id, "row_no", "cells"])

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {key}, row_no int, cells map<string,string>")


def html_cells(html: Column) -> Column:
    """How many cells the tables of a page have."""
    return F.regexp_count(html, F.lit(r"(?i)<t[dh][\s>]"))
