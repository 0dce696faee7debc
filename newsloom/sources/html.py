"""Tables, titles, links and paragraphs of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"script", "style"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.paragraphs = "", 0, 0
        self.tables: list[list[list[str]]] = []
        self._open: list[list[list[str]]] = []
        self._cell: list[str] | None = None
        self._in: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.links += tag == "a"
        self.paragraphs += tag == "p"
        if tag in _VOID or tag == "title":
            self._in.append(tag)
        elif tag == "table":
            self._open.append([])
            self.tables.append(self._open[-1])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            self._cell = []
            self._open[-1][-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if self._in and self._in[-1] == tag:
            self._in.pop()
        elif tag == "table" and self._open:
            self._open.pop()
        elif tag in ("td", "th"):
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._in:
            if self._in[-1] == "title" and len(self._in) == 1:
                self.title += data
        elif self._cell is not None and self._open:
            row = self._open[-1][-1]
            row[-1] = " ".join((row[-1] + data).split())


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def summaries(pages: DataFrame) -> DataFrame:
    """page_id, title, links, paragraphs, tables of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [parse(x) for x in rows["html"]]
            yield pd.DataFrame({"page_id": rows["page_id"], "title": [p.title.strip() for p in found], "links": [p.links for p in found], "paragraphs": [p.paragraphs for p in found], "tables": [len(p.tables) for p in found]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, links long, paragraphs long, tables long")


def table(pages: DataFrame, number: int) -> DataFrame:
    """(page_id, row, cells): the n-th table (from 0) of each page that has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, cells) for i, x in zip(rows["page_id"], rows["html"], strict=True) for k, cells in enumerate((parse(x).tables[number : number + 1] or [[]])[0])]
            yield pd.DataFrame(out, columns=["page_id", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row long, cells array<string>")


def polls(cells: DataFrame, names: dict[str, int], numbers: tuple[str, ...], first: str) -> DataFrame:
    """Named columns of a table's cells; rows whose column ``first`` begins with a digit are results, the rest are not."""
    from ..functions.text import number

    rows = cells.select(*(F.try_element_at("cells", F.lit(i + 1)).alias(n) for n, i in names.items()))
    return rows.where(F.col(first).rlike("^[0-9]")).withColumns({n: number(F.col(n)) for n in numbers})
