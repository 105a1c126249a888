"""Visible blocks of HTML read element by element: what is hidden, nested or left open decides where each piece of text goes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.blocks import BLOCK_TAGS, HIDDEN_TAGS

_BLOCKS = re.compile(BLOCK_TAGS)
_SPACES = re.compile(r"\s+")


def _plain(pieces: list[str]) -> str:
    """The pieces as one line; references that were escaped more than once are read to the end."""
    text = " ".join(pieces)
    while (read := html.unescape(text)) != text:
        text = read
    return _SPACES.sub(" ", text).strip()


class _Page(HTMLParser):
    """Open table elements as a path; text belongs to the innermost open cell, otherwise to the running paragraph."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.hidden = 0
        self.path: list[str] = []
        self.paragraph: list[str] = []
        self.cells: list[list[str]] = []

    def _inner(self) -> list[str]:
        """What is open within the innermost table."""
        tables = [i for i, tag in enumerate(self.path) if tag == "table"]
        return self.path[tables[-1] + 1 :] if tables else []

    def _leave(self, tag: str) -> None:
        while self.path.pop() != tag:
            pass

    def _end_paragraph(self) -> None:
        self.blocks.append(("text", _plain(self.paragraph)))
        self.paragraph = []

    def _end_row(self) -> None:
        self.blocks.append(("table_row", " | ".join(filter(None, map(_plain, self.cells)))))
        self.cells = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        if self.hidden:
            return
        within = self._inner()
        if tag == "table":
            self._end_paragraph()
            self.path.append("table")
        elif tag == "tr" and "table" in self.path:
            self._end_paragraph()
            self._end_row()
            if "tr" in within:
                self._leave("tr")
            self.path.append("tr")
        elif tag in ("td", "th") and "tr" in within:
            if "cell" in within:
                self._leave("cell")
            self.path.append("cell")
            self.cells.append([])
        elif _BLOCKS.fullmatch(tag) and self.path[-1:] != ["cell"]:
            self._end_paragraph()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(self.hidden - 1, 0)
            return
        if self.hidden:
            return
        within = self._inner()
        if tag in ("td", "th") and "cell" in within:
            self._leave("cell")
        elif tag == "tr" and "tr" in within:
            self._leave("tr")
            self._end_row()
        elif tag == "table" and "table" in self.path:
            self._end_row()
            self._leave("table")
            self._end_paragraph()
        elif _BLOCKS.fullmatch(tag) and self.path[-1:] != ["cell"]:
            self._end_paragraph()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.path[-1:] == ["cell"]:
            self.cells = self.cells or [[]]
            self.cells[-1].append(data)
        else:
            self.paragraph.append(data)

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        self._end_row()
        self._end_paragraph()
        return [b for b in self.blocks if b[1]]


def read(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's visible blocks in order."""
    parser = _Page()
    parser.feed(page or "")
    return parser.finish()


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for at in range(batch.num_rows):
            found = [{"kind": k, "text": t} for k, t in read(batch.column(1)[at].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([found], shape)], ["page_id", "blocks"])


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, text): the visible blocks of each page (page_id, html), text or table_row.

    A row's cells are joined by `` | ``; a block that repeats the one before it
    is left out.  Hidden elements may nest.  Cells and rows that are never
    closed end with the next one, the table or the page.  A row of a table
    within a cell ends the row around it, which goes on as another row after
    that table, so no shown text is lost.  Text of a row outside its cells comes
    after the row.  A page without html, or without shown text, gives no block;
    a page is read whole, whatever its length.
    """
    key = pages.schema["page_id"].dataType.simpleString()
    listed = pages.select("page_id", "html").mapInArrow(_read_batches, f"page_id {key}, blocks array<struct<kind: string, text: string>>")
    kept = F.filter("blocks", lambda x, i: (i == 0) | (F.get(F.col("blocks"), i - 1) != x))
    return listed.select("page_id", F.posexplode(kept).alias("seq", "b")).select("page_id", "seq", "b.kind", "b.text")
