"""Column functions for documents, chunks and vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from gaugeflow.functions.topics import as_col

# Accepted uploads and chunk sizes.
UPLOAD_EXTENSIONS = [".pdf", ".docx", ".txt", ".md"]
UPLOAD_LIMIT_BYTES = 10 * 1024 * 1024
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", " "]
#: Rows whose texts and chunks a worker holds at the same time beside its input.
SPLIT_ROWS = 256


def file_extension(filename) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    name = F.regexp_extract(as_col(filename), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def upload_error(filename, size) -> Column:
    """Reason why an upload is rejected, NULL if it is accepted."""
    ext = file_extension(filename)
    return F.when(~ext.isin(UPLOAD_EXTENSIONS), F.concat(F.lit("Unsupported file type: "), ext)).when(
        as_col(size) > UPLOAD_LIMIT_BYTES, F.lit("File too large")
    )


def document_id(project, filename, equipment, sensor) -> Column:
    parts = [F.coalesce(as_col(c), F.lit("")) for c in (project, filename, equipment, sensor)]
    return F.md5(F.concat_ws("_", *parts))


def chunk_id(doc_id, index) -> Column:
    return F.concat(as_col(doc_id), F.lit("_chunk_"), as_col(index).cast("string"))


def affiliation_level(equipment, sensor) -> Column:
    def filled(c) -> Column:
        return F.coalesce(as_col(c), F.lit("")) != ""

    return F.when(filled(sensor), F.lit("sensor")).when(filled(equipment), F.lit("equipment")).otherwise(F.lit("general"))


def level_priority(level) -> Column:
    level = as_col(level)
    return F.when(level == "sensor", 0).when(level == "equipment", 1).otherwise(2)


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    a, b = as_col(a).cast("array<double>"), as_col(b).cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def similarity(distance) -> Column:
    distance = as_col(distance)
    return F.when(distance >= 0, 1 / (1 + distance)).otherwise(F.lit(0.0))


# --- row-local text helpers -------------------------------------------------


class _Open:
    """A table that has not ended: its current row and the texts of its current cell, None where none is open."""

    def __init__(self):
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def end_cell(self):
        if self.cell is not None:
            # a line break would end the row of the markdown table
            self.row.append(re.sub(r"\s*\n\s*", " ", "".join(self.cell).strip()))
            self.cell = None

    def end_row(self) -> list[str]:
        self.end_cell()
        row, self.row = self.row, None
        return row or []

    def begin_row(self):
        self.row = []

    def begin_cell(self):
        if self.row is None:
            self.begin_row()
        self.end_cell()
        self.cell = []


class _TableReader(HTMLParser):
    """The rows of all tables in a text, by a stack of open tables.

    End tags may be left out: a cell ends with the next cell or row, a row with
    the next row or section, and everything with its table or the text. A
    table inside a cell gives rows of its own, before the row it stands in.
    """

    SECTIONS = ("thead", "tbody", "tfoot", "caption", "colgroup")

    def __init__(self):
        super().__init__()
        self.open = [_Open()]
        self.rows: list[list[str]] = []

    def _finish_row(self):
        if row := self.open[-1].end_row():
            self.rows.append(row)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(_Open())
        elif tag in self.SECTIONS:
            self._finish_row()
        elif tag == "tr":
            self._finish_row()
            self.open[-1].begin_row()
        elif tag in ("td", "th"):
            self.open[-1].begin_cell()
        elif tag == "br" and self.open[-1].cell is not None:
            self.open[-1].cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open[-1].end_cell()
        elif tag == "tr" or tag in self.SECTIONS:
            self._finish_row()
        elif tag == "table":
            self._finish_row()
            if len(self.open) > 1:
                self.open.pop()

    def handle_data(self, data):
        if self.open[-1].cell is not None:
            self.open[-1].cell.append(data)

    def close(self):
        super().close()
        while self.open:
            self._finish_row()
            self.open.pop()


def markdown_table(html: str) -> str:
    """Rows of the tables in a text as a markdown table; a text without rows stays as it is."""
    reader = _TableReader()
    reader.feed(html)
    reader.close()
    if not reader.rows:
        return html
    head, *body = reader.rows
    printed = [head, ["---"] * len(head), *body]
    return "\n".join(f"| {' | '.join(row)} |" for row in printed)


@F.pandas_udf(T.StringType())
def _markdown_tables(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else markdown_table(t))


def tables_to_markdown(html) -> Column:
    """Tables as markdown. Only texts with the start of a row or cell travel to Python."""
    html = as_col(html)
    return F.coalesce(_markdown_tables(F.when(html.rlike("(?i)<t[rdh][\\s>/]"), html)), html)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters that share up to ``overlap`` characters.

    Splits at the coarsest separator that occurs, goes one level finer inside
    pieces that are still too long, and packs neighbouring pieces together.
    """

    def pieces(part: str, level: int) -> Iterator[str]:
        while level < len(SEPARATORS) and SEPARATORS[level] not in part:
            level += 1
        if level == len(SEPARATORS):
            step = max(1, min(overlap, size // 4))
            yield from (part[i : i + step] for i in range(0, len(part), step))
            return
        sep = SEPARATORS[level]
        for i, piece in enumerate(part.split(sep)):
            piece = piece if i == 0 else sep + piece
            if len(piece) > size:
                yield from pieces(piece, level + 1)
            elif piece:
                yield piece

    chunks: list[str] = []
    window: list[str] = []
    length = 0
    for piece in pieces(text, 0):
        if window and length + len(piece) > size:
            chunks.append("".join(window).strip())
            kept = 0
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window[kept])
                kept += 1
                if kept == len(window):
                    break
            window = window[kept:]
        window.append(piece)
        length += len(piece)
    chunks.append("".join(window).strip())
    return [c for c in chunks if c]


def chunk_lists(batches: Iterator[pa.Array], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[pa.Array]:
    """Chunks of every text, SPLIT_ROWS rows at a time: only these are Python objects, and they leave before the next ones come."""
    for batch in batches:
        for i in range(0, len(batch), SPLIT_ROWS):
            chunks = [None if t is None else split_text(t, size, overlap) for t in batch.slice(i, SPLIT_ROWS).to_pylist()]
            yield pa.array(chunks, pa.list_(pa.string()))


def chunk_texts(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of the chunks of a text, without white space at their ends; NULL and blank texts have none.

    Texts up to ``size`` characters are one chunk and stay in the JVM, by the
    same rule as longer ones.
    """
    text = as_col(text)
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from chunk_lists(batches, size, overlap)

    return F.coalesce(split(F.when(F.length(text) > size, text)), F.filter(F.array(bare), lambda t: t != ""))
