"""Folders of .xlsx workbooks: the first sheet of each, parsed in parallel.

Spark finds and hands out the files; a task turns one workbook into rows with
the standard library's zip and XML readers.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trunkwatch.sources.tables import clean_header

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# fixed values: built-in number formats that show dates
_DATE_FORMATS = {14, 15, 16, 17, 22}
_BATCH = 5000


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == sheet.get(_LINK):
            return "xl/" + link.get("Target").removeprefix("/xl/")
    raise ValueError("workbook without a sheet")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in items]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
              if re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode")).lower())}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, style in enumerate(styles if styles is not None else [])
            if int(style.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _cell(cell, strings: list[str], date_styles: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in date_styles:
        day = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))
        return day.isoformat(sep=" ") if day.time() != dt.time() else day.date().isoformat()
    return value


def _position(reference: str) -> int:
    column = 0
    for letter in reference:
        if not letter.isalpha():
            break
        column = column * 26 + ord(letter.upper()) - 64
    return column - 1


def sheet_rows(content: bytes, path: str = "") -> Iterator[dict[int, str | None]]:
    """Rows of the first sheet as position -> text, the header first; an empty sheet has none.

    The sheet is read as a stream, so that its XML tree is never held as a whole. A
    file that is no workbook, or a broken one, is an error that names it.
    """
    try:
        yield from _rows(content)
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, EOFError) as error:
        raise ValueError(f"unreadable workbook {path}: {error}") from error


def _rows(content: bytes) -> Iterator[dict[int, str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, date_styles = _strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {}
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _position(cell.get("r")) if cell.get("r") else i
                    cells[at] = _cell(cell, strings, date_styles)
                row.clear()
                if any(v is not None for v in cells.values()):
                    yield cells


def workbook_columns(books: DataFrame) -> DataFrame:
    """Each column name that occurs, with the number of workbooks that have it."""
    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                names = next(sheet_rows(content, path), {}).values()
                yield pd.DataFrame({"name": [clean_header(n) for n in names if n]}, dtype="object")

    return (books.select("path", "content").mapInPandas(headers, "name string")
            .groupBy("name").agg(F.count("*").alias("books")))


def workbook_rows(books: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``(path, content)`` workbooks as text in the columns of ``schema``,
    placed by their header; columns that a workbook lacks are null."""
    wanted = schema.fieldNames()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                sheet = sheet_rows(content, path)
                header = {clean_header(n): at for at, n in next(sheet, {}).items() if n}
                taken: list[list[str | None]] = []
                for cells in sheet:
                    taken.append([cells.get(header.get(name, -1)) for name in wanted])
                    if len(taken) == _BATCH:
                        yield pd.DataFrame(taken, columns=wanted, dtype="object")
                        taken = []
                yield pd.DataFrame(taken, columns=wanted, dtype="object")

    texts = ", ".join(f"`{name}` string" for name in wanted)
    return books.select("path", "content").mapInPandas(rows, texts)


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All workbooks at ``path`` as text columns. A declared column is left out
    when some workbook lacks it, for the required-column check to see. A workbook
    whose first sheet is empty lacks all of them; a file of no bytes is not read."""
    books = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
             .select("path", "content"))
    total = books.select("path").count()
    present = {r["name"] for r in workbook_columns(books).where(
        F.col("name").isin(schema.fieldNames()) & (F.col("books") == total)).collect()}
    return workbook_rows(books, schema).select([f for f in schema.fieldNames() if f in present])
