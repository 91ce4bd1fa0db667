"""Worksheets of .xlsx files as raw tables, read from Spark's binary files with the standard library."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text_table import Table

#: Ranges of the built-in number formats of dates and times.
DATE_FORMATS = ((14, 22), (27, 36), (45, 47), (50, 58))
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> dict[str, str]:
    """Name -> part of each worksheet, in book order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        names = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        return {s.get("name"): "xl/" + links[s.get(_REL)].lstrip("/").removeprefix("xl/") for s in names}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of the cell styles that show a number as a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    dated = {n for n, code in own.items() if re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code.lower()))}
    dated |= {n for low, high in DATE_FORMATS for n in range(low, high + 1) if n not in own}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dated}


def sheet_rows(data: bytes, part: str) -> Iterator[tuple[int, list[str]]]:
    """(physical row, cells) of rows that are not empty; booleans are 1 and 0, error cells and dates are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = _date_styles(book)
        with book.open(part) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.iter(f"{_MAIN}c"):
                    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "e":
                        raise ValueError(f"{c.get('r')}: an error cell")
                    if kind == "d" or kind == "n" and value is not None and int(c.get("s", 0)) in dates:
                        raise ValueError(f"{c.get('r')}: a date or a time is no number")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    else:
                        text = "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
                    cells[_column(c.get("r"))] = text.strip()
                if any(cells.values()):
                    yield int(row.get("r")), [cells.get(i, "") for i in range(max(cells) + 1)]
                row.clear()


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, has_header: bool = True) -> Table:
    """A sheet as a raw table, parsed by the task that reads the book; the driver sees the sheets' names and the first row."""
    book = spark.read.format("binaryFile").load(path).select("content")

    def names(batches):
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(list(column)) for column in zip(*sheets(content.as_py()).items())], ["name", "part"])

    known = {r["name"]: r["part"] for r in book.mapInArrow(names, "name string, part string").collect()}
    if sheet is None and len(known) > 1:
        raise ValueError(f"{path}: name one of the sheets {', '.join(known)}")
    sheet = next(iter(known)) if sheet is None else sheet
    if sheet not in known:
        raise ValueError(f"{path}: no sheet {sheet}; it has {', '.join(known)}")
    part = known[sheet]

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                found = sheet_rows(content.as_py(), part)
                while held := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], ["row_no", "cells"])

    cells = book.mapInArrow(rows, "row_no long, cells array<string>")
    first = cells.orderBy("row_no").first()
    if first is None:
        raise ValueError(f"{path}: no rows")
    wide = cells.agg(F.max(F.size("cells"))).first()[0]
    body = cells.select("row_no", F.concat("cells", F.array_repeat(F.lit(""), F.lit(wide) - F.size("cells"))).alias("cells"))
    if not has_header:
        return Table(body, None, path, None, ",", sheet, wide)
    header = first["cells"] + [""] * (wide - len(first["cells"]))
    return Table(body.where(F.col("row_no") > first["row_no"]), header, path, first["row_no"], ",", sheet, wide)
