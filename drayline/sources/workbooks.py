"""XLSX workbooks (S11): one task per workbook, many workbooks per job.

A workbook is a small zip archive, so the unit of parallelism is the file.
Only the active sheet is read; row 1 is the header.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.sources.files import RECORD, SURPLUS

# XML namespaces, built-in number formats that show dates, and
# the day serial numbers count from.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_DAY_ZERO = datetime(1899, 12, 30)

CELL_ROWS = "path string, row long, header array<string>, cells array<string>"


def _active_sheet(archive: zipfile.ZipFile) -> str:
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    index = int(view.get("activeTab", "0")) if view is not None else 0
    sheet = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")[index]
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)
    }
    formats = root.find(f"{_MAIN}cellXfs")
    return {
        i
        for i, f in enumerate(formats if formats is not None else ())
        if int(f.get("numFmtId", "0")) in _DATE_FORMATS | own
    }


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "e", "d"):
        return value
    if int(cell.get("s", "0")) in dates:
        moment = _DAY_ZERO + timedelta(days=float(value))
        return str(moment.replace(microsecond=0) + timedelta(seconds=round(moment.microsecond / 1e6)))
    return value


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared, dates = _shared_texts(archive), _date_styles(archive)
        with archive.open(_active_sheet(archive)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                    number = _column_number(cell.get("r")) if cell.get("r") else place
                    cells += [None] * (number + 1 - len(cells))
                    cells[number] = _cell_text(cell, shared, dates)
                yield cells
                row.clear()


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _sheet_rows(content)
            names = next(rows, None)
            if names is None:
                continue
            header = [f"col_{i}" if n is None else n for i, n in enumerate(names)]
            out: list[tuple] = []
            for number, cells in enumerate(rows):
                cells += [None] * (len(header) - len(cells))
                out.append((path, number, header, cells))
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=["path", "row", "header", "cells"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["path", "row", "header", "cells"])


def workbook_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows of all workbooks with their header, as arrays of text cells; there may be more cells than the header has."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInPandas(_read_batches, CELL_ROWS)


def read_workbooks(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of workbooks as text columns; a header a workbook lacks is NULL.

    Rows with a filled cell beyond the header are left out; ``workbook_surplus`` has them.
    """
    rows, columns = _rows_and_columns(spark, paths, columns)
    return rows.where(_surplus_cell().isNull()).select(*_named_cells(columns))


def workbook_surplus(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of workbooks with a filled cell beyond the header: the first one as ``SURPLUS``, all as ``RECORD``."""
    rows, columns = _rows_and_columns(spark, paths, columns)
    rows = rows.where(_surplus_cell().isNotNull())
    return rows.select(*_named_cells(columns), _surplus_cell().alias(SURPLUS), F.to_json("cells").alias(RECORD))


def _surplus_cell() -> Column:
    beyond = F.slice("cells", F.size("header") + 1, F.size("cells") + 1)
    return F.get(F.filter(beyond, lambda c: c.isNotNull() & (c != "")), F.lit(0))


def _rows_and_columns(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None
) -> tuple[DataFrame, Sequence[str]]:
    rows = workbook_rows(spark, paths)
    if columns is None:
        names = rows.select(F.posexplode("header").alias("place", "name"))
        names = names.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name")
        columns = [r.name for r in names.collect()]
    return rows, columns


def _named_cells(columns: Sequence[str]) -> list[Column]:
    return [F.get("cells", F.array_position("header", F.lit(c)).cast("int") - 1).alias(c) for c in columns]
