"""Write rows as small workbooks, the input of the workbook query."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame

_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<bookViews><workbookView activeTab="0"/></bookViews><sheets>'
    '<sheet name="data" sheetId="1" r:id="rId1"/><sheet name="other" sheetId="2" r:id="rId2"/>'
    "</sheets></workbook>"
)
_LINKS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="rId2" Type="t" Target="worksheets/sheet2.xml"/></Relationships>'
)
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook_bytes(header: list, rows: list[list]) -> bytes:
    """A workbook with one filled sheet and one to be ignored."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [header, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/workbook.xml", _BOOK)
        archive.writestr("xl/_rels/workbook.xml.rels", _LINKS)
        archive.writestr("xl/worksheets/sheet1.xml", _SHEET.format(lines))
        archive.writestr("xl/worksheets/sheet2.xml", _SHEET.format("<row><c><v>1</v></c></row>"))
    return out.getvalue()


def write_workbooks(df: DataFrame, group: Column, folder: str) -> None:
    """One workbook per group of rows; groups are bounded by the caller."""
    columns = df.columns

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["_group"].iloc[0])
        rows = pdf[columns].astype(object).values.tolist()
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/book{number}.xlsx") as file:
            file.write(workbook_bytes(columns, rows))
        return pd.DataFrame({"n": [len(rows)]})

    df.withColumn("_group", group).groupBy("_group").applyInPandas(save, "n long").collect()
