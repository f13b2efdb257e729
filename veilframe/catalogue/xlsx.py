"""A minimal .xlsx writer: it makes workbook files out of table rows for the workbook query and tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value) -> str:
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def xlsx_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """Sheets of plain Python rows as the bytes of a workbook file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join("<row>" + "".join(map(_cell, row)) + "</row>" for row in rows)
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def as_workbook_files(frame: DataFrame, sheet: str, pos: str, rows_per_file: int = 500) -> DataFrame:
    """``path, content``: the rows as workbook files of ``rows_per_file`` positions each.

    A file covers a fixed range of the unique position, so no group exceeds ``rows_per_file``.
    """
    columns = [c for c in frame.columns if c != pos]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(pos)
        body = ordered[columns].astype(object).where(ordered[columns].notna(), None).values.tolist()
        content = xlsx_bytes([(sheet, [columns, *body])])
        return pd.DataFrame({"path": [f"file-{pdf['file_no'].iloc[0]:012d}.xlsx"], "content": [content]})

    numbered = frame.withColumn("file_no", F.floor(F.col(pos) / rows_per_file).cast("long"))
    return numbered.groupBy("file_no").applyInPandas(pack, "path string, content binary")


__all__ = ["as_workbook_files", "xlsx_bytes"]
