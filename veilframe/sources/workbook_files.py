"""Workbook files (.xlsx, .ods) as rows of cells.

Spark lists and reads the files (``binaryFile``), many small ones per task. A small parser turns each
into rows ``(path, sheet_idx, sheet, row_idx, cells)`` where a cell is ``(kind, value)`` and kind is
``n`` number, ``b`` boolean, ``s`` text, or null for an empty cell. Sheets are then DataFrames by
projection: no pivot and no shuffle. Every file ends as read, rejected or failed (``outcomes``).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.ordered import number_rows
from veilframe.session import materialize
from veilframe.sources.screening import BAD_EXTENSION, TOO_LARGE
from veilframe.sources.sheets import POSITION, Sheet, Workbook

# Format namespaces.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"

ROWS = "path string, sheet_idx int, sheet string, row_idx int, cells array<struct<kind: string, value: string>>, error string"
#: What can be read, in any letter case.
READABLE = r"(?i)\.(xlsx|ods)$"
GLOB = "*.{[xX][lL][sS][xX],[oO][dD][sS]}"
Cell = tuple[str, str] | None


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _xlsx_cell(cell: ET.Element, shared: list[str]) -> Cell:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None or kind == "e":
        return None
    if kind == "s":
        return "s", shared[int(value)]
    if kind == "b":
        return "b", "true" if value == "1" else "false"
    return ("n", value) if kind == "n" else ("s", value)


def _xlsx_sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[Cell]]]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
            # Phonetic runs are annotations, not text.
            runs = [t for t in item.findall(f"{MAIN}t")] + [t for r in item.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
            shared.append("".join(t.text or "" for t in runs))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        part = posixpath.normpath(posixpath.join("/xl", targets[sheet.get(RELATION)])).lstrip("/")
        rows: list[list[Cell]] = []
        for row in ET.fromstring(book.read(part)).iter(f"{MAIN}row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows.extend([] for _ in range(len(rows), at))
            cells: list[Cell] = []
            for cell in row.findall(f"{MAIN}c"):
                place = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (place - len(cells)))
                cells.append(_xlsx_cell(cell, shared))
            rows.append(cells)
        yield sheet.get("name"), rows


def _ods_cell(cell: ET.Element) -> Cell:
    kind = cell.get(f"{OFFICE}value-type")
    if kind in ("float", "percentage", "currency"):
        return "n", cell.get(f"{OFFICE}value")
    if kind == "boolean":
        return "b", cell.get(f"{OFFICE}boolean-value")
    if kind == "date":
        return "s", cell.get(f"{OFFICE}date-value")
    text = "\n".join("".join(p.itertext()) for p in cell.findall(f"{TEXT}p"))
    return ("s", text) if kind is not None or text else None


def _ods_sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[Cell]]]]:
    for table in ET.fromstring(book.read("content.xml")).iter(f"{TABLE}table"):
        rows: list[list[Cell]] = []
        blank_rows = 0
        for row in table.iter(f"{TABLE}table-row"):
            cells: list[Cell] = []
            blanks = 0
            for cell in row:
                # Repeats of empty cells only matter when something follows them.
                times, value = int(cell.get(f"{TABLE}number-columns-repeated", 1)), _ods_cell(cell)
                if value is None:
                    blanks += times
                else:
                    cells.extend([None] * blanks + [value] * times)
                    blanks = 0
            times = int(row.get(f"{TABLE}number-rows-repeated", 1))
            if cells:
                rows.extend([[] for _ in range(blank_rows)] + [cells] * times)
                blank_rows = 0
            else:
                blank_rows += times
        yield table.get(f"{TABLE}name"), rows


def parse_workbook(content: bytes) -> list[tuple[str, list[list[Cell]]]]:
    """Sheets in workbook order, each from its first used row and column. Sheets without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        reader = _ods_sheets if "content.xml" in book.namelist() else _xlsx_sheets
        out = []
        for name, rows in reader(book):
            used = [i for i, row in enumerate(rows) if any(c is not None for c in row)]
            if used:
                left = min(next(c for c, cell in enumerate(rows[i]) if cell is not None) for i in used)
                out.append((name, [row[left:] for row in rows[used[0] : used[-1] + 1]]))
        return out


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                parsed = parse_workbook(bytes(content))
            except Exception as problem:  # noqa: BLE001  whatever a damaged file causes is reported with its path
                rows = [(path, None, None, None, None, f"{type(problem).__name__}: {problem}"[:500])]
            else:
                rows = [
                    (path, s, name, i, [(None, None) if c is None else c for c in cells], None)
                    for s, (name, sheet) in enumerate(parsed)
                    for i, cells in enumerate(sheet)
                ]
            yield pd.DataFrame(rows, columns=["path", "sheet_idx", "sheet", "row_idx", "cells", "error"])


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of cells of every workbook, given a frame with ``path`` and ``content``; one row with ``error`` of a file that can't be parsed."""
    return files.select("path", "content").mapInPandas(_parse_files, ROWS)


def admitted(listing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add ``reason`` to a listing (path, length): null for files that will be read. There is no cap unless the caller sets one."""
    reason = F.when(~F.col("path").rlike(READABLE), BAD_EXTENSION)
    return listing.withColumn("reason", reason if max_bytes is None else reason.when(F.col("length") > max_bytes, TOO_LARGE))


def read_workbook_rows(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Read all ``.xlsx`` and ``.ods`` files below a path, in any letter case, one table of cell rows.

    ``outcomes`` tells of files that this leaves out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)
    return workbook_rows(files if max_bytes is None else files.where(F.col("length") <= max_bytes))


def outcomes(listing: DataFrame, rows: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per listed file: path, outcome (``read``, ``rejected`` or ``failed``), reason, and its number of rows."""
    found = rows.groupBy("path").agg(F.count("row_idx").alias("rows"), F.max("error").alias("error"))
    judged = admitted(listing, max_bytes).join(found, "path", "left")
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("error").isNotNull(), "failed").otherwise("read")
    return judged.select("path", outcome.alias("outcome"), F.coalesce("reason", "error").alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows"))


def cells(rows: DataFrame) -> DataFrame:
    """The long cell table: ``path, sheet_idx, sheet, row_idx, col_idx, kind, value``."""
    return rows.select("path", "sheet_idx", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "cell")).select(
        "path", "sheet_idx", "sheet", "row_idx", "col_idx", "cell.kind", "cell.value"
    )


def _column_type(kinds: set[str]) -> str:
    return {frozenset("n"): "double", frozenset("b"): "boolean"}.get(frozenset(kinds), "string")


def to_workbook(rows: DataFrame, skip_failed: bool = False) -> Workbook:
    """One DataFrame per sheet name, over all files that hold it; the first row of a sheet is its header.

    Files that share a sheet must share its header. A column is numeric or boolean when all its cells
    are, else text. Sheets follow their first (file, place). Rows shorter than the header end in blanks and cells beyond it are ignored. The
    position runs over the files in path order, so the sheet keeps workbook order. Files that couldn't be parsed raise with their
    paths, unless ``skip_failed``.
    """
    rows = materialize(rows, "workbook")  # parse every file once
    broken = rows.where("error IS NOT NULL").select("path", "error").limit(5).collect()
    if broken and not skip_failed:
        raise ValueError("files that can't be parsed: " + "; ".join(f"{r.path} ({r.error})" for r in broken))
    rows = rows.where("error IS NULL")
    header_rows = rows.where("row_idx = 0").select("sheet", "path", "sheet_idx", F.transform("cells", lambda c: c["value"]).alias("header"))
    # One row per distinct sheet layout.
    layouts = header_rows.groupBy("sheet", "header").agg(F.min(F.struct("path", "sheet_idx")).alias("place")).orderBy("place").collect()
    names = [r["sheet"] for r in layouts]
    if len(set(names)) != len(names):
        raise ValueError("files that share a sheet name must share its header")
    kinds: dict[tuple[str, int], set[str]] = {}
    found = cells(rows).where("row_idx > 0 AND kind IS NOT NULL").select("sheet", "col_idx", "kind").distinct().collect()
    for sheet, col, kind in found:
        kinds.setdefault((sheet, col), set()).add(kind)
    ranks = number_rows(rows.select("path").distinct(), ["path"], "files", into="file_idx")
    located = rows.where("row_idx > 0").join(ranks, "path")
    sheets = []
    for layout in layouts:
        values = [
            F.get(F.col("cells"), F.lit(i))["value"].cast(_column_type(kinds.get((layout["sheet"], i), {"s"}))).alias(f"c{i}")
            for i in range(len(layout["header"]))
        ]
        own = located.where(F.col("sheet") == layout["sheet"])
        position = F.shiftleft("file_idx", 24) + F.col("row_idx")
        header = ["" if h is None else h for h in layout["header"]]
        sheets.append(Sheet(layout["sheet"], own.select(position, *values).toDF(POSITION, *header), POSITION))
    return Workbook(sheets)


__all__ = ["admitted", "cells", "outcomes", "parse_workbook", "read_workbook_rows", "to_workbook", "workbook_rows"]
