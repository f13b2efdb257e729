"""Sheets and workbooks: named DataFrames with an explicit row order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.session import broadcast_limit
from veilframe.sources.csv_records import read_split_csv

POSITION = "_pos"


class OrderError(ValueError):
    """An operator that depends on row order was asked for on a sheet without one."""


@dataclass(frozen=True)
class Sheet:
    """One table. ``pos`` names a unique long column that orders the rows; it is not sheet data."""

    name: str
    frame: DataFrame
    pos: str | None = None

    @property
    def headers(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.pos]

    @property
    def types(self) -> list[T.DataType]:
        return [f.dataType for f in self.frame.schema.fields if f.name != self.pos]

    def require_order(self, operator: str) -> None:
        if self.pos is None:
            raise OrderError(f'{operator} needs a row order: give sheet "{self.name}" a pos column')

    def positional(self) -> DataFrame:
        """Columns ``c0..cn`` in sheet order plus ``_pos`` if the sheet has an order.

        Positional names make empty, dotted and repeated headers safe inside expressions.
        """
        renamed, i = [], 0
        for name in self.frame.columns:
            if name == self.pos:
                renamed.append(POSITION)
            else:
                renamed.append(f"c{i}")
                i += 1
        frame = self.frame.toDF(*renamed)
        if self.pos is not None:
            frame = frame.withColumn(POSITION, F.col(POSITION).cast("long"))
        return frame


class Workbook:
    """An ordered set of sheets that share one identifier mapping. Zero-column sheets are skipped."""

    def __init__(self, sheets: Iterable[Sheet] | Mapping[str, DataFrame]):
        if isinstance(sheets, Mapping):
            sheets = [Sheet(name, frame, POSITION if POSITION in frame.columns else None) for name, frame in sheets.items()]
        self.sheets = [sheet for sheet in sheets if sheet.headers]

    def __iter__(self) -> Iterator[Sheet]:
        return iter(self.sheets)

    def __len__(self) -> int:
        return len(self.sheets)

    def __getitem__(self, name: str) -> Sheet:
        for sheet in self.sheets:
            if sheet.name == name:
                return sheet
        raise KeyError(name)


def read_parquet_sheet(spark: SparkSession, name: str, path: str, pos: str | None = None) -> Sheet:
    """A Parquet table as a sheet, ordered by its own column or else by (file, row in file).

    The derived position counts rows over the files in order of their paths. It comes from the scan and not from the task that happens to
    run it, so it is the same on every retry. Files' row counts come from their footers, by a scan without columns; rows
    find their file's start by a hash of its path, and a file that wasn't there when rows were counted raises an error.
    """
    frame = spark.read.parquet(path)
    if pos is not None:
        return Sheet(name, frame, pos)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = frame.select(file.alias("file"), row.alias("row")).groupBy("file").agg((F.max("row") + 1).alias("rows"))
    # One row per file reaches the driver, which lists the files anyway.
    counted = sizes.select("file", F.xxhash64("file").alias("hash"), "rows").orderBy("file").collect()
    if len({r["hash"] for r in counted}) < len(counted):
        raise OrderError(f'two files of "{path}" share a hash: name a column that orders the rows')
    starts = accumulate((r["rows"] for r in counted), initial=0)
    listed = spark.createDataFrame([(r["hash"], s) for r, s in zip(counted, starts)], "_file long, _start long")
    if len(counted) * 16 <= broadcast_limit(spark):
        listed = F.broadcast(listed)
    return Sheet(name, _positioned(frame, listed, path), POSITION)


def _positioned(frame: DataFrame, starts: DataFrame, path: str) -> DataFrame:
    """Add each row's position, given ``_start`` of each file by the hash ``_file`` of its path."""
    file, row = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
    located = frame.select("*", file.alias("_file"), row.alias("_row")).join(starts, "_file", "left")
    missing = F.raise_error(F.lit(f'"{path}" has files that were not there when its rows were counted')).cast("long")
    at = F.coalesce(F.col("_start"), missing) + F.col("_row")
    return located.select(*[F.col(f"`{c}`") for c in frame.columns], at.alias(POSITION))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> DataFrame:
    """RFC 4180 text: quoted commas and line breaks, doubled quotes, CRLF; blanks are null.

    Without a schema every column is text, so no second pass infers types. Quoted line breaks need
    whole files per task here; ``multiline=False`` lets large files without them be split, and ``csv_records`` splits any.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multiline, enforceSchema=False)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_csv_sheet(spark: SparkSession, name: str, path: str, pos: str | None = None) -> Sheet:
    """CSV files as a sheet of text columns, ordered by a column of theirs or else by their lines, file after file.

    Without ``pos``, files are read in splits and the position is a record's byte offset (``csv_records``).
    """
    if pos is not None:
        frame = read_csv(spark, path)
        return Sheet(name, frame.withColumn(pos, F.col(f"`{pos}`").cast("long")), pos)
    return Sheet(name, read_split_csv(spark, path, POSITION), POSITION)
