"""Run outputs.

Layout: ``<out>/run=<id>/sheet=<idx>-<safe name>/`` holds the CSV parts of one sheet in row order, and
``<out>/run=<id>/manifest/`` the manifest. The index keeps sheets apart whose names sanitize alike.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import plain_number_sql, sanitize_name
from veilframe.operators.clean import COUNTERS, CleanSheet, CleanWorkbook
from veilframe.operators.stats import sheet_stats
from veilframe.session import file_system, move_new, scratch
from veilframe.sources.sheets import POSITION

# Names used when nothing is left of the given ones.
SHEET_FALLBACK, BASE_FALLBACK = "sheet", "workbook"


@dataclass(frozen=True)
class RunOutput:
    run_id: str
    path: str
    sheets: list[str]
    manifest: str


def safe_names(spark: SparkSession, names: list[str], fallback: str) -> list[str]:
    """The column function applied to a few driver-side names, in one small job."""
    rows = spark.sql("SELECT 1").select(F.posexplode(F.lit(list(names))).alias("at", "name"))
    safe = dict(map(tuple, rows.select("at", sanitize_name(F.col("name"), fallback)).collect()))
    return [safe[i] for i in range(len(names))]


def write_csv(sheet: CleanSheet, path: str) -> None:
    """RFC 4180 parts with a header each, in source order; blanks are empty, even for zero rows.

    The global sort is a range partitioning, so the parts concatenate in name order.
    """
    if not sheet.columns:
        raise ValueError(f'every column of sheet "{sheet.name}" is dropped: nothing to write')
    ordered = sheet.positioned.orderBy(POSITION)
    names = [f"o{i}" for i in range(len(sheet.columns))]
    plain = ordered.toDF(POSITION, *names).drop(POSITION)
    cells = []
    for name, field in zip(names, plain.schema.fields):
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cells.append(F.to_json(name))
        else:
            cells.append(F.expr(plain_number_sql(name, field.dataType)))
    text = plain.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, names)]).toDF(*sheet.columns)
    text.write.csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def manifest(
    book: CleanWorkbook, source_name: str, files: list[str], generated_at: dt.datetime | None = None
) -> DataFrame:
    """One row: source, time, the summed counters, the file list, and the sheets in order."""
    when = generated_at or dt.datetime.now(dt.timezone.utc)
    named = F.get(F.lit(list(files)), F.col("sheet_idx"))
    sheet = F.struct("sheet_idx", F.col("sheet").alias("sheetName"), named.alias("fileName"), *COUNTERS)
    totals = [F.sum(c).alias(c) for c in COUNTERS]
    folded = sheet_stats(book).agg(
        F.count(F.lit(1)).alias("sheetsProcessed"), *totals, F.sort_array(F.collect_list(sheet)).alias("listed")
    )
    return folded.select(
        F.lit(source_name).alias("sourceFileName"),
        F.lit(when.astimezone(dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")).alias("generatedAt"),
        "sheetsProcessed",
        *COUNTERS,
        F.lit(list(files)).alias("files"),
        F.transform("listed", lambda s: s.dropFields("sheet_idx")).alias("sheets"),
    )


def write_outputs(
    book: CleanWorkbook, out: str, source_name: str, run_id: str | None = None, generated_at: dt.datetime | None = None
) -> RunOutput:
    """Persist a cleaned workbook. Grouped rows are written once and serve both CSV and counters.

    All is written to a hidden folder and moved into place at the end, so that a run is there as a whole or not at all; a run id that
    exists already raises an error. Nothing but the outputs is left, neither after a failure: intermediate tables live in a scope of their own.
    """
    spark = book.sheets[0].grouped.sparkSession
    base = safe_names(spark, [source_name.rsplit(".", 1)[0]], BASE_FALLBACK)[0]
    run_id = run_id or f"{base}-{uuid.uuid4().hex}"
    path, staged = f"{out.rstrip('/')}/run={run_id}", f"{out.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    there, files = file_system(spark, path)
    if files.exists(there):
        raise FileExistsError(f'run "{run_id}" has been written already')
    folders = [
        f"sheet={i}-{name}" for i, name in enumerate(safe_names(spark, [s.name for s in book], SHEET_FALLBACK))
    ]
    try:
        with scratch(spark):
            own = book.copy()
            # Before any sheet: ids that are seen outside must never be given to someone else.
            own.commit_ids()
            for sheet, folder in zip(own, folders):
                write_csv(sheet.persist_rows(), f"{staged}/{folder}")
            # The manifest comes last: where a store copies folders instead of renaming them, a run without one is incomplete.
            manifest(own, source_name, folders, generated_at).write.json(f"{staged}/manifest")
        if not move_new(spark, staged, path):
            raise FileExistsError(f'run "{run_id}" has been written already')
    finally:
        files.delete(file_system(spark, staged)[0], True)
    return RunOutput(run_id, path, [f"{path}/{f}" for f in folders], f"{path}/manifest")


def read_runs(spark: SparkSession, out: str) -> DataFrame:
    """The manifests of all complete runs as a table, one row per run, with the run's id."""
    counters = [T.StructField(c, T.LongType()) for c in COUNTERS]
    sheet = T.StructType([T.StructField("sheetName", T.StringType()), T.StructField("fileName", T.StringType()), *counters])
    schema = T.StructType(
        [
            T.StructField("sourceFileName", T.StringType()),
            T.StructField("generatedAt", T.TimestampType()),
            T.StructField("sheetsProcessed", T.LongType()),
            *counters,
            T.StructField("files", T.ArrayType(T.StringType())),
            T.StructField("sheets", T.ArrayType(sheet)),
        ]
    )
    runs = spark.read.schema(schema).json(f"{out.rstrip('/')}/run=*/manifest")
    run = F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1)
    return runs.select(run.alias("run"), "*")


def sheets_of(runs: DataFrame) -> DataFrame:
    """One row per written sheet of every run."""
    return runs.select("run", "generatedAt", F.inline("sheets"))

