"""Counters per sheet and for the whole workbook."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.clean import COUNTERS, CleanWorkbook


def sheet_stats(book: CleanWorkbook) -> DataFrame:
    """One row per sheet: ``sheet_idx, sheet`` and the counters."""
    parts = [s.stats.select(F.lit(i).alias("sheet_idx"), F.lit(s.name).alias("sheet"), "*") for i, s in enumerate(book)]
    return reduce(DataFrame.unionByName, parts)


def workbook_summary(book: CleanWorkbook) -> DataFrame:
    """The sheet rows and, with null ``sheet`` and ``sheet_idx``, their grand total."""
    per_sheet = sheet_stats(book)
    place = F.struct("sheet_idx", "sheet")
    rolled = per_sheet.select(place.alias("place"), *COUNTERS).rollup("place").agg(
        F.count(F.lit(1)).alias("sheetsProcessed"), *[F.sum(c).alias(c) for c in COUNTERS]
    )
    return rolled.select("place.sheet_idx", "place.sheet", "sheetsProcessed", *COUNTERS)
