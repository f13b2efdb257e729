"""Dry-run views of a cleaned sheet: its first rows and how much of it they are."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.clean import CleanSheet
from veilframe.sources.sheets import POSITION

# Fixed value: preview size in rows, the header row included.
PREVIEW_LIMIT = 25
# Source rows looked at first, as a multiple of the rows shown.
LOOKAHEAD = 40


def _leading(sheet: CleanSheet, n: int) -> CleanSheet:
    """A part of the sheet that holds its first ``n`` output rows.

    Rows appear in first-seen order, so a prefix of the source that yields ``n`` distinct rows yields
    the first ``n``. The prefix is bounded by position, found from the position column alone, and
    the bound is pushed to the scan. Only where repeats and blanks use the prefix up is the whole sheet cleaned.
    """
    positions = sheet.sheet.positional().select(POSITION)
    head = positions.orderBy(POSITION).limit(max(1, n) * LOOKAHEAD)
    bound, seen = head.agg(F.max(POSITION), F.count(F.lit(1))).first()
    if seen < max(1, n) * LOOKAHEAD:
        return sheet
    part = sheet.prefix(bound)
    return part if part.distinct.limit(n).count() == n else sheet


def preview(sheet: CleanSheet, limit: int = PREVIEW_LIMIT, keep_position: bool = False) -> DataFrame:
    """The first ``limit - 1`` data rows in source order.

    The rows are picked by position before ids are attached, so the lookup sees those rows only.
    """
    sheet.sheet.require_order("preview")
    n = max(0, limit - 1)
    lead = _leading(sheet, n)
    if lead.distinct is lead.grouped:
        ordered = replace(lead, grouped=lead.grouped.orderBy(POSITION).limit(n)).positioned.orderBy(POSITION)
    else:  # a given mapping merges rows, so they are picked after it
        ordered = lead.positioned.orderBy(POSITION).limit(n)
    return ordered if keep_position else ordered.drop(POSITION)


def preview_meta(sheet: CleanSheet, limit: int = PREVIEW_LIMIT) -> DataFrame:
    """One row: totalDataRows, previewedDataRows, truncated."""
    total = F.col("totalDataRows")
    shown = F.least(total, F.lit(max(0, limit - 1)).cast("long"))
    return sheet.distinct.agg(F.count(F.lit(1)).alias("totalDataRows")).select(
        total, shown.alias("previewedDataRows"), (shown < total).alias("truncated")
    )
