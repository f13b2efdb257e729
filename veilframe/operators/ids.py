"""Consistent identifiers: first-seen numbering and the lookup that applies it.

Distinct trimmed keys are numbered 1, 2, 3... by first appearance in (sheet, row, column) order,
with one counter for every anonymized column of every sheet. The scan behind it reads the
identifier columns and the position only, and pre-aggregates before its one shuffle by key.
Sequential ids reveal arrival order; use ``hashed_id`` where that matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.lookup import Table, lookup
from veilframe.operators.ordered import _PART, global_number, in_global_order
from veilframe.session import materialize
from veilframe.sources.sheets import POSITION


def format_id(number: Column) -> Column:
    """``ID-`` and at least three digits; wider numbers are never cut."""
    return F.format_string("ID-%03d", number)


def hashed_id(key: Column, secret: str) -> Column:
    """A keyed id that needs no order, for streams and for hiding arrival order."""
    return F.concat(F.lit("ID-"), F.sha2(F.concat(F.lit(secret + "\x00"), key), 256))


@dataclass(frozen=True)
class KeyColumn:
    """One anonymized column: a frame holding ``key`` and ``_pos``, and its place in the workbook."""

    frame: DataFrame
    sheet_idx: int
    col_idx: int


def first_seen(columns: list[KeyColumn]) -> DataFrame:
    """``key, uses`` and the first position ``sheet_idx, _pos, col_idx`` of every distinct key.

    One ``min`` per column over longs keeps this a hash aggregate with map-side combine: a key that
    fills a third of the input leaves each map task as a single row.
    """
    stacked = None
    for slot, column in enumerate(columns):
        part = column.frame.where("key IS NOT NULL").select("key", POSITION, F.lit(slot).alias("slot"))
        stacked = part if stacked is None else stacked.unionByName(part)
    firsts = [F.min(F.when(F.col("slot") == s, F.col(POSITION))).alias(f"p{s}") for s in range(len(columns))]
    per_key = stacked.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), *firsts)
    places = [
        F.when(
            F.col(f"p{s}").isNotNull(),
            F.struct(
                F.lit(c.sheet_idx).alias("sheet_idx"), F.col(f"p{s}").alias(POSITION), F.lit(c.col_idx).alias("col_idx")
            ),
        )
        for s, c in enumerate(columns)
    ]
    first = F.least(*places) if len(places) > 1 else places[0]
    return per_key.select("key", "uses", first.alias("first")).select("key", "uses", "first.*")


def build_mapping(columns: list[KeyColumn]) -> Table:
    """Number the distinct keys. The mapping is a written table, so every later use agrees."""
    written = in_global_order(first_seen(columns), ["sheet_idx", POSITION, "col_idx"], "ids")
    parts = (
        written.groupBy(_PART)
        .agg(F.count(F.lit(1)), F.sum(F.octet_length("key")), F.sum("uses"))
        .collect()
    )
    mapping = written.select("key", format_id(global_number({r[0]: r[1] for r in parts})).alias("id"), "uses")
    return Table(
        mapping,
        ("key",),
        "id",
        rows=sum(r[1] for r in parts),
        key_bytes=sum(r[2] for r in parts),
        uses="uses",
        total_uses=sum(r[3] for r in parts),
    )


def as_mapping(mapping: Table | DataFrame) -> Table:
    """Accept a caller's registry, any frame with unique ``key`` and an ``id``, and measure it."""
    if isinstance(mapping, Table):
        return mapping
    registry = mapping.select("key", "id")
    rows, key_bytes = registry.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    return Table(registry, ("key",), "id", rows=rows, key_bytes=key_bytes)


def with_uses(mapping: Table, columns: list[KeyColumn]) -> Table:
    """A registry too large to broadcast, cut to the keys in use and told how often each is used.

    Both sides of the join have unique keys, so it cannot be skewed.
    """
    if mapping.uses is not None or mapping.fits_broadcast() or not columns:
        return mapping
    used = materialize(first_seen(columns).select("key", "uses").join(mapping.frame, "key"), "registry")
    rows, key_bytes, total = used.agg(F.count(F.lit(1)), F.sum(F.octet_length("key")), F.sum("uses")).first()
    return Table(used, ("key",), "id", rows=rows, key_bytes=key_bytes or 0, uses="uses", total_uses=total or 0)


def attach_ids(frame: DataFrame, key: str, mapping: Table, spread: Column, into: str) -> DataFrame:
    """Add the id of each key; missing and unknown keys get the empty string."""
    found = lookup(frame, [F.col(key)], mapping, spread, into)
    return found.withColumn(into, F.coalesce(into, F.lit("")))
