"""Cleaning one sheet, and a workbook whose sheets share one identifier mapping.

Shape of the plan for one sheet::

    scan -> blank-row filter -> projection + flags -> hash aggregate on the output row -> id lookup

The aggregate does three jobs in one shuffle: it removes duplicates, keeps the first position, and
sums the per-row flags, so rows and statistics come from the same frame. It runs on trimmed keys
*before* ids are attached, which is the same partition of rows (built ids are one-to-one with keys) but
makes the id lookup see distinct rows only. Under a caller's mapping, which may lack keys or give two one id, a second,
much smaller aggregate follows the lookup. Redacted columns are constants and stay out of the key.

Decisions: null and '' stay distinct values in kept columns; a missing id is '' and a missing age
is null, both empty in CSV; equality is Spark grouping equality (0.0 = -0.0, null = null).
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.dates import age_years, to_date
from veilframe.functions.text import all_blank, id_key, is_blank, is_text
from veilframe.operators.ids import KeyColumn, as_mapping, attach_ids, build_mapping, with_uses
from veilframe.operators.lookup import Table
from veilframe.operators.registry import Growth, Registry
from veilframe.plans.columns import ColumnPlan, plan_tables
from veilframe.plans.rules import DEFAULT_RULES, RuleSet
from veilframe.session import materialize
from veilframe.sources.sheets import POSITION, OrderError, Sheet, Workbook

# The per-sheet counters, in report order.
COUNTERS = ("rowsProcessed", "duplicatesRemoved", "invalidDobCount", "missingNhiCount", "redactedCellCount")
_ROWS, _INVALID, _MISSING, _REDACTED = "_rows", "_invalid", "_missing", "_redacted"


def today() -> dt.date:
    """One date per call, taken on the driver so that retries and later jobs agree."""
    return dt.datetime.now(dt.timezone.utc).date()


@dataclass(frozen=True)
class Options:
    as_of: dt.date = field(default_factory=today)
    cast_ids: bool = False
    day_first: bool = False
    numeric_dates: str | None = None
    skip_blank_filter: bool = False


def _flag(condition: Column) -> Column:
    return condition.cast("long")


def _total(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, flags, F.lit(0).cast("long"))


def drop_blank_rows(sheet: Sheet) -> DataFrame:
    """The sheet without rows whose every source cell is blank, columns that rules drop included."""
    kept = sheet.positional().where(~all_blank([(f"c{i}", t) for i, t in enumerate(sheet.types)]))
    return kept.toDF(*sheet.frame.columns)


def project(sheet: Sheet, plan: list[ColumnPlan], options: Options) -> tuple[DataFrame, list[str]]:
    """Non-blank rows as output values ``v*`` (ids still as keys) with three flag counts per row.

    Returns the frame and the value columns that can differ between rows.
    """
    raw, types = sheet.positional(), sheet.types
    if not options.skip_blank_filter:
        raw = raw.where(~all_blank([(f"c{i}", t) for i, t in enumerate(types)]))
    values, varying, blanks = [], [], {}
    for n, p in enumerate(plan):
        cell, dtype = F.col(f"c{p.index}"), types[p.index]
        if p.action in ("redact", "ageFromDate"):
            blanks[f"b{n}"] = is_blank(f"c{p.index}", dtype)
        if p.action == "redact":
            continue
        if p.action == "anonymize":
            if not is_text(dtype) and not options.cast_ids:
                warnings.warn(f'column "{p.name}" holds no text, so every id in it is missing; see cast_ids', stacklevel=2)
            value = id_key(cell, dtype, options.cast_ids)
        elif p.action == "ageFromDate":
            value = to_date(cell, dtype, options.day_first, options.numeric_dates)
        else:
            value = cell
        values.append(value.alias(f"v{n}"))
        varying.append(f"v{n}")
    order = [F.col(POSITION)] if sheet.pos is not None else []
    # Dates, then ages, then flags, each from the columns before: every date is parsed once per row.
    dated = raw.select(*values, *order, *[c.alias(name) for name, c in blanks.items()])
    ages = {f"v{n}": age_years(F.col(f"v{n}"), options.as_of) for n, p in enumerate(plan) if p.action == "ageFromDate"}
    valued = dated.withColumns(ages) if ages else dated
    invalid, missing, redacted = [], [], []
    for n, p in enumerate(plan):
        if p.action == "redact":
            redacted.append(_flag(~F.col(f"b{n}")))
        elif p.action == "ageFromDate":
            invalid.append(_flag(F.col(f"v{n}").isNull() & ~F.col(f"b{n}")))
        elif p.action == "anonymize":
            missing.append(_flag(F.col(f"v{n}").isNull()))
    flags = [_total(invalid).alias(_INVALID), _total(missing).alias(_MISSING), _total(redacted).alias(_REDACTED)]
    return valued.select(*varying, *order, *flags), varying


def _ungroupable(dtype: T.DataType) -> bool:
    """Maps and variants, at any depth, cannot be grouped."""
    text = dtype.simpleString()
    return "map<" in text or "variant" in text


def group_rows(projected: DataFrame, varying: list[str], again: bool = False) -> DataFrame:
    """Distinct output rows with row count, first position and summed flags: one shuffle.

    ``again``: the rows are groups already, whose counts add up.
    """
    keys, carried = [], []
    for name in varying:
        if _ungroupable(projected.schema[name].dataType):
            # The JSON form stands for the value; equal forms carry equal values, so any one will do.
            keys.append(F.to_json(name).alias(f"k_{name}"))
            carried.append(F.first(name).alias(name))
        else:
            keys.append(F.col(name))
    sums = [F.sum(c).alias(c) for c in (_INVALID, _MISSING, _REDACTED)]
    first = [F.min(POSITION).alias(POSITION)] if POSITION in projected.columns else []
    return projected.groupBy(*(keys or [F.lit(0).alias("_one")])).agg(
        (F.sum(_ROWS) if again else F.count(F.lit(1))).alias(_ROWS), *first, *sums, *carried
    )


@dataclass
class CleanSheet:
    """The cleaned sheet. Statistics and dry runs of id-free sheets never build the mapping."""

    sheet: Sheet
    plan: list[ColumnPlan]
    grouped: DataFrame
    find_mapping: Callable[[], Table]
    options: Options
    own_ids: bool = False
    #: The mapping is a caller's: keys may be unknown to it or share an id, so rows can become equal by their ids.
    given: bool = False

    @property
    def mapping(self) -> Table:
        """The id mapping; asking for it the first time numbers the keys."""
        return self.find_mapping()

    @property
    def name(self) -> str:
        return self.sheet.name

    @property
    def columns(self) -> list[str]:
        return [p.name for p in self.plan]

    def prefix(self, bound: int) -> CleanSheet:
        """The same cleaning of the rows up to a position.

        First-seen order makes its rows and ids those of the whole sheet, as far as they go.
        """
        rows = Sheet(self.name, self.sheet.frame.where(F.col(self.sheet.pos) <= F.lit(bound)), self.sheet.pos)
        grouped = group_rows(*project(rows, self.plan, self.options))
        find_mapping = _mapping_for([rows], [self.plan], self.options, None) if self.own_ids else self.find_mapping
        return CleanSheet(rows, self.plan, grouped, find_mapping, self.options, self.own_ids, self.given)

    def persist_rows(self) -> CleanSheet:
        """Write the grouped rows once, when sink, statistics and k report all need them."""
        self.grouped = materialize(self.grouped, "clean")
        self.__dict__.pop("_with_ids", None)
        return self

    @cached_property
    def _with_ids(self) -> DataFrame:
        frame = self.grouped
        spread = F.col(POSITION) if POSITION in frame.columns else F.col(_ROWS)
        for n, p in enumerate(self.plan):
            if p.action == "anonymize":
                frame = attach_ids(frame, f"v{n}", self.mapping, spread, f"id{n}")
        if not self._merges:
            return frame
        names = [f"{'id' if p.action == 'anonymize' else 'v'}{n}" for n, p in enumerate(self.plan) if p.action != "redact"]
        return group_rows(frame, names, again=True)

    @property
    def _merges(self) -> bool:
        return self.given and any(p.action == "anonymize" for p in self.plan)

    @property
    def distinct(self) -> DataFrame:
        """The distinct output rows with their counts and flags; ids are attached only if they can make rows equal."""
        return self._with_ids if self._merges else self.grouped

    @property
    def scoring_rows(self) -> DataFrame:
        """``rows`` for counting equal values: the keys of a built mapping stand in for ids, which are one to one with them."""
        if self._merges:
            return self.rows
        out = [F.lit(p.replace_with) if p.action == "redact" else F.col(f"v{n}") for n, p in enumerate(self.plan)]
        return self.grouped.select(*[c.alias(f"o{i}") for i, c in enumerate(out)]).toDF(*self.columns)

    def _outputs(self) -> list[Column]:
        out = []
        for n, p in enumerate(self.plan):
            if p.action == "redact":
                out.append(F.lit(p.replace_with))
            elif p.action == "anonymize":
                out.append(F.col(f"id{n}"))
            else:
                out.append(F.col(f"v{n}"))
        return out

    @property
    def rows(self) -> DataFrame:
        """Distinct cleaned rows under their display names, in no particular order."""
        return self._with_ids.select(*[c.alias(f"o{i}") for i, c in enumerate(self._outputs())]).toDF(*self.columns)

    @property
    def positioned(self) -> DataFrame:
        """Like ``rows`` with ``_pos``, the position of the first of the equal source rows, in front."""
        self.sheet.require_order("ordered output")
        named = [c.alias(f"o{i}") for i, c in enumerate(self._outputs())]
        return self._with_ids.select(F.col(POSITION), *named).toDF(POSITION, *self.columns)

    @property
    def counted(self) -> DataFrame:
        """Like ``positioned`` with ``_rows``, how many source rows each output row stands for."""
        named = [c.alias(f"o{i}") for i, c in enumerate(self._outputs())]
        return self._with_ids.select(POSITION, _ROWS, *named).toDF(POSITION, _ROWS, *self.columns)

    @property
    def stats(self) -> DataFrame:
        """One row with the counters, all taken before duplicates went. Needs no id lookup, unless a given mapping merges rows."""
        return self.distinct.agg(*counters())


def counters() -> list[Column]:
    """The counters as aggregates over grouped rows."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    rows = total(_ROWS)
    values = [rows, rows - F.count(F.lit(1)), total(_INVALID), total(_MISSING), total(_REDACTED)]
    return [v.alias(name) for v, name in zip(values, COUNTERS)]


def _key_columns(sheet: Sheet, sheet_idx: int, plan: list[ColumnPlan], options: Options) -> list[KeyColumn]:
    raw, types, out = sheet.positional(), sheet.types, []
    for p in plan:
        if p.action == "anonymize" and (options.cast_ids or is_text(types[p.index])):
            sheet.require_order("first-seen numbering")
            key = id_key(F.col(f"c{p.index}"), types[p.index], options.cast_ids).alias("key")
            out.append(KeyColumn(raw.select(key, POSITION), sheet_idx, p.index))
    return out


def _mapping_for(
    sheets: list[Sheet], plans: list[list[ColumnPlan]], options: Options, given: Table | DataFrame | Registry | None
) -> Callable[[], Table]:
    """The shared mapping, built or measured on first use and once only.

    Without a given mapping, or with a registry that grows, missing row order is reported right away.
    """
    columns, numbers = [], given is None or isinstance(given, Registry)
    for i, (sheet, plan) in enumerate(zip(sheets, plans)):
        if numbers or sheet.pos is not None:
            columns += _key_columns(sheet, i, plan, options)
    if isinstance(given, Registry):
        return cache(lambda: given.grow(columns))
    if given is not None:
        return cache(lambda: with_uses(as_mapping(given), columns))
    if columns:
        return cache(lambda: build_mapping(columns))
    empty = sheets[0].frame.sparkSession.createDataFrame([], "key string, id string")
    return lambda: Table(empty, ("key",), "id", rows=0, key_bytes=0)


def clean_sheet(
    sheet: Sheet | DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    mapping: Table | DataFrame | Registry | None = None,
    **options,
) -> CleanSheet:
    """Clean one sheet with the given rules and, if it anonymizes, its own mapping, a given one, or one that grows."""
    if isinstance(sheet, DataFrame):
        sheet = Sheet("sheet", sheet, POSITION if POSITION in sheet.columns else None)
    return clean_workbook(Workbook([sheet]), rules, mapping, **options)[sheet.name]


class CleanWorkbook:
    """Cleaned sheets in workbook order."""

    def __init__(self, sheets: list[CleanSheet], find_mapping: Callable[[], Table], registry: Registry | None = None):
        self.sheets = sheets
        self.find_mapping = find_mapping
        self.registry = registry

    @property
    def mapping(self) -> Table:
        return self.find_mapping()

    def copy(self) -> CleanWorkbook:
        """The same cleaning with tables of its own; a mapping that has been built already is shared."""
        find = self.find_mapping
        if getattr(find, "__wrapped__", None) is not None and not find.cache_info().currsize:
            find = cache(find.__wrapped__)
        return CleanWorkbook([replace(s, find_mapping=find) for s in self.sheets], find, self.registry)

    def commit_ids(self) -> int | None:
        """Make the ids that this run has given to new people permanent in its registry, and return the registry's version."""
        mapping = self.mapping if self.registry is not None else None
        return mapping.commit() if isinstance(mapping, Growth) else None

    def __iter__(self) -> Iterator[CleanSheet]:
        return iter(self.sheets)

    def __getitem__(self, name: str) -> CleanSheet:
        for sheet in self.sheets:
            if sheet.name == name:
                return sheet
        raise KeyError(name)


def clean_workbook(
    workbook: Workbook,
    rules: RuleSet = DEFAULT_RULES,
    mapping: Table | DataFrame | Registry | None = None,
    **options,
) -> CleanWorkbook:
    """Clean every sheet; one mapping over all sheets keeps a person's id the same everywhere.

    ``mapping``: none (ids are numbered in this run), a frame or table of ``key, id`` (unknown keys get the empty id), or a
    ``Registry`` (unknown keys get its next numbers, which ``commit_ids`` makes permanent).
    """
    opts = Options(**options)
    sheets = list(workbook)
    if not sheets:
        raise ValueError("the workbook has no sheet with columns")
    plans = plan_tables(sheets[0].frame.sparkSession, [s.headers for s in sheets], rules)
    find_mapping = _mapping_for(sheets, plans, opts, mapping)
    cleaned = []
    for i, (sheet, plan) in enumerate(zip(sheets, plans)):
        grouped = group_rows(*project(sheet, plan, opts))
        # Ids of a first sheet depend on earlier rows only, so a prefix of it numbers itself.
        own_ids = i == 0 and mapping is None
        given = mapping is not None and not isinstance(mapping, Registry)  # a grown registry knows all keys and is one to one
        cleaned.append(CleanSheet(sheet, plan, grouped, find_mapping, opts, own_ids, given))
    return CleanWorkbook(cleaned, find_mapping, mapping if isinstance(mapping, Registry) else None)


__all__ = ["COUNTERS", "CleanSheet", "CleanWorkbook", "Options", "OrderError", "clean_sheet", "clean_workbook", "today"]
