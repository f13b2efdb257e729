"""Date expressions: a fixed date grammar, whole-year ages and the date-shape test.

The grammar is deliberately a list. Recognised, after trimming:

* ``yyyy``, ``yyyy-MM``, ``yyyy-MM-dd``, ``yyyy/MM/dd``
* ``yyyy-MM-dd`` followed by ``T`` or a space and a time, with an optional zone offset
* ``M/d/yyyy`` and ``M-d-yyyy``, also with two-digit years (00-49 are 20xx, 50-99 are 19xx)
* ``MMM d, yyyy`` and ``d MMM yyyy`` with English month names, long or short

Impossible dates such as 1990-02-30 are null. Times without a zone are read in the session
time zone, which should be UTC. Nothing here raises under ANSI mode.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import WHITESPACE, is_text, trim_ws

# Shapes accepted by the date-shape test, and the open window of plausible years.
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
SLASH_SHAPE = r"^(?:\d{1,2}[/-]){2}\d{2,4}\z"
YEAR_AFTER, YEAR_BEFORE = 1900, 2100
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_CALENDAR = r"^\d{4}(?:[-/]\d{1,2}){0,2}\z"
_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"
# What every text in the grammar starts like; spares other texts the parsing.
_DATE_LIKE = rf"^[\s{WHITESPACE}]*(?:\d{{1,4}}[-/ ]|\d{{4}}(?!\d)|[A-Za-z]{{3,9}}\.? \d)"
# Other forms are rewritten to year-month-day. A text matches one of them at most.
_MONTH_DAY_YEAR = (
    (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})\z", "$4-$1-$3"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2([0-4]\d)\z", "20$4-$1-$3"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2([5-9]\d)\z", "19$4-$1-$3"),
)
_NAMED = (
    (r"^([A-Za-z]{3})[A-Za-z]{0,6}\.? (\d{1,2}),? (\d{4})\z", "$3-$1-$2"),
    (r"^(\d{1,2}) ([A-Za-z]{3})[A-Za-z]{0,6}\.?,? (\d{4})\z", "$3-$2-$1"),
)


def _rewrite(s: Column, forms: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in forms:
        s = F.regexp_replace(s, pattern, replacement)
    return s


def _month_to_number(ymd: Column) -> Column:
    """``1990-jan-5`` to ``1990-1-5``; null when the three letters are no month."""
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(ymd, 6, 3)))
    month = F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
    return F.concat(F.substring(ymd, 1, 5), month, F.substring(ymd, 9, 3))


def _grammar(s: Column, day_first: bool = False) -> list[tuple[Column, Column]]:
    """The forms of the grammar for trimmed texts: what a text of the form looks like, and its date. The first form that fits counts."""
    month_first = _rewrite(s, _MONTH_DAY_YEAR)
    numeric = month_first.try_cast("date")
    if day_first:
        swapped = tuple((pattern, to.replace("$1-$3", "$3-$1")) for pattern, to in _MONTH_DAY_YEAR)
        numeric = F.coalesce(_rewrite(s, swapped).try_cast("date"), numeric)
    return [
        (s.rlike(_CALENDAR), F.translate(s, "/", "-").try_cast("date")),
        (s.rlike(_DATETIME), s.try_cast("timestamp").cast("date")),
        (s.rlike("^[0-9]+[/-]"), numeric),
        (s.rlike("[A-Za-z]{3}.* "), _month_to_number(_rewrite(s, _NAMED)).try_cast("date")),
    ]


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case whose condition holds, else null."""
    (condition, value), *rest = cases
    chosen = F.when(condition, value)
    for condition, value in rest:
        chosen = chosen.when(condition, value)
    return chosen


def parse_date(c: Column, day_first: bool = False, trimmed: Column | None = None) -> Column:
    """Text to date, null when the text is outside the grammar. ``trimmed``: the trimmed text, if the caller has it already."""
    return _first(_grammar(trim_ws(c) if trimmed is None else trimmed, day_first))


def to_date(c: Column, dtype: T.DataType, day_first: bool = False, numeric_dates: str | None = None) -> Column:
    """A column of any type to date. Numbers are dates only on request, as spreadsheet serials."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    if is_text(dtype):
        return parse_date(c, day_first)
    if isinstance(dtype, T.NumericType) and numeric_dates == "excel_serial":
        days = F.when(c.between(1, 200000), F.floor(c).cast("int"))
        return F.date_add(F.lit(dt.date(1899, 12, 30)), days)
    return F.lit(None).cast("date")


def age_years(born: Column, as_of: dt.date) -> Column:
    """Whole years on ``as_of``; null outside 0..129. Not months_between, which rounds month ends."""
    not_yet = (F.month(born) * 100 + F.dayofmonth(born)) > F.lit(as_of.month * 100 + as_of.day)
    years = F.lit(as_of.year) - F.year(born) - not_yet.cast("int")
    return F.when((years >= 0) & (years < 130), years)


def _plausible(year: Column) -> Column:
    return (year > YEAR_AFTER) & (year < YEAR_BEFORE)


def _shapes(c: Column, trimmed: Column | None = None) -> tuple[list[tuple[Column, Column]], Column, list[tuple[Column, Column]]]:
    """The date-shape test in parts: ISO prefix and slash form with what else they ask for, what other texts must look like, and
    the forms of the grammar with what they ask for.
    """
    iso_year = F.substring(c, 1, 4).try_cast("int")
    last_part = F.regexp_extract(c, r"(\d+)\z", 1)
    plain = [
        (c.rlike(ISO_PREFIX), _plausible(iso_year)),
        (c.rlike(SLASH_SHAPE), (F.length(last_part) != 4) | _plausible(last_part.try_cast("int"))),
    ]
    forms = _grammar(trim_ws(c) if trimmed is None else trimmed)
    return plain, c.rlike(_DATE_LIKE) & c.rlike(r"\d{4}"), [(looks, _plausible(F.year(date))) for looks, date in forms]


def looks_like_date(c: Column, trimmed: Column | None = None) -> Column:
    """Shape test on text: ISO prefix, slash or dash form, else the grammar plus a 4-digit run."""
    plain, general, forms = _shapes(c, trimmed)
    return F.coalesce(_first([(~c.rlike("[0-9]"), F.lit(False)), *plain, (general, _first(forms))]), F.lit(False))


def date_shape(c: Column, trimmed: Column | None = None) -> Column:
    """Which of ``shape_hits`` decides whether the text looks like a date; null if it doesn't without further tests."""
    plain, general, forms = _shapes(c, trimmed)
    numbered = [(looks, F.lit(i)) for i, (looks, _) in enumerate(plain + forms)]
    return _first([(~c.rlike("[0-9]"), F.lit(None).cast("int")), *numbered[: len(plain)], (general, _first(numbered[len(plain) :]))])


def shape_hits(c: Column, shape: Column, trimmed: Column | None = None) -> list[Column]:
    """``looks_like_date`` as columns, one of which is 1 if the text looks like a date; all others are null. Each is short enough for
    a compiled method of its own, and asks nothing of a text of another shape: not so an AND, of which Spark may evaluate both sides.
    """
    plain, _, forms = _shapes(c, trimmed)
    return [F.when(shape == i, F.when(test, 1)) for i, (_, test) in enumerate(plain + forms)]
