"""Text expressions: trimming, header normalisation, blankness, name sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that trimming removes (ECMAScript WhiteSpace + LineTerminator).
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_ws(c: Column) -> Column:
    """Trim every Unicode white space; Spark's plain ``trim`` knows U+0020 only."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_header(c: Column) -> Column:
    """Null becomes empty, then trim and lower-case."""
    return F.lower(trim_ws(F.coalesce(c.cast("string"), F.lit(""))))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_blank(name: str, dtype: T.DataType) -> Column:
    """Null or the empty string in the named column. Spaces and zero are values, not blanks."""
    return F.expr(blank_sql(name, dtype))


def blank_sql(name: str, dtype: T.DataType) -> str:
    """The blank test as SQL text, for names that need no escaping."""
    empty = f" OR `{name}` = ''" if is_text(dtype) else ""
    return f"(`{name}` IS NULL{empty})"


def plain_number_sql(name: str, dtype: T.DataType) -> str:
    """SQL for a cell as text, whole fractional numbers without their ``.0``; for plain names."""
    text = f"CAST(`{name}` AS STRING)"
    if not isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return text
    whole = f"`{name}` = floor(`{name}`) AND abs(`{name}`) < 1e15"
    return f"IF({whole}, CAST(try_cast(`{name}` AS BIGINT) AS STRING), {text})"


def all_blank(columns: list[tuple[str, T.DataType]]) -> Column:
    """Is every one of the named columns blank?"""
    return F.expr(" AND ".join(blank_sql(name, dtype) for name, dtype in columns) or "true")


def id_key(c: Column, dtype: T.DataType, cast_ids: bool = False) -> Column:
    """The trimmed identifier, or null where the identifier is missing.

    Only strings identify a person; other types count as missing unless ``cast_ids``.
    """
    if not is_text(dtype):
        if not cast_ids:
            return F.lit(None).cast("string")
        c = c.cast("string")
    return F.nullif(trim_ws(c), F.lit(""))


def sanitize_name(c: Column, fallback: str) -> Column:
    """File-safe name: runs of anything but a-z and 0-9 become one ``_``, none at the edges."""
    runs = F.regexp_replace(normalize_header(c), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(runs, F.lit("_")), F.lit("")), F.lit(fallback))
