"""Number expressions used by detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import trim_ws

_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
# Prefixes of non-decimal number literals and their bases.
_RADIX = {"x": (16, "[0-9a-f]"), "o": (8, "[0-7]"), "b": (2, "[01]")}


def text_to_number(c: Column, trimmed: Column | None = None) -> Column:
    """Text to double under script number rules: white space is 0, 0x/0o/0b literals count.

    ``trimmed`` is the text without white space around it, if the caller has it already.
    """
    s = F.lower(trim_ws(c) if trimmed is None else trimmed)
    number = F.when(s == "", F.lit(0.0)).when(s.rlike(_DECIMAL), s.try_cast("double"))
    prefixed = F.lit(None).cast("double")
    for letter, (base, digit) in _RADIX.items():
        # Fifteen significant digits stay far inside a long in every base.
        whole = F.conv(F.substring(s, 3, 1000), base, 10).try_cast("double")
        prefixed = F.when(s.rlike(f"^0{letter}0*{digit}{{1,15}}\\z"), whole).otherwise(prefixed)
    return number.when(s.startswith("0"), prefixed)


def whole_number_between(n: Column, low: int, high: int) -> Column:
    return F.coalesce(n.between(low, high) & (n == F.floor(n)), F.lit(False))


def to_fixed2(c: Column) -> Column:
    """Round a double in [0.5, 1) to two places from its exact binary value.

    ``x * 2**53`` is then a whole number below 2**53, so the rounding is pure long arithmetic and
    never sees the shortest decimal form, which would turn 0.59499999999999997 into 0.60.
    """
    mantissa = (c * F.lit(float(2**53))).cast("long")
    return F.shiftright(mantissa * 100 + F.lit(2**52), 53) / F.lit(100.0)
