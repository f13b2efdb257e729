"""Which outputs have outlived their time. Selection only; deleting is the caller's decision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.throttle import micros

# Fixed value: hours an output is kept unless told otherwise.
DEFAULT_TTL_HOURS = 24.0


def ttl_millis(hours: float | str | None) -> int:
    """Hours to milliseconds; absent, non-numeric, infinite and non-positive values mean the default."""
    try:
        value = float(hours) if hours not in (None, "") else DEFAULT_TTL_HOURS
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or value <= 0:
        value = DEFAULT_TTL_HOURS
    return int(value * 3_600_000)


def expired(listing: DataFrame, now: Column, ttl_hours: float | str | None = None, modified: str = "modificationTime") -> DataFrame:
    """Rows older than the time to live. Strict: an output of exactly that age stays."""
    dtype = listing.schema[modified].dataType
    now_micros = micros(now.cast(dtype), dtype) if isinstance(dtype, T.TimestampNTZType) else F.unix_micros(now)
    age = F.floor(now_micros / 1000) - F.floor(micros(F.col(modified), dtype) / 1000)
    return listing.where(age > ttl_millis(ttl_hours))
