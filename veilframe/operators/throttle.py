"""Fixed-window throttle audit: which hits of a key a rate limiter would have refused.

The first hit of a key opens a window anchored at that hit; the first hit at or after its end opens
the next one. So windows form a chain per key, which no epoch-aligned ``window()`` reproduces.

A key with a bounded number of distinct instants is walked directly, one key per group. Keys beyond
the bound never meet in one task: their chain is found by pointer doubling over range-partitioned
as-of lookups, in log2(windows per key) rounds. Hits find their window by an as-of lookup too, and
their place in it from global row numbers, so no window, however hot, is one task's work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import is_text
from veilframe.operators.ordered import asof_lookup, number_rows
from veilframe.session import materialize

# The audited limit, 30 hits in 60 seconds, and the key shared by hits that have none.
WINDOW_SECONDS = 60
MAX_HITS = 30
UNKNOWN_KEY = "unknown"
# Distinct instants of one key that may be walked in one group: 16 MB of longs.
WALK_LIMIT = 2_000_000
MICROS = 1_000_000
GROUP = "_group"


def micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970; a timestamp without zone is read as it stands, in no zone."""
    if isinstance(dtype, T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        fraction = (F.date_part(F.lit("SECOND"), c) * MICROS).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * (86_400 * MICROS) + seconds.cast("long") * MICROS + fraction
    return F.unix_micros(c)


def known_key(name: str, dtype: T.DataType) -> Column:
    """The key, where hits without a text key share one. Keys of other types may be null: those hits share the null key."""
    if not is_text(dtype):
        return F.col(name)
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN_KEY)).alias(name)


def group_key(name: str, dtype: T.DataType) -> Column:
    """The key as text that is never null, so that joins and groups treat the null key like any other."""
    if is_text(dtype):
        return known_key(name, dtype)
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def chain(instants: np.ndarray, width: int) -> np.ndarray:
    """Window starts among ascending instants."""
    starts, at = [], 0
    while at < len(instants):
        starts.append(instants[at])
        at = int(np.searchsorted(instants, instants[at] + width, side="left"))
    return np.array(starts, dtype=np.int64)


def _walk(instants: DataFrame, key: str, width: int) -> DataFrame:
    """Window starts of keys whose instants fit one group."""
    schema = T.StructType([instants.schema[key], T.StructField("at", T.LongType())])

    def starts_of_key(pdf: pd.DataFrame) -> pd.DataFrame:
        found = chain(np.sort(pdf["at"].to_numpy()), width)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "at": found})

    return instants.select(key, "at").groupBy(key).applyInPandas(starts_of_key, schema)


def _double(instants: DataFrame, key: str, width: int) -> DataFrame:
    """Window starts by pointer doubling: marks spread over 1, 2, 4... jumps per round."""
    queries = instants.select(key, F.col("at").alias("own"), (F.col("at") + width).alias("at"))
    sources = instants.select(key, "at", F.col("at").alias("jump"))
    jumps = asof_lookup(queries, sources, key, "at", "own", ["jump"], forward=True, label="next").drop("at")
    first = instants.groupBy(key).agg(F.min("at").alias("own")).withColumn("first", F.lit(True))
    state = jumps.join(first, [key, "own"], "left").withColumn("marked", F.col("first").isNotNull()).drop("first")
    state = materialize(state, "chain")
    while state.where("marked AND jump IS NOT NULL").limit(1).count():
        # Marked instants of a key ascend strictly, so their targets are distinct.
        targets = state.where("marked AND jump IS NOT NULL").select(key, F.col("jump").alias("own"), F.lit(True).alias("hit"))
        queries = state.withColumn("at", F.col("jump"))
        sources = state.select(key, F.col("own").alias("at"), F.col("jump").alias("beyond"))
        far = asof_lookup(queries, sources, key, "at", "own", ["beyond"], label="double")
        state = materialize(
            far.join(targets, [key, "own"], "left").select(
                key, "own", F.col("beyond").alias("jump"), (F.col("marked") | F.col("hit").isNotNull()).alias("marked")
            ),
            "chain",
        )
    return state.where("marked").select(key, F.col("own").alias("at"))


def window_starts(instants: DataFrame, key: str, width: int, walk_limit: int = WALK_LIMIT) -> DataFrame:
    """``key, at`` of every window start, given the distinct instants of all keys."""
    large = materialize(instants.groupBy(key).count().where(F.col("count") > walk_limit).select(key), "large-keys")
    if not large.limit(1).count():
        return _walk(instants, key, width)
    # The table of large keys has a known size, so the planner decides whether to broadcast it.
    small = _walk(instants.join(large, key, "left_anti"), key, width)
    return small.unionByName(_double(materialize(instants.join(large, key, "left_semi"), "large"), key, width))


def throttle_audit(
    hits: DataFrame,
    key: str,
    ts: str,
    hit_id: str,
    window_seconds: int = WINDOW_SECONDS,
    max_hits: int = MAX_HITS,
    walk_limit: int = WALK_LIMIT,
) -> DataFrame:
    """Every hit with its window start, its number in the window, and whether it was over the limit.

    ``hit_id`` is a unique long that orders hits of the same instant. Refused hits carry the whole
    seconds to wait, at least one.
    """
    width, shown, dtype = window_seconds * MICROS, key, hits.schema[key].dataType
    key = GROUP
    base = hits.select(
        known_key(shown, dtype), group_key(shown, dtype).alias(key), ts, hit_id, micros(F.col(ts), hits.schema[ts].dataType).alias("at")
    )
    numbered = number_rows(base, [key, "at", hit_id], "hits")
    instants = materialize(numbered.groupBy(key, "at").agg(F.min("number").alias("opens"), F.min(ts).alias("window_start")), "instants")
    starts = window_starts(instants.select(key, "at"), key, width, walk_limit)
    opened = starts.join(instants, [key, "at"]).withColumn("opened_at", F.col("at"))
    found = asof_lookup(numbered, opened, key, "at", hit_id, ["opens", "window_start", "opened_at"], label="windows")
    count = F.col("number") - F.col("opens") + 1
    left = F.col("opened_at") + width - F.col("at")
    over = count > max_hits
    return found.select(
        shown, hit_id, ts, "window_start", count.alias("hit_count"), over.alias("over_limit"),
        F.when(over, F.greatest(F.lit(1).cast("long"), F.ceil(left / MICROS).cast("long"))).alias("retry_after"),
    )
