"""The throttle audit on a stream: per key, only the open window's start and count are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.functions.text import is_text
from veilframe.operators.throttle import GROUP, MAX_HITS, MICROS, WINDOW_SECONDS, group_key, micros


def throttle_stream(
    hits: DataFrame, key: str, ts: str, hit_id: str, window_seconds: int = WINDOW_SECONDS, max_hits: int = MAX_HITS,
    watermark: str | None = None,
) -> DataFrame:
    """``key, hit_id, at, window_start_us, hit_count, over_limit`` of every hit.

    Hits of a key within one micro-batch are taken in time order; limit the size of a micro-batch
    at the source (for files ``maxFilesPerTrigger``), which bounds what one key holds in memory. A hit that arrives in a later batch
    with an earlier time is counted into the open window.

    ``watermark``: how late hits may come, for example ``10 minutes``; needs a timestamp with zone. A key's state goes once
    its window has closed that long ago. Without it there is one row of state per key for ever.
    """
    width, dtype = window_seconds * MICROS, hits.schema[key].dataType
    source = hits if watermark is None else hits.withWatermark(ts, watermark)
    at = micros(F.col(ts), hits.schema[ts].dataType)
    timed = [] if watermark is None else [F.col(ts).alias("_time")]
    base = source.select(group_key(key, dtype).alias(GROUP), F.col(hit_id).cast("long").alias(hit_id), at.alias("at"), *timed)
    long = T.LongType()
    out = T.StructType(
        [base.schema[GROUP], base.schema[hit_id]]
        + [T.StructField(n, t) for n, t in (("at", long), ("window_start_us", long), ("hit_count", long), ("over_limit", T.BooleanType()))]
    )

    def advance(_key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat([c[[GROUP, hit_id, "at"]] for c in chunks], ignore_index=True).sort_values(["at", hit_id], ignore_index=True)
        at = pdf["at"].to_numpy()
        starts, counts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        i = 0
        while i < len(at):
            if start is None or at[i] >= start + width:
                start, count = int(at[i]), 0
            end = int(np.searchsorted(at, start + width, side="left"))
            starts[i:end] = start
            counts[i:end] = np.arange(count + 1, count + 1 + end - i)
            count, i = count + end - i, end
        state.update((start, count))
        if watermark is not None:
            # Not before the watermark, which a timeout must lie beyond.
            state.setTimeoutTimestamp(max((start + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(window_start_us=starts, hit_count=counts, over_limit=counts > max_hits)[out.fieldNames()]

    timeout = GroupStateTimeout.NoTimeout if watermark is None else GroupStateTimeout.EventTimeTimeout
    found = base.groupBy(GROUP).applyInPandasWithState(advance, out, "start long, count long", "append", timeout)
    named = F.col(GROUP) if is_text(dtype) else F.when(F.col(GROUP) != "", F.expr(f"substring({GROUP}, 2)")).cast(dtype)
    return found.select(named.alias(key), *out.fieldNames()[1:])
