"""Cleaning a stream: the batch projection without the parts that need a global order.

Blank rows, drop, keep, rename, redact and date to age act on one row and keep no state. Ids come
from a mapping built beforehand (a stream-static lookup) or from a keyed hash. First-seen numbering
and keep-first deduplication over the whole past stay with batch; see ``dedup_stream`` for the
bounded form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.clean import Options, project
from veilframe.operators.ids import as_mapping, attach_ids, hashed_id
from veilframe.operators.lookup import Table
from veilframe.plans.columns import plan_tables
from veilframe.plans.rules import DEFAULT_RULES, RuleSet
from veilframe.sources.sheets import Sheet


def clean_stream(
    stream: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    mapping: Table | DataFrame | None = None,
    id_secret: str | None = None,
    **options,
) -> DataFrame:
    """Clean every row of a stream (or of a batch frame) as it arrives."""
    plan = plan_tables(stream.sparkSession, [stream.columns], rules)[0]
    frame, varying = project(Sheet("stream", stream), plan, Options(**options))
    outputs = []
    for n, p in enumerate(plan):
        if p.action == "redact":
            outputs.append(F.lit(p.replace_with))
        elif p.action != "anonymize":
            outputs.append(F.col(f"v{n}"))
        elif mapping is not None:
            spread = F.struct(*varying)
            frame = attach_ids(frame, f"v{n}", as_mapping(mapping), spread, f"id{n}")
            outputs.append(F.col(f"id{n}"))
        elif id_secret is not None:
            outputs.append(F.coalesce(hashed_id(F.col(f"v{n}"), id_secret), F.lit("")))
        else:
            raise ValueError(f'column "{p.name}" is anonymized: a stream needs a mapping or an id_secret')
    return frame.select(*[c.alias(f"o{i}") for i, c in enumerate(outputs)]).toDF(*[p.name for p in plan])


def dedup_stream(stream: DataFrame, ts: str, delay: str, keys: list[str] | None = None) -> DataFrame:
    """Drop repeated rows whose event times lie within ``delay`` of each other.

    State is bounded by the watermark, so a repeat later than the delay passes; batch cleaning
    would drop it. Without ``keys`` all columns except the event time make a row.
    """
    names = keys or [c for c in stream.columns if c != ts]
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(names)
