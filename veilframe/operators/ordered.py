"""Global row numbers and as-of lookups over a range-partitioned order.

Both work the same way. Spark sorts the rows into ranges of the wanted order; the ranges come from
sampling, so a key that holds a third of the rows spreads over many partitions. Each partition
is written with its own index, and the few values that cross a partition edge (one per partition)
are resolved from the written table. Writing also freezes the ranges: a lost executor cannot make
a later pass see other bounds. No single-partition window and no per-key group is involved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.session import materialize

_PART, _INDEX = "_part", "_index"


def in_global_order(frame: DataFrame, order_by: Sequence[str], label: str) -> DataFrame:
    """Write ``frame`` in global order with ``_part`` and ``_index`` (place within the partition)."""
    ranged = frame.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    mid = F.monotonically_increasing_id()
    return materialize(
        ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_INDEX, mid.bitwiseAND(F.lit(2**33 - 1))), label
    )


def global_number(sizes: dict[int, int]) -> Column:
    """The 1-based global row number, given the rows of every partition."""
    parts = max(sizes, default=0) + 1
    starts = list(accumulate((sizes.get(p, 0) for p in range(parts)), initial=0))[:parts]
    offsets = F.expr(f"array({', '.join(f'{s}L' for s in starts)})")
    return F.get(offsets, F.col(_PART)) + F.col(_INDEX) + F.lit(1)


def number_rows(frame: DataFrame, order_by: Sequence[str], label: str, into: str = "number") -> DataFrame:
    """Add a global 1-based row number under a total order."""
    written = in_global_order(frame, order_by, label)
    sizes = {r[0]: r[1] for r in written.groupBy(_PART).count().collect()}
    return written.withColumn(into, global_number(sizes)).drop(_PART, _INDEX)


def asof_lookup(
    queries: DataFrame,
    sources: DataFrame,
    by: str,
    at: str,
    tie: str,
    payload: Sequence[str],
    forward: bool = False,
    label: str = "asof",
) -> DataFrame:
    """For every query row, the payload of the nearest source row of the same ``by``.

    Backward takes the latest source at or before ``at``, forward the earliest at or after it.
    ``at`` is a long in both frames. ``tie`` is a long of the queries that tells equal ``(by, at)``
    rows apart, so that even those can be split over partitions. Queries without a source get
    nulls. Sources and queries are merged into one sorted stream, which has no join key to skew.
    """
    spark = queries.sparkSession
    kept = queries.columns
    q_row = F.struct(*[F.col(c) for c in kept])
    s_row = F.struct(F.col(by).alias("_by"), *[F.col(c) for c in payload])
    direction = F.lit(-1 if forward else 1)
    merged = queries.select(
        F.col(by).alias("_by"), (F.col(at) * direction).alias("_at"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
        q_row.alias("_q"), F.lit(None).cast(_type_of(sources.select(s_row.alias("s")))).alias("_s"),
    ).unionByName(
        sources.select(
            F.col(by).alias("_by"), (F.col(at) * direction).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
            F.lit(None).cast(_type_of(queries.select(q_row.alias("q")))).alias("_q"), s_row.alias("_s"),
        )
    )
    order = ["_by", "_at", "_kind", "_tie"]
    ranged = merged.repartitionByRange(*order).sortWithinPartitions(*order).select("_kind", "_q", "_s")
    schema = T.StructType(
        [
            T.StructField("_part", T.IntegerType()),
            T.StructField("_edge", T.BooleanType()),
            ranged.schema["_q"],
            ranged.schema["_s"],
        ]
    )
    written = materialize(ranged.mapInArrow(_carry_forward, schema), label)

    # The driver sees at most one edge row per partition, whatever the number of rows.
    edges = written.where("_edge").select("_part", "_s").collect()
    askers = written.where("NOT _edge").select("_part").distinct().collect()
    incoming = spark.createDataFrame(
        _carried_over(dict(map(tuple, edges)), [r[0] for r in askers]),
        T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_in", written.schema["_s"].dataType)]),
    )
    answered = written.where("NOT _edge").join(F.broadcast(incoming), "_part", "left")
    source = F.coalesce(F.col("_s"), F.col("_in"))
    same = source["_by"].eqNullSafe(F.col("_q")[by])
    return answered.select(
        *[F.col("_q")[c].alias(c) for c in kept], *[F.when(same, source[c]).alias(c) for c in payload]
    )


def _type_of(frame: DataFrame) -> T.DataType:
    return frame.schema.fields[0].dataType


def _carried_over(edges: dict, parts: list[int]) -> list[tuple]:
    """Per partition that asks, the last source of any earlier partition."""
    out, last, asking = [], None, set(parts)
    for part in sorted(asking | edges.keys()):
        if part in asking:
            out.append((part, last))
        last = edges.get(part, last)
    return out


def _carry_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each query row of a sorted partition the latest source row seen so far."""
    part = TaskContext.get().partitionId()
    names = ["_part", "_edge", "_q", "_s"]
    carried = q_type = None
    for batch in batches:
        kind, query, source = batch.column(0), batch.column(1), batch.column(2)
        q_type = query.type
        if carried is not None:
            kind = pa.concat_arrays([pa.array([0], kind.type), kind])
            query = pa.concat_arrays([pa.nulls(1, query.type), query])
            source = pa.concat_arrays([carried, source])
        rows = pa.array(range(len(kind)), pa.int64())
        is_source = pc.equal(kind, 0)
        latest = pc.fill_null_forward(pc.if_else(is_source, rows, pa.scalar(None, pa.int64())))
        asked = pc.invert(is_source)
        wanted = latest.filter(asked)
        n = len(wanted)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(False, n), query.filter(asked), source.take(wanted)],
                names=names,
            )
        if len(latest) and latest[-1].is_valid:
            carried = source.take(pa.array([latest[-1].as_py()]))
    if carried is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([True]), pa.nulls(1, q_type), carried],
            names=names,
        )
