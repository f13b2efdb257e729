"""CSV read by many tasks, quoted line breaks included, with the byte offset of every record as its position.

Files are cut into splits at line ends, which may lie inside a quoted field. Whether they do follows from the number of quotes before: a
first pass counts quotes and bytes per split, running sums over the splits of a file tell for each whether it starts inside a field and where it
lies. A second pass walks each split's lines in order, starts a record at every line outside quotes, and keeps its position. Only a record that
runs over a split's end leaves pieces, at most two per split, which are put together by position.

Lines are read by Spark's text source, so files may lie in any store that Spark reads. Compressed files can't be cut and are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.session import broadcast_limit, materialize

#: Bytes of a split's row in the lookup of splits.
SPLIT_BYTES = 64
_WALKED = "file long, at long, first boolean, record string, piece boolean, opens boolean"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as they are, without their line feed, with split and number of quotes. Rows of a split stay in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        (quotes % 2 == 1).alias("odd"),
        (F.octet_length("value") + 1).cast("long").alias("size"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: its key, its file, where it lies in all files together, whether it starts inside quotes, and the file's start."""
    sized = lines.groupBy("path", "start").agg(F.sum("size").alias("size"), (F.count_if("odd") % 2).alias("odd"))
    sized = materialize(sized, "splits")
    # One row per file: as many as the listing of the files on the driver has.
    files = sized.groupBy("path").agg(F.sum("size").alias("length"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("file_at", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(files, "path").select(
        _split_key().alias("split"),
        F.xxhash64("path").alias("file"),
        (F.col("file_at") + F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long"))).alias("base"),
        (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside"),
        "file_at",
    )
    return materialize(placed, "splits")


def _split_key() -> Column:
    return F.xxhash64("path", "start")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of a partition, split after split, into records and pieces of records."""
    split = file = None
    inside, at, file_at = False, 0, 0
    pending: list[str] = []
    pending_at, opened = 0, False

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "at", "first", "record", "piece", "opens"]
        )

    def left() -> list[tuple]:
        """The piece that a split ends with, if it ends inside quotes."""
        return [(file, pending_at, pending_at == file_at, "\n".join(pending), True, opened)] if pending else []

    for batch in batches:
        keys = batch.column("split").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(low, high - low)
            rows: list[tuple] = []
            if keys[low] != split:
                rows += left()
                split, pending = keys[low], []
                file, at, file_at = (part.column(c)[0].as_py() for c in ("file", "base", "file_at"))
                inside = part.column("inside")[0].as_py()
            odd = part.column("odd").to_numpy(zero_copy_only=False)
            sizes = part.column("size").to_numpy()
            after = (np.cumsum(odd) + inside) % 2 == 1
            before = after ^ odd
            places = at + np.cumsum(sizes) - sizes
            whole = ~before & ~after
            if whole.any():
                kept = pa.array(whole)
                n, spots = int(whole.sum()), places[whole]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, file)), pa.array(spots), pa.array(spots == file_at), part.column("value").filter(kept),
                     pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))],
                    ["file", "at", "first", "record", "piece", "opens"],
                )
            for i in np.flatnonzero(~whole).tolist():
                if not before[i]:
                    pending, pending_at, opened = [], int(places[i]), True
                elif not pending:
                    pending_at, opened = int(places[i]), False
                pending.append(part.column("value")[i].as_py())
                if not after[i]:
                    rows.append((file, pending_at, pending_at == file_at, "\n".join(pending), not opened, opened))
                    pending = []
            inside, at = bool(after[-1]), int(places[-1] + sizes[-1])
            if rows:
                yield made(rows)
    if pending:
        yield made(left())


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``at, first, record``: the text of every record without its line end, its byte offset over all files in order of their paths, and
    whether it is its file's first one. Empty lines are no records. A quote that is never closed makes the rest of its file one record.
    """
    lines = _lines(spark, path)
    splits = _splits(lines)
    count, crossed = splits.agg(F.count(F.lit(1)), F.count_if("inside")).first()
    if splits.select("split").distinct().count() != count:
        raise RuntimeError("two splits share a hash; read the files one by one")
    keyed = lines.select("value", "odd", "size", _split_key().alias("split"))
    if count * SPLIT_BYTES <= broadcast_limit(spark):
        told = keyed.join(F.broadcast(splits), "split")
    else:
        ordered = keyed.withColumn("line", F.monotonically_increasing_id())
        told = ordered.join(splits, "split").repartition("split").sortWithinPartitions("split", "line").drop("line")
    walked = told.select("split", "file", "base", "inside", "file_at", "value", "odd", "size").mapInArrow(_walk, _WALKED)
    records = walked.where("NOT piece").select("at", "first", "record")
    if crossed:
        pieces = materialize(walked.where("piece"), "pieces")
        which = F.count_if("opens").over(Window.partitionBy("file").orderBy("at"))
        listed = pieces.withColumn("which", which).groupBy("file", "which")
        joined = listed.agg(F.array_sort(F.collect_list(F.struct("at", "first", "record"))).alias("of"))
        text = F.array_join(F.transform("of", lambda p: p["record"]), "\n")
        records = records.unionByName(joined.select(F.col("of")[0]["at"].alias("at"), F.col("of")[0]["first"].alias("first"), text.alias("record")))
    return records.withColumn("record", F.regexp_replace("record", "\r\\z", "")).where("record <> ''")


def header_of(spark: SparkSession, path: str) -> str:
    """The first record of one file."""
    n = 1
    while True:
        lines = [r.value for r in spark.read.option("lineSep", "\n").text(path).limit(n).collect()]
        for end in range(1, len(lines) + 1):
            text = "\n".join(lines[:end])
            if text.count('"') % 2 == 0:
                return text.removesuffix("\r")
        if len(lines) < n:
            raise ValueError(f'"{path}" has no header')
        n *= 16


def read_split_csv(spark: SparkSession, path: str | list[str], position: str) -> DataFrame:
    """All columns as text, and ``position``, which orders the rows of all files. Every file needs the same header."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f'"{path}" holds no files')
    header = header_of(spark, files[0])
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(header=True, **options).csv(files[0]).columns
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    other = F.raise_error(F.concat(F.lit("a file has another header: "), F.col("record"))).cast("boolean")
    rows = read_records(spark, path).where(F.when(~F.col("first"), True).when(F.col("record") == header, False).otherwise(other))
    parsed = rows.select(F.from_csv("record", ddl, options).alias("cells"), F.col("at"))
    return parsed.select("cells.*", "at").toDF(*names, position)
