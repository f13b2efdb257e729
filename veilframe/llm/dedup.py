"""Exact duplicates by a tree merge of digest runs.

Every input partition is a run: its texts' digests with the identifier to keep and a count. Runs merge
``fan_in`` at a time, round by round, until one is left; each round keeps one entry per digest and
merged run. Then the result travels down the same tree. No task ever sees more rows of one text than
``fan_in`` runs hold or one input partition has, so a text may be a third of all rows.

Entries only merge if SHA-256, length and a second, independent hash agree, at every level.

Defined results: a null text equals the empty text. A null id loses to any id; if a group has null ids
only, ``keep_id`` is null. Of rows that repeat both id and text exactly one is kept. Empty tables give
empty results. Other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import fresh, split_by_keys, text_or_empty
from veilframe.session import materialize

KEY = ["digest", "bytes", "guard"]


def _identified(text_column: str) -> list:
    text = text_or_empty(text_column)
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("guard"),
    ]


def duplicate_groups(
    rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", fan_in: int = 16
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 (lowercase hex).

    ``keep``: ``largest`` or ``smallest``, which id of a group of equal texts stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    best = F.max if keep == "largest" else F.min
    # The flag makes null ids lose either way.
    flag = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    runs = materialize(
        rows.select(
            F.col(id_column).alias("id"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
            *_identified(text_column),
        ),
        "runs",
    )
    entry = F.struct(flag.alias("has"), "id", "row")
    level = materialize(
        runs.groupBy("run", *KEY).agg(best(entry).alias("keeper"), F.count("*").alias("copies")), "merged"
    )
    levels, width = [level], 1 + (runs.agg(F.max("run")).first()[0] or 0)
    parent = F.floor(F.col("run") / fan_in).cast("int")
    while width > 1:
        merged = (
            level.withColumn("run", parent)
            .groupBy("run", *KEY)
            .agg(best("keeper").alias("keeper"), F.sum("copies").alias("copies"))
        )
        level = materialize(merged, "merged")
        levels.append(level)
        width = -(-width // fan_in)
    placed = level.where("copies > 1")
    for lower in reversed(levels[:-1]):
        below = lower.select(F.col("run").alias("own"), parent.alias("run"), *KEY)
        placed = below.join(placed, ["run", *KEY]).drop("run").withColumnRenamed("own", "run")
    return runs.join(placed, ["run", *KEY], "left").select(
        "id",
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keeper.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("sha256"),
    )


def keyed(rows: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, str]:
    """``rows`` and ``groups`` with a common key, made of text digest and id, under a name that neither has."""
    key = fresh(rows, "row_key")
    own = F.concat_ws(":", F.sha2(text_or_empty(text_column), 256), F.col(id_column).cast("string"))
    of = F.concat_ws(":", F.col("sha256"), F.col("id").cast("string"))
    return rows.withColumn(key, own), groups.withColumn(key, of), key


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat both id and text the smallest by all columns stays,
    or any of them if columns can't be compared.

    What goes is told by keys of digest and id, and a filter of those comes before the join, so that only texts that may go are ever shuffled.
    """
    groups = materialize(duplicate_groups(docs, id_column, text_column, keep), "groups")
    rows, told, key = keyed(docs, groups.where("group_size > 1"), id_column, text_column)
    other = ~F.col("id").eqNullSafe(F.col("keep_id"))
    gone = materialize(told.where(other).select(key).distinct(), "gone")
    repeated = materialize(told.where(~other).groupBy(key).count().where("count > 1").select(key), "repeated")
    may_go, stays = split_by_keys(rows, gone, key)
    left = stays.unionByName(may_go.join(gone, key, "left_anti"))
    if repeated.isEmpty():
        return left.drop(key)
    again = left.join(repeated, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if all(_ordered(f.dataType) for f in docs.schema.fields):
        one = again.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    else:
        one = again.dropDuplicates([key]).drop(key)
    return left.join(repeated, key, "left_anti").drop(key).unionByName(one)


def _ordered(kind) -> bool:
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text and "interval" not in text
