"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.session import materialize

#: A table of at most so many narrow rows is worked on by one task, without shuffles.
ONE_TASK_ROWS = 100_000
#: Rows of 64 bits each in a filter of keys.
FILTER_WORDS = 1 << 18
#: Bytes of text that a task takes out of an Arrow batch at once; a longer text comes alone.
SLICE_BYTES = 1 << 22


def saved(frame: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, list]:
    """A frame written and read back, with its number of rows and further aggregates taken while it was written.

    A small table comes back in one partition.
    """
    seen = Observation(uuid.uuid4().hex)
    named = [m.alias(f"m{i}") for i, m in enumerate([F.count(F.lit(1)), *measures])]
    back = materialize(frame.observe(seen, *named), label)
    values = [seen.get[f"m{i}"] for i in range(len(named))]
    return (back.coalesce(1) if values[0] <= ONE_TASK_ROWS else back), values


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` may be one of ``keys``, and those whose key is certainly none. Neither part is shuffled.

    Every key sets one bit of a table that has at most ``FILTER_WORDS`` rows, however many keys there are, so it can always be broadcast. The first part
    has all rows with one of the keys and a few others (the more, the more keys there are), so an exact join with it may have to follow.
    """
    word, bits = fresh(rows, "filter_word"), fresh(rows, "filter_bits")
    # As text, so that an int finds the long that equals it.
    digest = F.xxhash64(F.col(key).cast("string"))
    place, bit = F.pmod(digest, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(digest, 58).cast("int"))
    table = keys.select(place.alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    table = F.broadcast(materialize(table, "filter"))
    found = (place == F.col(word)) & (F.col(bits).bitwiseAND(bit) != 0)
    return rows.join(table, found, "left_semi"), rows.join(table, found, "left_anti")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % folds


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether the row's fold is set aside. Rows without an id are not set aside (and never learned from)."""
    return F.coalesce(fold_of(id_column, folds) == fold, F.lit(False))


def learnable(id_column: str, folds: int, fold: int) -> Column:
    """Whether a row may be learned from: it has an id and is not held out."""
    return F.coalesce(fold_of(id_column, folds) != fold, F.lit(False))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that ``frame`` doesn't have yet, whatever letter case it uses."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(rows: DataFrame, group: str, id_column: str, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of each group, the same ones every time: those with the smallest id hashes.

    Rows of a group that share an id, or have none, count as one: the smallest. The number of ids per group sets a hash threshold first, so that
    what is ranked is a few times the sample; repeats of an id go before anything is shuffled. So no group's rows meet in one
    task, however large the group is and however often an id comes up.
    """
    top = 1 << 32
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col(id_column)), F.lit(top)))
    # Written, so that its size is known: a few groups are broadcast, many are joined.
    ids = F.greatest(F.approx_count_distinct(id_column), F.lit(1))
    counts = materialize(hashed.groupBy(group).agg(ids.alias("_n")), "counts")
    near = hashed.join(counts, group).where(F.col("_h") * F.col("_n") <= F.lit(2 * per_group + 32) * F.lit(float(top)))
    others = [c for c in rows.columns if c not in (group, id_column)]
    single = near.groupBy(group, id_column, "_h").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
    order = Window.partitionBy(group).orderBy("_h", id_column)
    ranked = single.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_group)
    return ranked.select(*[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of neighbouring texts of at most ``most`` bytes together; a longer one comes alone."""
    start, size = 0, 0
    for at, n in enumerate(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        if at > start and size + n > most:
            yield start, at - start
            start, size = at, 0
        size += n
    if len(texts) > start:
        yield start, len(texts) - start


def give_back() -> None:
    """Hand freed memory back to the system. A task's Python process outlives the task and lies beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on a task's batches, with the memory given back at its end."""

    def tidied(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return tidied
