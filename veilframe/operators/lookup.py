"""Left lookup joins that do not depend on the shape of the key distribution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import broadcast_limit

# A key is hot when it covers at least this share of all uses, so there are at most 4096 hot keys.
HOT_PARTS = 4096
# Rows whose key is null, or already resolved, spread over this many filler keys.
SPREAD = 4096
# Bytes added per row for the parts of a broadcast row that are not the key.
ROW_OVERHEAD = 64


@dataclass(frozen=True)
class Table:
    """A lookup side: unique ``key`` columns, ``payload``, and how often each key is used."""

    frame: DataFrame
    key: tuple[str, ...]
    payload: str
    rows: int | None = None
    key_bytes: int | None = None
    uses: str | None = None
    total_uses: int | None = None

    def fits_broadcast(self) -> bool:
        if self.rows is None or self.key_bytes is None:
            return False
        return self.key_bytes + self.rows * ROW_OVERHEAD <= broadcast_limit(self.frame.sparkSession)


def lookup(frame: DataFrame, key: list[Column], table: Table, spread: Column, into: str) -> DataFrame:
    """Add ``into``: the payload for each row's key, null where the key is null or unknown.

    Without use counts (a stream, whose batches are bounded) there is no hot part.
    A lookup side of proven small size is broadcast. Otherwise the hot keys (at most ``HOT_PARTS``
    of them, whatever the data) are broadcast as digests of fixed width, so their length doesn't matter, and the others are
    shuffled; rows that need no second lookup, null keys above all, travel under filler keys that spread and never match.
    """
    columns = [F.col(c) for c in table.key]
    right = table.frame.select(*columns, F.col(table.payload).alias("_payload"), *([F.col(table.uses)] if table.uses else []))
    if table.fits_broadcast():
        return _join(frame, key, F.broadcast(right), table.key, "_payload", into)
    if table.uses is None or not table.total_uses:
        return _spread_join(frame, key, right, table.key, spread, "_payload", into)
    hot = F.col(table.uses) * HOT_PARTS >= F.lit(table.total_uses)
    # Rows meet by a short hash; only where that agrees, the digest decides.
    told = right.where(hot).select(F.xxhash64(*columns).alias("_rhash"), _digest(columns).alias("_rdigest"), F.col("_payload").alias("_hot"))
    same = (F.xxhash64(*key) == F.col("_rhash")) & (_digest(key) == F.col("_rdigest"))
    first = frame.join(F.broadcast(told), same, "left").drop("_rhash", "_rdigest")
    open_key = [F.when(F.col("_hot").isNull(), k) for k in key]
    both = _spread_join(first, open_key, right.where(~hot), table.key, spread, "_payload", "_cold")
    return both.withColumn(into, F.coalesce("_hot", "_cold")).drop("_hot", "_cold")


def _digest(columns: list[Column]) -> Column:
    """32 bytes that stand for a key; null if any part is null."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256))


def _join(frame: DataFrame, key: list[Column], right: DataFrame, names: tuple[str, ...], payload: str, into: str) -> DataFrame:
    other = right.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], F.col(payload).alias(into))
    condition = reduce(lambda a, b: a & b, [k == F.col(f"_r{i}") for i, k in enumerate(key)])
    return frame.join(other, condition, "left").drop(*[f"_r{i}" for i in range(len(names))])


def _spread_join(
    frame: DataFrame, key: list[Column], right: DataFrame, names: tuple[str, ...], spread: Column, payload: str, into: str
) -> DataFrame:
    known = reduce(lambda a, b: a & b, [k.isNotNull() for k in key])
    # Real keys carry filler -1 on both sides; fillers 0..SPREAD-1 exist on the left only.
    filler = F.when(known, F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
    left = frame.withColumn("_filler", filler)
    for i, k in enumerate(key):
        left = left.withColumn(f"_l{i}", k)
    other = right.select(
        *[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], F.lit(-1).alias("_rfiller"), F.col(payload).alias(into)
    )
    condition = F.col("_filler") == F.col("_rfiller")
    for i in range(len(names)):
        condition = condition & F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}"))
    drop = ["_filler", "_rfiller", *[f"_l{i}" for i in range(len(names))], *[f"_r{i}" for i in range(len(names))]]
    return left.join(other, condition, "left").drop(*drop)
