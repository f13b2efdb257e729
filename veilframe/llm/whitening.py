"""Whitening of embeddings from exact integer covariances by bit-sliced scatter.

Entries become fixed-point integers x. For the covariance, x is shifted to be non-negative and cut into bit planes: one bit
of one dimension over 16 384 rows is a row of 64-bit words. The cross-product of two dimensions is the sum over pairs of
their planes of 2^(a+b) times the bits set in both (AND, then popcount). A further dimension that is one everywhere gives sums and the
number of rows the same way. Counts are added by Spark, centred as integers of any length, and only then divided and handed to ``eigh``.
The driver sees one matrix of dimensions by dimensions, whatever the number of rows.

Defined results: vectors that are null, empty, or hold null, non-finite or absurd entries (2^56 and more, whose fixed-point form fits no
long) take no part, neither do vectors whose number of entries isn't the table's most frequent one (ties: the larger). Equal x vectors
count once in all statistics, yet each row is returned. Ids are carried along as they are, null and repeated ones too. Directions
without variance can't be whitened: they aren't components, so one vector alone, or none, gives no rows. Equal eigenvalues share
their space in some fixed way; each component's entry of largest size is positive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from veilframe.session import materialize

BLOCK_ROWS = 16_384
#: Pair counts whose weights lie within so many bits of each other share one 64-bit sum.
LIMB_BITS = 16


@dataclass
class Whitening:
    """``count`` distinct vectors with ``sums`` per dimension, and their components by falling eigenvalue."""

    count: int
    sums: list[int]
    spread: int  # largest minus smallest entry
    eigenvalues: np.ndarray
    directions: np.ndarray  # dimensions x components
    trace: float
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """count * x - sums, exact."""
        if self.count * self.spread < 1 << 62:
            # Products may wrap around, the differences are in range again.
            wrapped = np.array([s & (1 << 64) - 1 for s in self.sums], np.uint64).view(np.int64)
            return x * np.int64(self.count) - wrapped
        return x.astype(object) * self.count - np.array(self.sums, dtype=object)

    def squares(self, deviations: np.ndarray) -> np.ndarray:
        """Sum of squares of each row, exact."""
        if (self.count * self.spread) ** 2 * max(1, self.size) >= 1 << 63:
            deviations = deviations.astype(object)
        return (deviations * deviations).sum(axis=1)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(np.float64) / self.count @ (self.directions / np.sqrt(self.eigenvalues))


def fixed_point(rows: DataFrame, id_column: str, vector_column: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """The rows that take part, as (id, x array<long>) with x = floor(scale * entry) + offset."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56))
    good = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = good.where((F.size("v") > 0) & F.forall("v", sound))
    return good.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative integers (rows x dimensions), lowest first: dimensions x bits x words over rows."""
    rows, size = y.shape
    padded = np.zeros((-(-rows // 64) * 64, size), np.int64)
    padded[:rows] = y
    out = np.empty((size, bits, len(padded) // 64), np.uint64)
    for bit in range(bits):
        packed = np.packbits((padded >> bit & 1).astype(np.uint8), axis=0)
        out[:, bit] = np.ascontiguousarray(packed.T).view(np.uint64)
    return out


def _scatter(y: np.ndarray, bits: int, into: np.ndarray) -> None:
    """Add the cross-products of a block to ``into`` (dimensions x dimensions x limbs; upper half)."""
    planes = _planes(y, bits)
    size, _, words = planes.shape
    flat = planes.reshape(size * bits, words)
    for i in range(size):
        for a in range(bits):
            if not planes[i, a].any():
                continue
            both = np.bitwise_count(planes[i, a] & flat[i * bits :]).sum(axis=1, dtype=np.int64).reshape(-1, bits)
            for b in range(bits):
                limb, weight = divmod(a + b, LIMB_BITS)
                into[i, i:, limb] += both[:, b] << weight


def cross_products(distinct: DataFrame, size: int, low: int, high: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums per dimension of x, and the centred cross-products times the number of rows, all exact."""
    bits = max(1, (high - low).bit_length())
    limbs = 1 + (2 * bits - 2) // LIMB_BITS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(_matrix(batch.column(0), size) - low)
            held += len(batch)
            if held >= BLOCK_ROWS:
                yield np.concatenate(waiting)
                waiting, held = [], 0
        if held:
            yield np.concatenate(waiting)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1, limbs), np.int64)
        for block in blocks(batches):
            for at in range(0, len(block), BLOCK_ROWS):
                part = block[at : at + BLOCK_ROWS]
                _scatter(np.column_stack([part, np.ones(len(part), np.int64)]), bits, total)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(size + 1), pa.int32()), "counts": [total[i, i:].tobytes() for i in range(size + 1)]}
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(counts, np.int64)
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"i": pa.array(sums, pa.int32()), "counts": [s.tobytes() for s in sums.values()]})

    schema = "i int, counts binary"
    added = distinct.mapInArrow(count, schema).repartition("i").mapInArrow(add, schema).collect()
    products = [[0] * (size + 1) for _ in range(size + 1)]
    for row in added:
        parts = np.frombuffer(row.counts, np.int64).reshape(-1, limbs).tolist()
        for j, limbs_of in enumerate(parts, row.i):
            value = sum(part << LIMB_BITS * k for k, part in enumerate(limbs_of))
            products[row.i][j] = products[j][row.i] = value
    n, shifted = products[size][size], products[size][:size]
    centred = [[n * products[i][j] - shifted[i] * shifted[j] for j in range(size)] for i in range(size)]
    return n, [s + n * low for s in shifted], centred


def fit(xs: DataFrame, components: int = 16) -> Whitening | None:
    """Statistics and components of the distinct vectors of (id, x); None without any vector."""
    shape = (
        xs.groupBy(F.size("x").alias("size"))
        .agg(F.count("*").alias("rows"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
        .orderBy(F.desc("rows"), F.desc("size"))
        .first()
    )
    if shape is None:
        return None
    distinct = materialize(xs.where(F.size("x") == shape["size"]).select("x").distinct(), "fit")
    n, sums, centred = cross_products(distinct, shape["size"], shape.low, shape.high)
    # Division of integers rounds once, however long they are.
    values, vectors = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in centred]))
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > len(sums) * np.finfo(float).eps * values.max()][:components]
    directions = vectors[:, order]
    for column in directions.T:
        column *= np.sign(column[np.argmax(np.abs(column))])
    trace = sum(centred[i][i] for i in range(len(sums))) / (n * n)
    model = Whitening(n, sums, shape.high - shape.low, values[order], directions, trace)
    model.identity_error = _identity_error(distinct, model) if order else 0.0
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(model.eigenvalues)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = model.project(model.deviations(_matrix(batch.column(0), model.size)))
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        a, b = np.indices(total.shape)
        columns = [pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "total"])

    summed = distinct.mapInArrow(moments, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1, k + 1))
    for row in summed.collect():
        total[row.a, row.b] = row.total / model.count
    covariance = total[:k, :k] - np.outer(total[:k, k], total[:k, k])
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(xs: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row of (id, x) that ``model`` fits and component: id, component (from 1), n, deviation (the exact sum over dimensions of
    (n * x - sum)^2, in digits), whitened, eigenvalue, explained, identity_error."""
    kind = next(f for f in xs.schema.fields if f.name == "id")
    made = StructType([StructField("id", kind.dataType)])
    made = made.add("deviation", StringType()).add("z", ArrayType(DoubleType()))

    def map_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations = model.deviations(_matrix(batch.column("x"), model.size))
            digits = pa.array([str(s) for s in model.squares(deviations).tolist()], pa.string())
            z = np.ascontiguousarray(model.project(deviations))
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), digits, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["id", "deviation", "z"]
            )

    if model is None or not len(model.eigenvalues):
        rows, values, shares = xs.limit(0).select("id", F.lit("").alias("deviation"), F.array(F.lit(0.0)).alias("z")), [0.0], [0.0]
    else:
        rows = xs.where(F.size("x") == model.size).mapInArrow(map_rows, made)
        values, shares = model.eigenvalues.tolist(), (model.eigenvalues / model.trace).tolist()
    at = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("place") + 1)
    return rows.select("id", "deviation", F.posexplode("z").alias("place", "whitened")).select(
        "id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.count if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        at(values).alias("eigenvalue"),
        at(shares).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten every row that takes part."""
    xs = fixed_point(rows, id_column, vector_column)
    return whitened(xs, fit(xs, components))
