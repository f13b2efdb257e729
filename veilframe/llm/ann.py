"""Nearest neighbours by collision counting over query-centred windows.

Vectors get one more component, which makes all lengths equal and turns the largest inner product into the
smallest distance. Each of ``projections`` random directions keeps a sorted array of its projections. A query opens a window around
its own projection in every array; the windows widen round by round (virtual rehashing), and only the added ends of
each window are walked. A vector that has been met in at least ``threshold`` of the windows is verified with its inner product in
double precision. A query ends once its windows are so wide that a vector at the distance of its k-th best so far would have passed
the threshold with ``confidence`` standard deviations to spare; nothing is cut off by a number of candidates.

The index is a table: one row per shard of about ``SHARD_ROWS`` vectors (by hash of the id) with its sorted arrays. Queries come in
blocks of bounded size, each broadcast and answered by every shard; shards' best are merged per query.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, neither do vectors whose number
of components isn't the table's most frequent one (ties: the larger number), nor rows without an id. Rows with the same id are one vector, the
smallest. Ties go to the smaller id. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.session import materialize

SHARD_ROWS = 4096
QUERY_ROWS = 16_384
TOGETHER = 32


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Distinct ids with vectors that take part, as (id, v array<double>)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector_column).cast("array<double>")
    good = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    one = good.groupBy("id").agg(F.min("v").alias("v"))
    sizes = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return one.where(F.size("v") == (sizes.n if sizes else 0))


def _directions(size: int, projections: int) -> np.ndarray:
    return np.random.default_rng(20_240_601).standard_normal((size + 1, projections))


def build(rows: DataFrame, projections: int = 16) -> DataFrame:
    """The index: shard, ids, vectors and, for each direction, its sorted projections with the places they belong to."""
    count, norm, size = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    shards = max(1, math.ceil((count or 0) / SHARD_ROWS))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.stack(group["v"].to_numpy())
        extra = np.sqrt(np.maximum(0.0, norm - (x * x).sum(axis=1)))
        values = np.column_stack([x, extra]) @ _directions(size, projections)
        order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        ordered = np.take_along_axis(values.T, order, 1)
        return pd.DataFrame(
            {
                "shard": [key[0]],
                "ids": [group["id"].to_numpy(np.int64).tobytes()],
                "vectors": [x.tobytes()],
                "lengths": [float(norm)],
                "ordered": [ordered.tobytes()],
                "places": [np.ascontiguousarray(order).tobytes()],
            }
        )

    schema = "shard long, ids binary, vectors binary, lengths double, ordered binary, places binary"
    by_shard = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return by_shard.groupBy("shard").applyInPandas(pack, schema)


class Shard:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.norm = row["lengths"]
        self.ordered = np.frombuffer(row["ordered"], np.float64).reshape(-1, len(self.ids))
        self.places = np.frombuffer(row["places"], np.int32).reshape(-1, len(self.ids))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, share: float, confidence: float) -> Iterator[tuple]:
        m = len(self.ordered)
        length = math.sqrt(self.norm)
        scaled = q / np.linalg.norm(q, axis=1, keepdims=True) * length
        centre = scaled @ _directions(q.shape[1], m)[:-1]
        threshold = math.ceil(share * m)
        # Windows half as wide as ``passing`` standard deviations are met by a vector at that distance often enough.
        passing = _quantile(min(0.99, (1 + share) / 2 + confidence * math.sqrt(share * (1 - share) / m) / 2))
        for at in range(0, len(q), TOGETHER):
            part = slice(at, at + TOGETHER)
            yield from self._search(ids[part], q[part], centre[part], k, threshold, passing, length)

    def _search(
        self, ids: np.ndarray, q: np.ndarray, centre: np.ndarray, k: int, threshold: int, passing: float, length: float
    ) -> Iterator[tuple]:
        (b, m), n = centre.shape, len(self.ids)
        inner = q @ self.x.T  # of the whole block at once; a vector counts only once it has passed the threshold
        inner[self.ids == ids[:, None]] = -np.inf
        low = np.stack([np.searchsorted(self.ordered[j], centre[:, j]) for j in range(m)], axis=1)
        high, hits, passed = low.copy(), np.zeros(b * n, np.int32), np.zeros((b, n), bool)
        active, half, base = np.arange(b), length * 0.5 * passing, np.arange(m) * n
        sizes_of = np.linalg.norm(q, axis=1)
        places = self.places.ravel()
        while len(active):
            at, ends = centre[active], ((-half, "left"), (half, "right"))
            new_low, new_high = (
                np.stack([np.searchsorted(self.ordered[j], at[:, j] + d, side=side) for j in range(m)], axis=1) for d, side in ends
            )
            # Only what the windows have gained at either end is walked.
            starts = np.concatenate([new_low + base, high[active] + base], axis=1)
            sizes = np.concatenate([low[active] - new_low, new_high - high[active]], axis=1)
            low[active], high[active] = new_low, new_high
            ends = np.cumsum(sizes.ravel())
            walked = places[np.repeat(starts.ravel() - (ends - sizes.ravel()), sizes.ravel()) + np.arange(ends[-1])]
            hits += np.bincount(walked + np.repeat(active * n, sizes.sum(axis=1)), minlength=b * n).astype(np.int32)
            passed[active] = hits.reshape(b, n)[active] >= threshold
            scores = np.where(passed[active], inner[active], -np.inf)
            best = np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
            # A vector that scores like the k-th best is this far away; the windows must make sure of it.
            near = np.sqrt(np.maximum(0.0, 2 * self.norm - 2 * np.where(np.isfinite(best), best, 0) * length / sizes_of[active]))
            done = np.isfinite(best) & (half >= passing * near) | (new_low.max(axis=1) == 0) & (new_high.min(axis=1) == n)
            active, half = active[~done], half * 1.2
        for query in range(b):
            scores = np.where(passed[query], inner[query], -np.inf)
            least = np.partition(scores, n - k)[n - k] if n > k else -np.inf
            near = np.flatnonzero(np.isfinite(scores) & (scores >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0)))
            # Once more row by row, so that equal vectors get equal scores.
            exact = (self.x[near] * q[query]).sum(axis=1)
            order = np.lexsort((self.ids[near], -exact))[:k]
            yield ids[query], self.ids[near[order]], exact[order]


def _quantile(p: float) -> float:
    """The standard normal quantile, by bisection."""
    low, high = -8.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * (1 + math.erf(middle / math.sqrt(2))) < p else (low, middle)
    return low


def search(
    spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.5, confidence: float = 1.0
) -> DataFrame:
    """The ``k`` nearest indexed vectors of every query (id, v) but itself: query_id, rank, id, score."""
    total = queries.count()
    blocks = max(1, math.ceil(total / QUERY_ROWS))
    answers = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        ids = np.array(rows["id"].to_numpy(), np.int64)
        vectors = np.array(rows["v"].to_pylist(), np.float64)
        sent = spark.sparkContext.broadcast((ids, vectors))

        def answer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    for query, near, score in Shard(row).search(ids, vectors, k, share, confidence) if len(ids) else ():
                        columns = [np.full(len(near), query), near, score]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "score"])

        part = index.mapInArrow(answer, "query_id long, id long, score double")
        answers = part if answers is None else answers.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def nearest(
    spark: SparkSession, rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20
) -> DataFrame:
    """Index all rows and search for those that ``is_query`` (a condition on ``id``) picks."""
    vectors = materialize(usable(rows, id_column, vector_column), "vectors")
    return search(spark, materialize(build(vectors), "index"), vectors.where(is_query), k)
