import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import ann


def exact(vectors, query, k):
    scores = sorted(((-float(np.dot(v, vectors[query])), i) for i, v in vectors.items() if i != query))
    return [(i, -s) for s, i in scores[:k]]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(24) * (1 + i % 3) for i in range(1500)}
    rows = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, score int")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows.collect()}
    found = {}
    for r in ann.nearest(spark, rows, F.col("id") % 50 == 0, k=10).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(found) == set(range(0, 1500, 50))
    hits = 0
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(abs(s - float(np.dot(vectors[i], vectors[query]))) < 1e-9 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for i, _ in exact(vectors, query, 10)})
    assert hits / (10 * len(found)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0])]
    rows += [(9, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [-1.0, 0.0]), (13, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(spark, frame, F.col("id") % 20 == 0, k=20).collect())
    # Fewer candidates than k: all of them; ties by id; never the query itself.
    assert [g[:3] for g in got] == [
        (0, 1, 11), (0, 2, 20), (0, 3, 3), (0, 4, 12),
        (20, 1, 0), (20, 2, 11), (20, 3, 3), (20, 4, 12),
    ]
    assert [g[3] for g in got[:4]] == pytest.approx([1.0, 1.0, 0.5, -1.0])


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(spark, empty, F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(spark, one, F.lit(True)).collect() == []
