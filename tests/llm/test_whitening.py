from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

from veilframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, Component string, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], SCHEMA).repartition(3)


def brute_force(vectors):
    """n, {vector: deviation}, covariance as floats of exact fractions."""
    xs = [tuple(int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v in vectors]
    fit = sorted(set(xs))
    n, size = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(size)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(size)] for i in range(size)]
    return n, sums, xs, np.array([[float(c) for c in row] for row in cov])


def check(got, vectors, components):
    n, sums, xs, cov = brute_force(vectors)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(got) == len(vectors) * components
    directions = None
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for (vec_id, _), x in zip(vectors, xs, strict=True):
        rows = by_id[vec_id]
        assert sorted(rows) == list(range(1, components + 1))
        assert rows[1].n == n
        assert rows[1].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    for c in range(1, components + 1):
        assert got[0].identity_error <= 1e-9
        shares = {by_id[i][c].explained for i in by_id}
        assert len(shares) == 1 and shares.pop() == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-6)
    # Recover each component from the whitened rows: it must be a unit eigenvector.
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in xs])
    z = np.array([[by_id[i][c].whitened for c in range(1, components + 1)] for i, _ in vectors])
    directions = np.linalg.lstsq(centred, z, rcond=None)[0] * np.sqrt(values[:components])
    assert np.abs(np.linalg.norm(directions, axis=0) - 1).max() < 1e-6
    assert np.abs(cov @ directions - directions * values[:components]).max() < 1e-6 * values[0]


def test_query_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(queries.whitening(spark, SF).collect(), vectors, 16)


def test_counts_are_exact_over_several_blocks_and_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 96)
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**40), 2**40, (500, 3))
    x[:, 2] = rng.integers(-5, 5, 500)
    rows = spark.createDataFrame([([int(c) for c in r],) for r in x], "x array<long>").repartition(5)
    n, sums, centred = whitening.cross_products(rows, 3, int(x.min()), int(x.max()))
    exact = [[int(c) for c in r] for r in x]
    assert n == 500 and sums == [sum(r[i] for r in exact) for i in range(3)]
    assert centred == [[n * sum(r[i] * r[j] for r in exact) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def test_repeats_count_once_and_deviations_may_exceed_a_long(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(c) for c in rng.standard_normal(4) * 3]) for i in range(40)]
    vectors += [(100 + i, vectors[0][1]) for i in range(60)]
    found = whitening.whiten(frame(spark, vectors)).withColumnRenamed("id", "vec_id")
    check([r for r in found.withColumn("deviation", found.deviation.cast("decimal(38,0)")).collect()], vectors, 4)
    far = [(i, [float(i) * 1e12, float(i % 3)]) for i in range(5)]
    found = {r.id: int(r.deviation) for r in whitening.whiten(frame(spark, far)).collect()}
    n, sums, xs, _ = brute_force(far)
    assert found == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for (i, _), x in zip(far, xs, strict=True)}
    assert max(found.values()) > 1 << 63


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [-1.0, 0.5]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, -inf])]
    rows += [(8, [None, 1.0]), (9, [1.0]), (10, [1e30, 0.0]), (11, [0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted(((r.id or 0), r.component) for r in got) == sorted([(i, c) for i in (0, 1, 2, 2, 11) for c in (1, 2)])
    assert {r.n for r in got} == {4}
    assert got[0].identity_error < 1e-12


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [3.0]), (2, [3.0])], [(1, None)]):
        found = whitening.whiten(frame(spark, rows))
        assert found.collect() == []
        assert found.columns == ["id", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error"]
    # A direction without variance is no component.
    flat = whitening.whiten(frame(spark, [(i, [float(i), 1.0]) for i in range(4)])).collect()
    assert len(flat) == 4 and {r.component for r in flat} == {1}
