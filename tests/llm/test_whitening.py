"""Whitening against numpy's eigenvectors of the covariance, and on rows that are dropped."""

import numpy as np
import pytest

from tomeflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, X int"


def whole(vectors):
    return np.floor(np.array(vectors, np.float32).astype(np.float64) * 64).astype(np.int64) + 1000000


def check(found, kept, dims):
    """found: rows of the result; kept: (vec_id, vector) of the rows that remain."""
    x = whole([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = (fit - total / n).T @ (fit - total / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(dims, 16)
    assert len(found) == k * len(kept) and {r.component for r in found} == set(range(1, k + 1))
    z = (x - total / n) @ vectors[:, :k] / np.sqrt(values[:k])
    want = {}
    for (i, _), row, own in zip(kept, x.tolist(), z, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, total.tolist(), strict=True))
        for c in range(k):
            want.setdefault((i, c + 1), []).append((deviation, own[c]))
    signs = {}
    for r in found:
        deviation, value = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
        if abs(value) > 1e-3:
            signs.setdefault(r.component, set()).add(r.whitened * value > 0)
        assert abs(r.whitened) == pytest.approx(abs(value), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_whitened_equals_eigenvectors(spark):
    rows = queries.QUERIES["op13_lobpcg_whitening"](spark, "/root/testdata/sf0.01").collect()
    kept = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(rows, kept, 64)


def test_dropped_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32) * [3, 2, 1, 5, 4]]) for i in range(40)]
    kept = [*good, good[0], (None, good[1][1]), (99, good[2][1])]
    odd = [(100, None), (101, []), (102, [1.0] * 4), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [float("nan")] * 5), (105, [float("inf")] * 5), (106, [1e30] * 5)]
    table = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in kept + odd], SCHEMA).repartition(3)
    check(whitening.whitened(table).collect(), kept, 5)


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, "x", 1), (2, [1.0, 2.0], 0, "x", 1)], SCHEMA)
    assert whitening.whitened(one).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "x", 1) for i in range(20)], SCHEMA)
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_deviation_beyond_a_long_stops(spark):
    table = spark.createDataFrame([(i, [float(i) * 1e9, 1.0], 0, "x", 1) for i in range(100)], SCHEMA)
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whitened(table).collect()


def test_lobpcg_where_blocks_do_not_span():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = np.sort(rng.uniform(1, 2, 400))[::-1]
    values[:30] += np.linspace(3, 0.1, 30)
    matrix, calls = (q * values) @ q.T, []
    e, u = whitening.lobpcg(lambda x: calls.append(1) or matrix @ x, 400, 16)
    assert np.allclose(e, values[:16], rtol=1e-12) and len(calls) < 200
    assert np.abs(np.abs((u * q[:, :16]).sum(axis=0)) - 1).max() < 1e-10


def test_sums_are_exact(spark):
    x = [[(1 << 45) + i, -(1 << 45) - 3 * i, i] for i in range(1000)]
    centre = whitening.centre_of(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(4))
    assert [int(b) * centre.n + int(r) for b, r in zip(centre.base, centre.rest, strict=True)] == [sum(v[k] for v in x) for k in range(3)]
