"""Whitening by filtered subspace iteration equals numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import whitening
from docquarry.llm.queries import op12_whitening


def plain(rows, k=4):
    """(vec_id, x) of what stays, n, sums as Python integers, eigenvalues and eigenvectors of the covariance."""
    kept = [(i, [min(max(math.floor(256.0 * c), -(1 << 63)), (1 << 63) - 1) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (d - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[float(v * n - s) / n for v, s in zip(x, sums, strict=True)] for x in fit]).reshape(n, d)
    values, vectors = np.linalg.eigh(a.T @ a / max(n, 1)) if d else (np.zeros(0), np.zeros((0, 0)))
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def check(df, rows, close=1e-9):
    kept, n, sums, values, vectors = plain(rows)
    k = min(4, len(values))
    found = df.collect()
    assert len(found) == k * len(kept)
    by = {}
    for r in found:
        by.setdefault((str(r.vec_id), r.component), []).append(r)
    signs = {}
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        for c in range(1, k + 1):
            same = by[str(i), c]
            r = next((r for r in same if r.deviation == (deviation if deviation < 1 << 63 else None)), None)
            assert r is not None and r.n == n
            e = values[c - 1]
            if e <= 1e-13 * max(values[0], 0):
                assert r.whitened is None and r.explained == 0
                continue
            want = float(np.dot([float(v * n - s) / n for v, s in zip(x, sums, strict=True)], vectors[:, c - 1])) / math.sqrt(e)
            if c not in signs and abs(want) > 1e-3:
                signs[c] = math.copysign(1, want * r.whitened)
            assert min(abs(q.whitened - signs.get(c, 1) * want) for q in same if q.deviation == r.deviation) <= close * max(1, abs(want))
            assert abs(r.explained / (e / values.sum()) - 1) <= 1e-9 and r.identity_error <= 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    spread = rng.standard_normal((400, 40)) * np.linspace(1.0, 0.2, 40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0] + 3
    rows = [(k, v.tolist()) for k, v in enumerate(spread)]
    rows += rows[:150] * 2 + [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (None, rows[3][1])]
    check(whitening.whitened(frame(spark, rows)), rows)


@pytest.mark.parametrize("rows", [
    [(1, [0.5, -0.25]), (2, [0.1, 0.9]), (2, [0.1, 0.9]), (3, [-1.0, -0.0])],
    [(1, [0.5, 0.25, 1.0])] * 3,
    [(1, []), (2, [0.5]), (3, [0.25, 2.0, 0.1]), (4, [0.3, 1.0])],
    [(k, [k / 3, 2 * k / 3, 0.0, 1.0, 5.0, -k / 3]) for k in range(12)],
])
def test_few_dimensions_and_flat_ones(spark, rows):
    check(whitening.whitened(frame(spark, rows)), rows)


def test_nothing_left(spark):
    for rows in ([], [(1, None), (2, [None])], [(1, []), (2, [])]):
        df = whitening.whitened(frame(spark, rows) if rows else spark.createDataFrame([], "vec_id long, embedding array<double>"))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_values(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (v * 1e7).tolist()) for k, v in enumerate(rng.standard_normal((60, 6)) * [1, 2, 3, 4, 5, 6])]
    check(whitening.whitened(frame(spark, rows)), rows, 1e-7)
    huge = whitening.whitened(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 0.5])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id < 3} == {None}


def test_equal_and_close_values(spark):
    cross = [(k, [s if j == k // 2 else 0.0 for j in range(30)]) for k, s in ((k, 1.0 if k % 2 else -1.0) for k in range(60))]
    found = whitening.whitened(frame(spark, cross)).collect()
    assert all(r.identity_error < 1e-9 and abs(r.explained - 1 / 30) < 1e-6 for r in found)
    for c in range(1, 5):
        assert abs(np.mean([r.whitened**2 for r in found if r.component == c]) - 1) < 1e-9


def test_ids_and_extra_columns(spark):
    rows = [(k, [k % 7 / 3, k % 5 / 2, k % 3 / 1.0]) for k in range(40)]
    df = frame(spark, rows).selectExpr("cast(vec_id as string) vec_id", "embedding", "1 x", "2 n", "3 component", "4 whitened", "5 place")
    assert whitening.whitened(df).schema["vec_id"].dataType.simpleString() == "string"
    check(whitening.whitened(df), [(str(i), v) for i, v in rows])


def test_certified_or_an_error(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = frame(spark, [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 40)))])
    fit = whitening.integral(x).select("x").distinct()
    model = whitening.fitted(fit)
    assert model.residuals.max() <= whitening.ENOUGH * model.values[0] and np.abs(model.components.T @ model.components - np.eye(4)).max() < 1e-13
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="certified"):
        whitening.fitted(fit)


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    df = op12_whitening(spark, data)
    check(df, rows)
    assert df.agg(F.max("identity_error")).first()[0] <= 1e-4
