from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from mercato.llm import whitening as w
from mercato.llm.queries import LLM_QUERIES


def exact_covariance(x):
    n = len(x)
    sums = [sum(int(v) for v in column) for column in x.T]
    centred = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    size = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(size)] for i in range(size)])
    return cov, [sum(v * v for v in row) for row in centred], np.array(centred, float) / n


def held_against_brute_force(rows, x_by_id, limit=32):
    ids = list(x_by_id)
    cov, deviations, centred = exact_covariance(np.array([x_by_id[i] for i in ids]))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(limit, sum(values > len(cov) * 4e-16 * cov.diagonal().max()))
    assert len(rows) == len(ids) * size
    want = centred @ vectors[:, :size] / np.sqrt(values[:size])
    got = np.full(want.shape, np.nan)
    place = {name: i for i, name in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviations[place[r.vec_id]]
        assert math.isclose(r.explained, values[r.component - 1] / cov.trace(), rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
    signs = np.sign((want * got).sum(0))
    assert np.allclose(got * signs, want, atol=1e-6)
    assert np.allclose(got.T @ got / len(ids), np.eye(size), atol=1e-9)


def test_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = {
        r.vec_id: [math.floor(64 * c) + 1_000_000 for c in r.embedding]
        for r in table
        if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)
    }
    held_against_brute_force(LLM_QUERIES["op12_embedding_whitening"](spark, sf_dir).collect(), good)


@pytest.mark.parametrize("size", [1, 2, 5, 24, 41])
def test_cholesky_and_jacobi(size):
    random = np.random.default_rng(size)
    rows = random.normal(size=(size + 3, size)) * 10.0 ** random.integers(-1, 3, size)
    matrix = rows.T @ rows
    factor = w.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix, rtol=1e-10, atol=1e-10 * matrix.max())
    order = np.argsort([np.flatnonzero(row)[-1] if row.any() else 0 for row in factor], kind="stable")
    assert np.allclose(np.triu(factor[order], 1), 0)
    values, vectors = w.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=1e-9, atol=1e-9 * matrix.max())
    assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-10)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-9 * matrix.max())


def test_small_variances_keep_their_digits():
    """A graded matrix: squaring the factor again would lose the least eigenvalues."""
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    matrix = scale @ (np.eye(6) + 0.3) @ scale
    values, _ = w.one_sided_jacobi(w.pivoted_cholesky(matrix))
    assert math.isclose(np.prod(values), np.linalg.det(np.eye(6) + 0.3) * 10.0 ** -(2 * 30), rel_tol=1e-9)


def test_dependent_and_constant_dimensions(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(200):
        a, b = (float(v) for v in random.integers(-9, 9, 2))
        rows.append((i, [a, b, a + b, 5.0, -a]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = w.fit(table.repartition(7))
    assert len(model.variances) == 2 and model.identity_error < 1e-9
    assert math.isclose(sum(model.explained), 1, rel_tol=1e-12)
    flat = w.fit(spark.createDataFrame([(1, [2.0]), (2, [2.0])], table.schema))
    assert flat.n == 2 and len(flat.variances) == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**40 + i * 2**20), float(i % 3)]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    model = w.fit(table)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    cov, deviations, _ = exact_covariance(x)
    assert model.sums == [int(s) for s in x.sum(0)]
    assert np.allclose(model.variances, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12)
    got = {r.vec_id: r.deviation for r in w.whiten(table, model).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(deviations)}


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, whitened string, n string, deviation string, component string"
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, -inf], [1.0, 2.0, 3.0], [4.0, 1.0], [4.0, 1.0]]
    rows = [(i, v, "a", "b", "c", "d") for i, v in enumerate(vectors)] + [(None, [0.5, 0.25], "a", "b", "c", "d")]
    table = spark.createDataFrame(rows, schema)
    model = w.fit(table)
    found = w.whiten(table, model)
    assert found.columns == ["vec_id", "deviation", "whitened"]
    assert model.n == 4 and sorted(str(r.vec_id) for r in found.collect()) == ["0", "8", "9", "None"]
    nothing = spark.createDataFrame([], schema)
    model = w.fit(nothing)
    assert model.n == 0 and w.whiten(nothing, model).count() == 0
