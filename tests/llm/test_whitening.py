"""Whitening against eigenvectors of the covariance matrix."""

import numpy as np
import pytest

from veridict.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, deviation string"


def exact(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], v[:, ::-1]


def table(spark, vectors, more=()):
    rows = [(i, [float(c) for c in v], "w", None) for i, v in enumerate(vectors)] + [(*m, "w", None) for m in more]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def compared(spark, vectors, components, more=()):
    model = whitening.fit(table(spark, vectors, more), components)
    got = {r.vec_id: r for r in whitening.whiten(table(spark, vectors, more), model).collect()}
    x, n, s, e, v = exact(vectors)
    k = len(model.eigenvalues)
    assert model.n == n and sorted(got) == list(range(len(vectors)))
    assert np.allclose(model.eigenvalues, e[:k], rtol=1e-10) and np.allclose(model.explained, e[:k] / e.sum(), rtol=1e-10)
    assert model.identity_error < 1e-9
    assert [got[i].deviation for i in range(len(x))] == [sum(int(c) ** 2 for c in row) for row in n * x - s]
    return model, np.array([got[i].whitened for i in range(len(x))]), (((n * x - s) / n) @ v)[:, :k] / np.sqrt(e[:k])


def test_against_eigenvectors_with_repeated_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 12)) * np.linspace(1, 4, 12) + 5
    vectors = [*base, *[base[7]] * 60, base[9]]
    unusable = [(900, None), (901, [1.0] * 11 + [float("nan")]), (902, [float("inf")] * 12), (903, [None] * 12), (904, []), (905, [1.0, 2.0])]
    model, got, want = compared(spark, vectors, 5, unusable)
    assert len(model.eigenvalues) == 5 and np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    signs = np.sign(got / want)
    assert (signs == signs[0]).all()


def test_equal_eigenvalues_are_all_found(spark):
    """The corners of a cube: every eigenvalue is repeated, so one Krylov space can't hold them all."""
    corners = [[(i >> j & 1) * 2.0 for j in range(5)] for i in range(32)]
    model, got, _ = compared(spark, corners, 4)
    assert np.allclose(model.explained, 0.2) and np.allclose(got.T @ got / 32, np.eye(4), atol=1e-9)


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(4)
    flat = rng.integers(-5, 6, (80, 2)) @ rng.integers(-3, 4, (2, 6)) + 100.0
    model, got, want = compared(spark, flat, 16)
    assert len(model.eigenvalues) == 2 and np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_early_end_is_exact(spark):
    """With a steep spectrum the steps end early, with the same result."""
    rng = np.random.default_rng(5)
    steep = rng.standard_normal((300, 30)) * 40 / 3.0 ** np.arange(30)
    model, got, want = compared(spark, steep, 2)
    assert model.steps < 30 and np.allclose(np.abs(got), np.abs(want), atol=1e-9)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    df = table(spark, vectors, [(9, None)])
    model = whitening.fit(df)
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "deviation", "whitened"]
    assert model.n == bool(vectors) and [(r.deviation, r.whitened) for r in got.collect()] == [(0, [])] * len(vectors)


def test_large_deviations_are_exact(spark):
    model, _, _ = compared(spark, [[2.0**23, 0.0], [-(2.0**22), 1.0], [0.0, 3.0]], 2)
    assert len(model.eigenvalues) == 2


def test_query(spark):
    got = whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas().sort_values(["vec_id", "component"])
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    x, n, s, e, v = exact(np.stack(vectors.embedding))
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert (got.n == n).all() and list(got.component[:16]) == list(range(1, 17)) and len(got) == 16 * len(vectors)
    assert (got.deviation.to_numpy()[::16] == ((n * x - s) ** 2).sum(axis=1)).all()
    want = (((n * x - s) / n) @ v[:, :16]) / np.sqrt(e[:16])
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(-1, 16)), np.abs(want), atol=1e-8)
    assert np.allclose(got.explained[:16], e[:16] / e.sum()) and got.identity_error.max() < 1e-10
