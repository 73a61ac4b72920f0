"""Spectra by blocks of columns, and components by panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.errors import ComputationError, NanError
from gridspark.operators import linalg, ml, spectra
from gridspark.sources import tensors as T


def matrix(spark, x):
    """A large matrix, without a row for each element on the driver's side of the plan."""
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(np.asarray(x))], "k long, x array<double>")
    return T.from_array_column(rows, "k", "x", *np.shape(x))


@pytest.mark.parametrize("slots", [2, 4, 8, 10])
def test_every_pair_of_blocks_meets_once(spark, slots):
    df = spark.range(slots).withColumnRenamed("id", "slot")
    met = set()
    for step in range(slots - 1):
        pairs = {}
        for r in df.select("slot", spectra.pair_of(F.col("slot"), step, slots).alias("p")).collect():
            pairs.setdefault(r.p, []).append(r.slot)
        assert all(len(x) == 2 for x in pairs.values())
        met.update(tuple(sorted(x)) for x in pairs.values())
    assert len(met) == slots * (slots - 1) // 2


def test_512_rows_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(512, 512))
    x = x + x.T
    values, vectors = linalg.eig(matrix(spark, np.triu(x)))  # the upper triangle counts
    v, q = values.to_numpy().ravel(), vectors.to_numpy()
    want, basis = np.linalg.eigh(x)
    assert np.abs(v - want[::-1]).max() < 1e-6
    assert np.abs(np.abs((q * basis[:, ::-1]).sum(0)) - 1).max() < 1e-6
    assert np.abs(q.T @ q - np.eye(512)).max() < 1e-9


def test_batches_ties_and_odd_sizes(spark, monkeypatch):
    monkeypatch.setattr(linalg, "EIG_TASK", 4)
    monkeypatch.setattr(spectra, "BLOCK_ELEMENTS", 24)
    monkeypatch.setattr(spectra, "LEAST_COLUMNS", 2)
    monkeypatch.setattr(spectra, "STEPS", 2)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(7, 7))
    x = np.stack([m + m.T, np.diag([1.0, -1, 0, 0, 2, -1, 1]), np.fliplr(np.eye(7)), np.zeros((7, 7))])
    values, vectors = linalg.eig(T.from_values(spark, x))
    v, q = values.to_numpy(), vectors.to_numpy()
    for k in range(4):
        assert np.allclose(v[k, 0], np.linalg.eigvalsh(x[k])[::-1], atol=1e-9)
        assert np.allclose(x[k] @ q[k], q[k] * v[k], atol=1e-8) and np.allclose(q[k].T @ q[k], np.eye(7), atol=1e-9)
    top = linalg.eig(T.from_values(spark, x), largest=2)
    assert top[0].shape == (4, 1, 2) and np.allclose(top[0].to_numpy(), v[:, :, :2]) and top[1].shape == (4, 7, 2)
    x[0, 1, 2] = np.nan
    with pytest.raises(NanError):
        linalg.eig(T.from_values(spark, x))[0].rows()


def by_numpy(x, k, standardize):
    x = x - x.mean(0)
    x = x / x.std(0, ddof=1) if standardize else x
    _, s, v = np.linalg.svd(x, full_matrices=False)
    return s[:k] ** 2 / (len(x) - 1), np.abs(x @ v[:k].T), np.abs(v[:k].T)


@pytest.mark.parametrize("standardize", [True, False])
def test_components_of_embeddings(spark, standardize):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    got = ml.pca(T.from_array_column(df, "vec_id", "embedding", *x.shape), 3, standardize)
    variances, projections, loadings = by_numpy(x, 3, standardize)
    assert np.allclose(got.explained_variance.to_numpy()[0], variances, rtol=1e-9)
    assert np.allclose(np.abs(got.projections.to_numpy()), projections, atol=1e-6)
    assert np.allclose(np.abs(got.loadings.to_numpy()), loadings, atol=1e-7)
    assert got.projections.shape == (len(x), 3) and got.loadings.shape == (64, 3)


def test_components_of_more_columns_than_a_basis_holds(spark):
    """Restarts: 300 columns, bases of 60 vectors, and a spectrum without large gaps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 300)) * np.linspace(2, 1, 300)
    got = ml.pca(matrix(spark, x), 2, False)
    variances, projections, _ = by_numpy(x, 2, False)
    assert np.allclose(got.explained_variance.to_numpy()[0], variances, rtol=1e-9)
    assert np.allclose(np.abs(got.projections.to_numpy()), projections, atol=1e-5)


def test_rank_below_the_panel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 40))
    got = ml.pca(matrix(spark, x), 3, False)
    variances, projections, _ = by_numpy(x, 3, False)
    assert np.allclose(got.explained_variance.to_numpy()[0], variances, atol=1e-9)
    assert np.allclose(np.abs(got.projections.to_numpy()), projections, atol=1e-6)


def test_constant_and_nan_columns(spark):
    x = np.random.default_rng(5).normal(size=(10, 20))
    x[:, 3] = 1.0
    with pytest.raises(ComputationError):
        ml.pca(matrix(spark, x), 2).projections.rows()
    x[2, 5] = np.nan
    with pytest.raises(NanError):
        ml.pca(matrix(spark, x), 2).projections.rows()
