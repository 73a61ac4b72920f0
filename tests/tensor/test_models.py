import math

import numpy as np
import pytest

from gridspark.errors import BoundsError, ComputationError, NanError, NonFiniteError, ValidationError
from gridspark.functions import special
from gridspark.frame import EMPTY
from gridspark.operators import elementwise, linalg, ml, nn, reduce
from gridspark.operators import stats_chisquare as chi2
from gridspark.operators import stats_norm as norm
from gridspark.operators.random import GOLDEN, MULTIPLIER
from gridspark.sources import tensors as T
from tests.tensor.test_core import same


@pytest.fixture
def t(spark):
    return lambda values, shape=None, dtype="float": T.from_values(spark, values, shape, dtype)


def test_matmul(t):
    rng = np.random.default_rng(0)
    for a, b in (((2, 3), (3, 2)), ((3,), (3,)), ((3,), (3, 2)), ((2, 3), (3,)), ((2, 1, 2, 3), (1, 3, 3, 2)), ((4, 2, 3), (3, 2)), ((3,), (2, 3, 2))):
        x, y = rng.normal(size=a), rng.normal(size=b)
        want = x @ y
        same(linalg.matmul(t(x), t(y)), want.reshape(want.shape or (1,)))
    same(linalg.matmul(t(np.arange(1, 7), (2, 3), "uint64"), t(np.arange(7, 13), (3, 2), "uint64")), [[58, 64], [139, 154]])
    with pytest.raises(ValidationError):
        linalg.matmul(t([[1.0, 2.0]]), t([[1.0, 2.0]]))
    with pytest.raises(NanError):
        linalg.matmul(t([[math.nan]]), t([[1.0]])).rows()
    with pytest.raises(NonFiniteError):
        linalg.matmul(t([1e200, 1e200]), t([1e200, 1e200])).rows()


def test_matmul_by_blocks(t, monkeypatch):
    monkeypatch.setattr(linalg, "BLOCK_PRODUCTS", 0)
    monkeypatch.setattr(linalg, "BLOCK_ELEMENTS", 40)
    rng = np.random.default_rng(1)
    for a, b in (((5, 37), (37, 4)), ((2, 1, 3, 11), (1, 3, 11, 2)), ((3, 2, 9), (9, 4))):
        x, y = rng.normal(size=a), rng.normal(size=b)
        same(linalg.matmul(t(x), t(y)), x @ y)


def test_cov(t):
    x = [[2.1, 8], [2.5, 12], [4, 14]]
    same(linalg.cov(t(x), ddof=1), np.cov(np.array(x).T), 1e-9)
    y = np.random.default_rng(2).normal(size=(2, 3, 4, 5))
    flat = y.transpose(2, 3, 0, 1).reshape(4, 15, 2)[:, :, :]
    want = np.stack([np.cov(flat[b].T, ddof=0) for b in range(4)])
    same(linalg.cov(t(y), [3, 0], [1]), np.stack([np.cov(y[:, :, b, :].transpose(2, 0, 1).reshape(10, 3).T, ddof=0) for b in range(4)]))
    assert want.shape == (4, 2, 2)
    for bad in (lambda: linalg.cov(t(y), [], [1]), lambda: linalg.cov(t(y), [1], [1]), lambda: linalg.cov(t(x), ddof=3)):
        with pytest.raises(ValidationError):
            bad()
    with pytest.raises(BoundsError):
        linalg.cov(t(x), [5], [0])


def test_eig(t):
    values, vectors = linalg.eig(t([[2.0, 0, 0], [0, 3, 4], [0, 4, 9]]))
    same(values, [[2, 1, 11]], 1e-6)
    same(vectors, [[1, 0, 0], [0, 0.894427, 0.447214], [0, -0.447214, 0.894427]], 1e-5)
    values, _ = linalg.eig(t([[4.0, 2, -2], [2, 7, 3], [-2, 3, 9]]))
    same(values, [[1.58338673, 7.21995753, 11.19665574]], 1e-6)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3, 5, 5))
    a = a + a.transpose(0, 2, 1)
    values, vectors = linalg.eig(t(a))
    w, q = values.to_numpy(), vectors.to_numpy()
    assert np.allclose(q * w @ q.transpose(0, 2, 1), a, atol=1e-6) and np.allclose(q.transpose(0, 2, 1) @ q, np.eye(5), atol=1e-9)
    with pytest.raises(NanError):
        linalg.eig(t([[math.nan]]))[0].rows()
    with pytest.raises(ValidationError):
        linalg.eig(t([[1.0, 2.0]]))


def test_one_hot(t):
    same(ml.one_hot_expand_at(t([[1.0, 2, 0, 4], [5, 6, 2, 8]]), 1, 2, 3), [[1, 2, 1, 0, 0, 4], [5, 6, 0, 0, 1, 8]])
    same(ml.one_hot_expand_at(t([[[7.0, 2, 9]]]), 2, 1, 3, 11), [[[7, 0, 0, 11, 9]]])
    with pytest.raises(ValidationError):
        ml.one_hot_expand_at(t([3.0]), 0, 0, 3).rows()
    with pytest.raises(BoundsError):
        ml.one_hot_expand_at(t([3.0]), 0, 1, 3)


def test_losses(t):
    x = np.array([[0.0, 1], [2, 3]])
    same(ml.softmax(t(x)), np.exp(x) / np.exp(x).sum())
    same(ml.softmax(t(x), 1), np.exp(x) / np.exp(x).sum(1, keepdims=True))
    with pytest.raises(NonFiniteError):
        ml.softmax(t([100.0, 1.0])).rows()
    eye = np.eye(2)[None]
    same(ml.cross_entropy(t(np.zeros((2, 2))), t(eye), 2), [math.log(2)])
    loss = ml.cross_entropy(t(np.zeros((2, 2))), t(eye), 2, reduction_mean=False)
    same(loss, np.full((1, 2, 1), math.log(2)))
    same(ml.cross_entropy(t([[0.9, 0.1], [0.1, 0.9]]), t(np.eye(2)), 1, from_logits=False), [-math.log(0.9)])
    same(ml.mean_squared_error(t([1.0, 2, 3, 4]), t([1.0])), [14])
    same(ml.mean_squared_error(t(x), t(np.zeros((2, 2))), 0), [((x**2).sum(0)).mean()])
    with pytest.raises(NonFiniteError):
        ml.cross_entropy(t([0.0, 1.0]), t([0.0, 1.0]), from_logits=False).rows()


def test_pca(t):
    x = np.array([[1.0, 2, 3], [4, 5, 6], [2, 3, 2]])
    got = ml.pca(t(x))
    same(got.explained_variance, [[2.787087, 0.212913, 0]], 1e-5)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, q = np.linalg.eigh(np.cov(z.T))
    q = q[:, ::-1]
    assert np.allclose(np.abs(got.loadings.to_numpy()[:, :2]), np.abs(q[:, :2]), atol=5e-3)
    assert np.allclose(np.abs(got.projections.to_numpy()[:, :2]), np.abs(z @ q)[:, :2], atol=5e-3)
    two = ml.pca(t(np.stack([x, x * 2])), 2, False)
    assert two.projections.shape == (2, 3, 2) and two.loadings.shape == (2, 3, 2) and two.explained_variance.shape == (2, 1, 2)
    same(ml.pca(t([[1.0, 2], [3, 4], [5, 6]]), standardize=False).explained_variance, [[8, 0]], 1e-6)
    with pytest.raises(ComputationError):
        ml.pca(t([[1.0, 2], [1, 4], [1, 6]])).explained_variance.rows()
    with pytest.raises(ValidationError):
        ml.pca(t(x), 4)


def conv(x, k, s, p):
    x = np.pad(x, ((0, 0), (p[0], p[0]), (p[1], p[1])))
    k = k[:, :, ::-1, ::-1]
    h, w = (x.shape[1] - k.shape[2]) // s[0] + 1, (x.shape[2] - k.shape[3]) // s[1] + 1
    out = np.zeros((k.shape[0], h, w))
    for i in range(h):
        for j in range(w):
            out[:, i, j] = (k * x[None, :, i * s[0] : i * s[0] + k.shape[2], j * s[1] : j * s[1] + k.shape[3]]).sum((1, 2, 3))
    return out


def conv_t(x, k, s, p, u):
    out = np.zeros((k.shape[1], (x.shape[1] - 1) * s + k.shape[2], (x.shape[2] - 1) * s + k.shape[3]))
    for i in range(x.shape[1]):
        for j in range(x.shape[2]):
            out[:, i * s : i * s + k.shape[2], j * s : j * s + k.shape[3]] += np.einsum("c,cohw->ohw", x[:, i, j], k)
    out = np.pad(out, ((0, 0), (0, u[0]), (0, u[1])))
    return out[:, p[0] : out.shape[1] - p[0], p[1] : out.shape[2] - p[1]]


def test_conv2d(t):
    rng = np.random.default_rng(4)
    for ci, co, h, w, kh, kw, s, p in ((1, 1, 5, 5, 3, 3, 1, (0, 0)), (3, 2, 5, 5, 3, 3, 1, (1, 1)), (1, 1, 6, 6, 3, 3, 2, (0, 0)), (2, 2, 7, 5, 2, 3, 1, (1, 0)), (3, 4, 8, 8, 1, 1, 1, (2, 2))):
        x, k = rng.normal(size=(ci, h, w)), rng.normal(size=(co, ci, kh, kw))
        same(nn.conv2d(t(x), t(k), s, p), conv(x, k, (s, s), p))
    x = np.arange(1.0, 9).reshape(2, 1, 1, 2, 2)
    k = np.stack([np.ones((2, 2)), np.eye(2)])[None, :, None, None]
    out = nn.conv2d(t(x), t(k))
    same(out, np.array([10.0, 5, 26, 13]).reshape(2, 2, 1, 1, 1))
    for bad in (lambda: nn.conv2d(t(x), t(k), 0), lambda: nn.conv2d(t(np.ones((2, 4, 4))), t(np.ones((1, 1, 2, 2)))), lambda: nn.conv2d(t(np.ones((1, 2, 2))), t(np.ones((1, 1, 3, 3))))):
        with pytest.raises(ValidationError):
            bad()
    with pytest.raises(NanError):
        nn.conv2d(t(np.full((1, 2, 2), math.nan)), t(np.ones((1, 1, 2, 2)))).rows()


def test_conv2d_transpose(t):
    rng = np.random.default_rng(5)
    for ci, co, h, w, kh, kw, s, p, u in ((1, 1, 3, 3, 3, 3, 1, (0, 0), (0, 0)), (2, 3, 3, 4, 3, 2, 2, (1, 0), (1, 1)), (2, 1, 3, 3, 2, 3, 3, (1, 2), (1, 0))):
        x, k = rng.normal(size=(ci, h, w)), rng.normal(size=(ci, co, kh, kw))
        same(nn.conv2d_transpose(t(x), t(k), s, p, u), conv_t(x, k, s, p, u))
    x, k = rng.normal(size=(2, 1, 2, 3, 3)), rng.normal(size=(1, 3, 2, 4, 2, 2))
    out = nn.conv2d_transpose(t(x), t(k)).to_numpy()
    assert out.shape == (2, 3, 4, 4, 4) and np.allclose(out[1, 2], conv_t(x[1, 0], k[0, 2], 1, (0, 0), (0, 0)))


def test_normal(spark, t):
    zero, one = T.scalar(spark, 0.0), T.scalar(spark, 1.0)
    x = np.linspace(-4, 4, 33)
    same(norm.pdf(t(x), zero, one), np.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    same(norm.logpdf(t(x), t([1.0]), t([2.0])), -(((x - 1) / 2) ** 2) / 2 - math.log(2) - 0.5 * math.log(2 * math.pi))
    same(norm.cdf(t(x), zero, one), [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    q = norm.cdf(t(x), zero, one)
    same(norm.ppf(q, zero, one), x, 2e-8)
    same(norm.isf(q, zero, one), -x, 2e-8)
    same(norm.cdf(t([[0.0], [1.0]]), t([[0.0, 1.0, 2.0]]), t([1.0])), [[0.5 * (1 + math.erf((a - b) / math.sqrt(2))) for b in (0, 1, 2)] for a in (0, 1)])
    same(norm.var(zero, t([3.0])), [9])
    assert norm.mean(zero, one) is zero and norm.stddev(zero, one) is one
    for bad, kind in ((lambda: norm.pdf(t([1.0]), zero, t([0.0])), ValidationError), (lambda: norm.ppf(t([0.0]), zero, one), NonFiniteError), (lambda: norm.ppf(t([1.5]), zero, one), ValidationError), (lambda: norm.cdf(t([math.inf]), zero, one), NonFiniteError), (lambda: norm.cdf(t([math.nan]), zero, one), NanError)):
        with pytest.raises(kind):
            bad().rows()


def uniform(flat, seed):
    m = (1 << 64) - 1
    s = seed ^ ((flat + GOLDEN) & m)
    s ^= s >> 12
    s = (s ^ (s << 25)) & m
    s ^= s >> 27
    return s * MULTIPLIER % (1 << 64) / 2.0**64


def test_draws(spark, t):
    u = [uniform(k, 123456789) for k in range(20)]
    same(norm.uniforms(spark, (4, 5), 123456789), np.reshape(u, (4, 5)), 1e-15)
    want = norm.ppf(t(np.reshape(u, (4, 5))), t([2.5]), t([0.75])).to_numpy()
    same(norm.rvs(spark, t([2.5]), t([0.75]), (4, 5), 123456789), want, 1e-12)
    assert abs(norm.randn(spark, (2000,), 7).to_numpy().mean()) < 0.1
    same(chi2.rvs(spark, t([3.0]), (20,), 5), chi2.ppf(t([uniform(k, 5) for k in range(20)]), t([3.0])).to_numpy())
    with pytest.raises(ValidationError):
        norm.rvs(spark, t([1.0, 2.0]), t([1.0]), (3,), 1)


def test_chisquare(spark, t):
    x, k = np.linspace(0.01, 40, 50), np.array([[1.0], [2.0], [7.0], [20.0]])
    half = k / 2
    lg = np.array([[math.lgamma(v)] for v in half.ravel()])
    logpdf = (half - 1) * np.log(x) - x / 2 - half * math.log(2) - lg
    same(chi2.logpdf(t(x), t(k)), logpdf)
    same(chi2.pdf(t(x), t(k)), np.exp(logpdf))
    p = special.gamma_p(half, x / 2)
    assert np.allclose(p[0], [math.erf(math.sqrt(v / 2)) for v in x]) and np.allclose(p[1], 1 - np.exp(-x / 2))
    same(chi2.cdf(t(x), t(k)), p)
    q = np.linspace(0.05, 0.95, 10)
    got = chi2.ppf(t(q), t(k)).to_numpy()
    assert np.allclose(special.gamma_p(half, got / 2), q, atol=1e-12)
    same(chi2.isf(t(1 - q), t(k)), got, 1e-9)
    same(chi2.mean(t(k)), k)
    same(chi2.var(t(k)), 2 * k)
    same(chi2.stddev(t(k)), np.sqrt(2 * k))
    same(chi2.ppf(t([0.0]), t([3.0])), [0])
    for bad, kind in ((lambda: chi2.pdf(t([-1.0]), t([1.0])), ValidationError), (lambda: chi2.pdf(t([0.0]), t([1.0])), NonFiniteError), (lambda: chi2.logpdf(t([0.0]), t([2.0])), NonFiniteError), (lambda: chi2.cdf(t([1.0]), t([0.0])), ValidationError), (lambda: chi2.ppf(t([1.0]), t([2.0])), NonFiniteError), (lambda: chi2.mean(t([math.inf])), NonFiniteError), (lambda: chi2.mean(t([math.nan])), NanError)):
        with pytest.raises(kind):
            bad().rows()


def test_log_gamma(spark):
    from pyspark.sql import functions as F

    x = [0.05, 0.5, 1.0, 2.5, 30.0, 171.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(special.log_gamma(F.col("x")), special.erf(F.col("x"))).collect()
    assert np.allclose([r[0] for r in rows], [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.allclose([r[1] for r in rows], [math.erf(v) for v in x], rtol=1e-14)


def test_empty_operands(t):
    for f in (elementwise.sqrt, reduce.mean, ml.softmax, linalg.eig, ml.pca):
        with pytest.raises(ValidationError):
            f(EMPTY)


def test_tiles_of_both_outer_axes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(23, 17)), rng.normal(size=(17, 31))
    batch = rng.normal(size=(2, 9, 6))
    for name, value in (("BLOCK_PRODUCTS", 0), ("TILE", 7), ("BLOCK_ELEMENTS", 40)):
        monkeypatch.setattr(linalg, name, value)
    made = lambda x: T.from_values(spark, x)
    assert np.allclose(linalg.matmul(made(a), made(b)).to_numpy(), a @ b)
    assert np.allclose(linalg.matmul(made(batch), made(batch[0].T)).to_numpy(), batch @ batch[0].T)


def test_few_and_many_events_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = 1e6 + rng.normal(size=(3, 40, 5)) * [1, 2, 3, 0.5, 1e-3]
    want = np.stack([np.cov(m.T) for m in x])
    for few in (16, 0):
        monkeypatch.setattr(linalg, "FEW_EVENTS", few)
        got = linalg.cov(T.from_values(spark, x), ddof=1).to_numpy()
        assert np.allclose(got, want, rtol=1e-6, atol=1e-8)


def test_covariance_spectrum_equals_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(50, 12)) @ rng.normal(size=(12, 12))
    values, vectors = linalg.eig(linalg.cov(T.from_values(spark, x)))
    v, q = values.to_numpy().ravel(), vectors.to_numpy()
    c = np.cov(x.T, ddof=0)
    assert np.allclose(np.sort(v), np.linalg.eigvalsh(c)) and np.isclose(v.sum(), np.trace(c))
    assert np.allclose(q.T @ q, np.eye(12)) and np.allclose(c @ q, q * v)
