"""Convolutions over several tiles with halos."""

import numpy as np
import pytest

from gridspark.operators import nn
from gridspark.sources import tensors as T
from tests.tensor.test_models import conv, conv_t


@pytest.mark.parametrize("sizes", [(5, 200), (4, 1)])
def test_many_tiles_equal_plain_loops(spark, monkeypatch, sizes):
    monkeypatch.setattr(nn, "TILE", sizes[0])
    monkeypatch.setattr(nn, "GROUP_ELEMENTS", sizes[1])
    rng = np.random.default_rng(1)
    for s, p, k in ((1, (1, 1), 3), (2, (0, 3), 4), (3, (2, 2), 2), (7, (0, 0), 1)):
        x, w = rng.normal(size=(3, 2, 13, 17)), rng.normal(size=(2, 2, k, k))
        got = nn.conv2d(T.from_values(spark, x), T.from_values(spark, w), s, p).to_numpy()
        assert np.allclose(got, np.stack([conv(m, w, (s, s), p) for m in x]))
        u = (1, 0) if s > 1 else (0, 0)
        p = tuple(min(q, k - 1) for q in p)
        got = nn.conv2d_transpose(T.from_values(spark, x), T.from_values(spark, w), s, p, u).to_numpy()
        assert np.allclose(got, np.stack([conv_t(m, w, s, p, u) for m in x]))


def test_tiles_of_padding_alone(spark, monkeypatch):
    monkeypatch.setattr(nn, "TILE", 4)
    x, w = np.random.default_rng(2).normal(size=(1, 3, 3)), np.ones((1, 1, 2, 2))
    got = nn.conv2d(T.from_values(spark, x), T.from_values(spark, w), 1, (9, 9)).to_numpy()
    assert np.allclose(got, conv(x, w, (1, 1), (9, 9)))
    got = nn.conv2d_transpose(T.from_values(spark, x), T.from_values(spark, w), 6, (0, 0), (5, 5)).to_numpy()
    assert np.allclose(got, conv_t(x, w, 6, (0, 0), (5, 5)))


def test_one_exchange_of_the_input_whatever_the_kernel(spark):
    x = T.from_values(spark, np.ones((40, 1, 8, 8)))
    for k in (1, 5):
        df = nn.conv2d(x, T.from_values(spark, np.ones((3, 1, k, k)))).df
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_kernels_of_their_own_still_meet_their_images(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(2, 1, 5, 5)), rng.normal(size=(2, 2, 1, 3, 3))
    got = nn.conv2d(T.from_values(spark, x), T.from_values(spark, w)).to_numpy()
    assert np.allclose(got, np.stack([conv(a, b, (1, 1), (0, 0)) for a, b in zip(x, w)]))
