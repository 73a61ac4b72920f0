"""The chi-square distribution; the degrees of freedom broadcast with the argument."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridspark.errors import NonFiniteError, ValidationError, require
from gridspark.frame import TensorFrame, joined
from gridspark.functions.guards import ensure, finite, no_nan
from gridspark.functions.special import gamma_p_column, gamma_p_inverse_column, log_gamma
from gridspark.operators.stats_norm import uniforms
from gridspark.plans import shapes


def _degrees(k: Column, where: str) -> Column:
    k = finite(no_nan(k, where), where)
    return ensure(k, k <= 0, ValidationError, where, "the degrees of freedom must be positive")


def _of(x: TensorFrame, k: TensorFrame, where: str, value, probability: bool = False, infinite: bool = False) -> TensorFrame:
    require(x.is_float and k.is_float, ValidationError, where, "float tensors are needed")
    df, shape = joined([x, k], where)
    v = no_nan(F.col("v0"), where)
    bad = (v < 0) | (v > 1) if probability else v < 0
    v = ensure(v, bad, ValidationError, where, "an argument lies outside")
    if not probability:
        v = ensure(v, v == float("inf"), NonFiniteError, where, "an infinite argument")
    out = value(v, _degrees(F.col("v1"), where))
    out = out if infinite else finite(out, where)
    return x.with_df(df.select(*[f"i{d}" for d in range(len(shape))], out.alias("v")), shape)


def _log_density(v: Column, k: Column) -> Column:
    safe = F.when(v == 0, F.lit(1.0)).otherwise(v)
    return (k / 2 - 1) * F.ln(safe) - v / 2 - k / 2 * math.log(2) - log_gamma(k / 2)


def pdf(x, k, infinite: bool = False) -> TensorFrame:
    """Density; at 0 it is infinite below two degrees (an error), 1/2 at two and 0 above. With ``infinite`` it is e to ``logpdf`` there: infinity, NaN, 0."""
    at_two = float("nan") if infinite else 0.5
    at_zero = lambda n: F.when(n < 2, F.lit(float("inf"))).when(n == 2, F.lit(at_two)).otherwise(F.lit(0.0))
    return _of(x, k, "chisquare.pdf", lambda v, n: F.when(v == 0, at_zero(n)).otherwise(F.exp(_log_density(v, n))), infinite=infinite)


def logpdf(x, k, infinite: bool = False) -> TensorFrame:
    """Logarithm of the density; 0 is an error. With ``infinite``: infinity below two degrees, NaN (0 times -inf) at two, -inf above."""
    inf = float("inf")
    at_zero = lambda n: F.when(n < 2, F.lit(inf)).when(n == 2, F.lit(float("nan"))).otherwise(F.lit(-inf))
    return _of(x, k, "chisquare.logpdf", lambda v, n: F.when(v == 0, at_zero(n)).otherwise(_log_density(v, n)), infinite=infinite)


def cdf(x, k) -> TensorFrame:
    return _of(x, k, "chisquare.cdf", lambda v, n: gamma_p_column(n / 2, v / 2))


def ppf(q, k) -> TensorFrame:
    return _of(q, k, "chisquare.ppf", lambda v, n: 2 * gamma_p_inverse_column(n / 2, v), probability=True)


def isf(q, k) -> TensorFrame:
    return _of(q, k, "chisquare.isf", lambda v, n: 2 * gamma_p_inverse_column(n / 2, F.lit(1.0) - v), probability=True)


def rvs(spark: SparkSession, k, shape, seed: int = 0, float32_uniforms: bool = False) -> TensorFrame:
    """Draws of the given shape; the degrees of freedom must broadcast to it."""
    u = uniforms(spark, shape, seed, float32_uniforms)
    require(shapes.broadcast([u.shape, k.shape], "chisquare.rvs") == u.shape, ValidationError, "chisquare.rvs", "the parameter doesn't fit the shape")
    return ppf(u, k)


def mean(k) -> TensorFrame:
    return k.map(lambda v: _degrees(v, "chisquare.mean"))


def var(k) -> TensorFrame:
    return k.map(lambda v: finite(2 * _degrees(v, "chisquare.var"), "chisquare.var"))


def stddev(k) -> TensorFrame:
    return k.map(lambda v: F.sqrt(2 * _degrees(v, "chisquare.stddev")))
