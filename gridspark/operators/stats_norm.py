"""The normal distribution; parameters broadcast with the argument."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridspark.errors import NonFiniteError, ValidationError, require
from gridspark.frame import TensorFrame, flat_grid, joined
from gridspark.functions.guards import ensure, finite, no_nan
from gridspark.functions.special import erf, polynomial
from gridspark.operators.random import uniform
from gridspark.plans import shapes
from gridspark.sources import tensors

# Acklam's rational approximation of the normal quantile, highest power first, and where its tails begin.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _of(x: TensorFrame, loc: TensorFrame, scale: TensorFrame, where: str, value, probability: bool = False) -> TensorFrame:
    require(all(t.is_float for t in (x, loc, scale)), ValidationError, where, "float tensors are needed")
    df, shape = joined([x, loc, scale], where)
    v, m, s = (no_nan(F.col(c), where) for c in ("v0", "v1", "v2"))
    if not probability:
        v = ensure(v, F.abs(v) == float("inf"), NonFiniteError, where, "an infinite argument")
    else:
        v = ensure(v, (v < 0) | (v > 1), ValidationError, where, "a probability is not 0 to 1")
    s = ensure(s, s <= 0, ValidationError, where, "the scale must be positive")
    out = finite(value(v, m, s), where)
    return x.with_df(df.select(*[f"i{d}" for d in range(len(shape))], out.alias("v")), shape)


def pdf(x, loc, scale) -> TensorFrame:
    return _of(x, loc, scale, "norm.pdf", lambda v, m, s: F.exp(F.lit(-0.5) * (v - m) / s * ((v - m) / s)) / (s * math.sqrt(2 * math.pi)))


def logpdf(x, loc, scale) -> TensorFrame:
    return _of(x, loc, scale, "norm.logpdf", lambda v, m, s: F.lit(-0.5) * (v - m) / s * ((v - m) / s) - F.ln(s) - 0.5 * math.log(2 * math.pi))


def cdf(x, loc, scale) -> TensorFrame:
    return _of(x, loc, scale, "norm.cdf", lambda v, m, s: F.lit(0.5) * (1 + erf((v - m) / (s * math.sqrt(2)))))


def quantile(q: Column) -> Column:
    """The standard normal quantile; infinite at 0 and 1."""
    middle = q - 0.5
    square = middle * middle
    centre = middle * polynomial(square, ACKLAM_A) / polynomial(square, ACKLAM_B)

    def tail(p: Column) -> Column:  # of the lower end; p is kept above 0 so that its logarithm exists
        r = F.sqrt(F.lit(-2.0) * F.ln(F.greatest(p, F.lit(1e-300))))
        return polynomial(r, ACKLAM_C) / polynomial(r, ACKLAM_D)

    inf = F.lit(float("inf"))
    return (
        F.when(q <= 0, -inf).when(q >= 1, inf).when(q < TAIL, tail(q)).when(q > 1 - TAIL, -tail(F.lit(1.0) - q)).otherwise(centre)
    )


def ppf(q, loc, scale) -> TensorFrame:
    return _of(q, loc, scale, "norm.ppf", lambda v, m, s: m + s * quantile(v), probability=True)


def isf(q, loc, scale) -> TensorFrame:
    return _of(q, loc, scale, "norm.isf", lambda v, m, s: m + s * quantile(F.lit(1.0) - v), probability=True)


def uniforms(spark: SparkSession, shape, seed: int, float32: bool = False) -> TensorFrame:
    shape = shapes.checked(shape, "rvs")
    grid = TensorFrame(flat_grid(spark, shape).withColumn("v", F.lit(0.0)), shape)
    return grid.with_df(grid.df.select(*grid.coords, uniform(grid.flat(), seed, float32).alias("v")))


def rvs(spark: SparkSession, loc, scale, shape, seed: int = 0, float32_uniforms: bool = False) -> TensorFrame:
    """Draws of the given shape; the parameters must broadcast to it."""
    u = uniforms(spark, shape, seed, float32_uniforms)
    require(shapes.broadcast([u.shape, loc.shape, scale.shape], "norm.rvs") == u.shape, ValidationError, "norm.rvs", "the parameters don't fit the shape")
    return ppf(u, loc, scale)


def randn(spark: SparkSession, shape, seed: int = 0) -> TensorFrame:
    return rvs(spark, tensors.scalar(spark, 0.0), tensors.scalar(spark, 1.0), shape, seed)


def mean(loc, scale) -> TensorFrame:
    return loc


def var(loc, scale) -> TensorFrame:
    return scale.map(lambda v: finite(no_nan(v, "norm.var") * v, "norm.var"))


def stddev(loc, scale) -> TensorFrame:
    return scale


__all__ = ["cdf", "isf", "logpdf", "mean", "pdf", "ppf", "randn", "rvs", "stddev", "var"]
