"""Reductions: partial sums in each task, then one exchange of a row for each result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.errors import ValidationError, require
from gridspark.frame import TensorFrame, UINT64
from gridspark.functions import unsigned
from gridspark.functions.guards import finite, no_nan
from gridspark.operators import elementwise
from gridspark.plans import shapes
from gridspark.plans.scan import running_sum
from gridspark.sources import tensors


def _aggregated(t: TensorFrame, axis: int | None, value: Column, where: str, dtype: str | None = None, spark=None) -> TensorFrame:
    """One aggregate over everything, or along an axis that stays as a dimension of 1."""
    kind = TensorFrame(dtype=dtype or t.dtype).sql_type
    if axis is None:
        df = t.df.agg(value.cast(kind).alias("v")).select(F.lit(0).cast("long").alias("i0"), "v")
        return t.with_df(df, (1,), dtype)
    axis = shapes.axis_of(axis, t.rank, where)
    others = [c for d, c in enumerate(t.coords) if d != axis]
    df = t.df.groupBy(*others).agg(value.cast(kind).alias("v")).withColumn(f"i{axis}", F.lit(0).cast("long"))
    return t.with_df(df.select(*t.coords, "v"), tuple(1 if d == axis else n for d, n in enumerate(t.shape)), dtype)


def _checked(t: TensorFrame, where: str) -> Column:
    return no_nan(F.col("v"), where) if t.is_float else F.col("v")


def sum(t: TensorFrame, axis: int | None = None, spark=None) -> TensorFrame:  # noqa: A001
    """Sum; of an empty tensor (given a session) a single 0. Unsigned sums wrap."""
    if not t.rank:
        require(spark is not None, ValidationError, "sum", "an empty tensor needs a session")
        return tensors.zeros(spark, (1,), t.dtype)
    total = F.sum(_checked(t, "sum"))
    return _aggregated(t, axis, finite(total, "sum") if t.is_float else unsigned.wrapped(total), "sum")


def _counted(t: TensorFrame, axis: int | None, where: str) -> int:
    require(t.rank > 0, ValidationError, where, "an empty tensor")
    require(t.is_float, ValidationError, where, "only float tensors are supported")
    return t.num_elements if axis is None else t.shape[shapes.axis_of(axis, t.rank, where)]


def mean(t: TensorFrame, axis: int | None = None) -> TensorFrame:
    n = _counted(t, axis, "mean")
    return _aggregated(t, axis, finite(F.sum(_checked(t, "mean")), "mean") / F.lit(float(n)), "mean")


def _variance(t: TensorFrame, axis: int | None, ddof: int, where: str) -> Column:
    n = _counted(t, axis, where)
    require(0 <= ddof < n, ValidationError, where, f"ddof {ddof} with {n} values")
    value = F.var_pop(_checked(t, where))
    return finite(value * F.lit(n / (n - ddof)), where)


def var(t: TensorFrame, axis: int | None = None, ddof: int = 0) -> TensorFrame:
    """Variance with the divisor n - ddof, in one pass with Spark's mergeable moments."""
    return _aggregated(t, axis, _variance(t, axis, ddof, "var"), "var")


def stddev(t: TensorFrame, axis: int | None = None, ddof: int = 0) -> TensorFrame:
    return _aggregated(t, axis, F.sqrt(_variance(t, axis, ddof, "stddev")), "stddev")


def argmax(t: TensorFrame, axis: int | None = None) -> TensorFrame:
    """Position of the first maximum; infinities are ordinary values."""
    require(t.rank > 0, ValidationError, "argmax", "an empty tensor")
    at = t.flat() if axis is None else F.col(f"i{shapes.axis_of(axis, t.rank, 'argmax')}")
    best = F.max(F.struct(_checked(t, "argmax").alias("v"), (-at).alias("at")))
    return _aggregated(t, axis, -best["at"], "argmax", UINT64)


def cumsum(t: TensorFrame, axis: int | None = None, spark=None) -> TensorFrame:
    """Running sum along an axis, or over all elements in row-major order as a vector."""
    if not t.rank:
        require(spark is not None, ValidationError, "cumsum", "an empty tensor needs a session")
        return tensors.zeros(spark, (1,), t.dtype)
    if axis is None:
        df = t.df.select(t.flat().alias("i0"), "v")
        t, axis = t.with_df(df, (t.num_elements,)), 0
    axis = shapes.axis_of(axis, t.rank, "cumsum")
    kind = t.sql_type if t.is_float else "decimal(38,0)"
    source = t.df.withColumn("v", _checked(t, "cumsum"))
    others = [c for d, c in enumerate(t.coords) if d != axis]
    df = running_sum(source, others, F.col(f"i{axis}"), t.shape[axis], "v", "_sum", kind)
    value = finite(F.col("_sum"), "cumsum") if t.is_float else unsigned.wrapped(F.col("_sum"))
    return t.with_df(df.select(*t.coords, value.alias("v")))


def center(t: TensorFrame, axis: int) -> TensorFrame:
    return elementwise.sub(t, mean(t, axis))
