"""Arithmetic with broadcasting, comparison, and functions of single values: projections over joined operands."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.errors import ComputationError, NanError, NonFiniteError, ValidationError, raised, require
from gridspark.frame import FLOAT, TensorFrame, joined
from gridspark.functions import unsigned
from gridspark.functions.guards import ensure, finite, no_nan
from gridspark.operators.autograd import AddEdge

INF = float("inf")
FLOAT32_MAX = 3.4028234663852886e38


def _binary(a: TensorFrame, b: TensorFrame, where: str, real, whole, bad=None) -> TensorFrame:
    require(a.dtype == b.dtype, ValidationError, where, "operands of different element types")
    df, shape = joined([a, b], where)
    x, y = F.col("v0"), F.col("v1")
    if a.is_float:
        value = finite(real(no_nan(x, where), no_nan(y, where)), where)
        if bad is not None:
            value = ensure(value, bad(x, y) & ~F.isnan(x) & ~F.isnan(y), ComputationError, where, "division by zero")
    else:
        value = whole(x, y)
        if bad is not None:
            value = F.when(bad(x, y), F.raise_error(F.lit(f"{ComputationError.prefix}: {where}: division by zero")).cast(unsigned.TYPE)).otherwise(value)
    location = "DEVICE" if "DEVICE" in (a.memory_location, b.memory_location) else "HOST"
    coords = [f"i{d}" for d in range(len(shape))]
    return TensorFrame(df.select(*coords, value.cast(a.sql_type).alias("v")), shape, a.dtype, memory_location=location)


def add(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """Sum; the one operator that records where its result came from."""
    out = _binary(a, b, "add", lambda x, y: x + y, lambda x, y: unsigned.wrapped(x + y))
    if a.requires_grad or b.requires_grad:
        out = replace(out, requires_grad=True)
        out = replace(out, source_function=AddEdge((a, b)))
    return out


def sub(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return _binary(a, b, "sub", lambda x, y: x - y, lambda x, y: unsigned.wrapped(x - y))


def mul(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return _binary(a, b, "mul", lambda x, y: x * y, unsigned.multiply)


def div(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """Quotient; a zero divisor is the computation error, after NaN and before infinities. Unsigned values truncate."""
    safe = lambda y: F.when(y == 0, F.lit(1.0)).otherwise(y)
    whole = lambda x, y: (x - F.pmod(x, F.when(y == 0, F.lit(1)).otherwise(y))).cast("decimal(38,0)") / F.when(y == 0, F.lit(1)).otherwise(y)
    return _binary(a, b, "div", lambda x, y: x / safe(y), whole, bad=lambda x, y: y == 0)


def neg(t: TensorFrame) -> TensorFrame:
    """Negation; infinities may pass, -0.0 stays, unsigned values wrap."""
    require(t.rank > 0, ValidationError, "neg", "an empty operand")
    return t.map(lambda v: -no_nan(v, "neg")) if t.is_float else t.map(lambda v: unsigned.wrapped(-v.cast("decimal(38,0)")))


def equal(a: TensorFrame, b: TensorFrame) -> bool:
    """Whether the shapes and all elements are equal; NaN equals nothing; two empty tensors are equal."""
    if a.shape != b.shape or a.dtype != b.dtype:
        return False
    if not a.shape:
        return True
    with raised():
        df, _ = joined([a, b], "equal")
        same = F.col("v0") == F.col("v1")
        if a.is_float:
            same = same & ~F.isnan("v0")
        return df.agg(F.count_if(same).alias("n")).first()["n"] == a.num_elements


def _float(t: TensorFrame, where: str) -> None:
    require(t.rank > 0, ValidationError, where, "an empty operand")
    require(t.is_float, ValidationError, where, "only float tensors are supported")


def sqrt(t: TensorFrame) -> TensorFrame:
    _float(t, "sqrt")
    return t.map(lambda v: finite(F.sqrt(no_nan(v, "sqrt")), "sqrt"))


def exp(t: TensorFrame) -> TensorFrame:
    """e^v; what 32-bit floats can't hold is the non-finite error."""
    _float(t, "exp")
    return t.map(lambda v: single(F.exp(no_nan(v, "exp")), "exp"))


def single(value: Column, where: str) -> Column:
    """A value within the range of 32-bit floats."""
    return ensure(value, F.isnan(value) | (F.abs(value) > FLOAT32_MAX), NonFiniteError, where, "a result is not finite")


def log(t: TensorFrame, infinite: bool = False) -> TensorFrame:
    """Natural logarithm; 0 is the non-finite error, or -inf with ``infinite``."""
    _float(t, "log")

    def value(v: Column) -> Column:
        v = no_nan(v, "log")
        outside = (v < 0) | (v == INF) if infinite else (v <= 0) | (v == INF)
        return ensure(F.when(v == 0, F.lit(-INF)).otherwise(F.ln(F.when(outside, F.lit(1.0)).otherwise(v))), outside, NonFiniteError, "log", "a result is not finite")

    return t.map(value)


def power(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return _binary(a, b, "pow", F.pow, unsigned.power)


def factorial(t: TensorFrame) -> TensorFrame:
    """v! of whole values from 0; what 32-bit floats can't hold is the non-finite error. Unsigned values wrap."""
    require(t.rank > 0, ValidationError, "factorial", "an empty operand")
    if not t.is_float:
        wraps = [1]
        for k in range(1, 66):  # from 66 on the product is a multiple of 2^64
            wraps.append(wraps[-1] * k % unsigned.MODULUS)
        table = F.array(*[unsigned.literal(x).cast(unsigned.TYPE) for x in wraps])
        return t.map(lambda v: F.when(v > 65, F.lit(0).cast(unsigned.TYPE)).otherwise(F.element_at(table, F.least(v, F.lit(65)).cast("int") + 1)))
    products = [float(reduce(lambda x, y: x * y, range(1, k + 1), 1)) for k in range(35)]
    table = F.array(*[F.lit(x) for x in products])

    def value(v: Column) -> Column:
        whole = F.round(v)
        found = F.element_at(table, F.least(F.greatest(whole, F.lit(0.0)), F.lit(34.0)).cast("int") + 1)
        found = ensure(found, whole > 34, NonFiniteError, "factorial", "a result is not finite")
        found = ensure(found, F.abs(v - whole) > 1e-6, ValidationError, "factorial", "a value is not whole")
        found = ensure(found, v < 0, ValidationError, "factorial", "a negative value")
        found = ensure(found, F.abs(v) == INF, NonFiniteError, "factorial", "an infinite value")
        return ensure(found, F.isnan(v), NanError, "factorial", "NaN in the input")

    return t.map(value)


def relu(t: TensorFrame) -> TensorFrame:
    _float(t, "relu")
    return t.map(lambda v: finite(F.greatest(F.lit(0.0), no_nan(v, "relu")), "relu"))


__all__ = ["FLOAT", "add", "div", "equal", "exp", "factorial", "log", "mul", "neg", "power", "relu", "sqrt", "sub"]
