"""Sorting and ranking. NaN comes last in both directions, and equal values keep the order of their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.errors import ValidationError, require
from gridspark.frame import UINT64, TensorFrame, from_flat
from gridspark.plans import shapes
from gridspark.plans.scan import ranked, ranked_along


def _order(t: TensorFrame, at, descending: bool) -> list:
    nan = [F.isnan("v")] if t.is_float else []
    return [*nan, F.col("v").desc() if descending else F.col("v").asc(), at.asc()]


def _along(t: TensorFrame, axis: int, descending: bool) -> DataFrame:
    """The elements with ``_k``, their place in the order along the axis of a tensor of two or more."""
    others = [c for d, c in enumerate(t.coords) if d != axis]
    return ranked_along(t.df, others, _order(t, F.col(f"i{axis}"), descending), t.num_elements, t.shape[axis], "_k")


def sort(t: TensorFrame, axis: int | None = None) -> TensorFrame:
    """Ascending along an axis, or all elements into row-major order; the shape stays. An empty tensor stays empty."""
    if not t.rank:
        return t
    if axis is None:
        df = ranked(t.df.select(t.flat().alias("_k"), "v"), _order(t, F.col("_k"), False), t.num_elements, "k")
        return t.with_df(from_flat(df, t.shape))
    axis = shapes.axis_of(axis, t.rank, "sort")
    if t.rank == 1:
        df = ranked(t.df, _order(t, F.col("i0"), False), t.num_elements, "_k")
    else:
        df = _along(t, axis, False)
    return t.with_df(df.select(*[F.col("_k" if d == axis else c).alias(c) for d, c in enumerate(t.coords)], "v"))


def argsort(t: TensorFrame, axis: int | None = None, descending: bool = False) -> TensorFrame:
    """Positions in sorted order, along an axis or (as a vector) over all elements."""
    require(t.rank > 0, ValidationError, "argsort", "an empty tensor")
    whole = axis is None or t.rank == 1
    if axis is not None:
        axis = shapes.axis_of(axis, t.rank, "argsort")
    if whole:
        df = ranked(t.df.select(t.flat().alias("_at"), "v"), _order(t, F.col("_at"), descending), t.num_elements, "i0")
        out = df.select("i0", F.col("_at").cast(TensorFrame(dtype=UINT64).sql_type).alias("v"))
        return t.with_df(out, (t.num_elements,), UINT64)
    at = F.col(f"i{axis}")
    out = _along(t, axis, descending).select(*[F.col("_k" if d == axis else c).alias(f"_{c}") for d, c in enumerate(t.coords)], at.cast(TensorFrame(dtype=UINT64).sql_type).alias("v"))
    return t.with_df(out.toDF(*t.coords, "v"), dtype=UINT64)
