"""Operators that move elements without computing: reshaping, transposition, padding, up-sampling, gathering."""

from __future__ import annotations

from dataclasses import replace
from enum import Enum
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.errors import BoundsError, ValidationError, message, require
from gridspark.frame import BROADCAST_ELEMENTS, TensorFrame, flat_grid, from_flat, joined, small
from gridspark.plans import shapes
from gridspark.plans.scan import BLOCK


class UpsampleMode(Enum):
    ZEROS = 0
    NEAREST = 1


def _has(t: TensorFrame, where: str) -> None:
    require(t.rank > 0, ValidationError, where, "an empty tensor")


def reshape(t: TensorFrame, shape) -> TensorFrame:
    """The same row-major elements in another shape: a projection."""
    _has(t, "reshape")
    shape = shapes.checked(shape, "reshape")
    require(prod(shape) == t.num_elements, ValidationError, "reshape", f"{t.shape} has not as many elements as {shape}")
    return replace(t.with_df(from_flat(t.df.select(t.flat().alias("k"), "v"), shape), shape), requires_grad=t.requires_grad)


def transpose(t: TensorFrame, axes=None) -> TensorFrame:
    """Axes in another order, reversed if not given: columns are renamed."""
    _has(t, "transpose")
    axes = list(range(t.rank))[::-1] if axes is None else list(axes)
    require(len(axes) == t.rank, ValidationError, "transpose", "an entry for each axis is needed")
    axes = [shapes.axis_of(a, t.rank, "transpose") for a in axes]
    require(len(set(axes)) == t.rank, BoundsError, "transpose", "an axis is named twice")
    df = t.df.select(*[F.col(f"i{a}").alias(f"i{d}") for d, a in enumerate(axes)], "v")
    return replace(t.with_df(df, tuple(t.shape[a] for a in axes), view=True), requires_grad=t.requires_grad)


def copy_from(target: TensorFrame, source: TensorFrame) -> TensorFrame:
    """``target``'s shape filled with ``source``, broadcast."""
    _has(target, "copy_from")
    _has(source, "copy_from")
    require(source.rank <= target.rank, ValidationError, "copy_from", "the source has more axes than the target")
    require(shapes.broadcast([target.shape, source.shape], "copy_from") == target.shape, ValidationError, "copy_from", "the source doesn't fit")
    df, shape = joined([replace(target, literal=None), replace(source, literal=None)], "copy_from")
    return target.with_df(df.select(*target.coords, F.col("v1").alias("v")), shape)


def with_view_assigned(owner: TensorFrame, start, source: TensorFrame) -> TensorFrame:
    """``owner`` with the block from ``start`` replaced by ``source``, as a new tensor."""
    block = owner.view(start, source.shape)
    full = shapes.aligned(block.shape, owner.rank)
    lead = owner.rank - block.rank
    at = [F.lit(s).cast("long") + (F.col(f"i{d - lead}") if d >= lead else F.lit(0)) for d, s in enumerate(start)]
    inside = F.lit(True)
    for d, (s, n) in enumerate(zip(start, full)):
        inside = inside & F.col(f"i{d}").between(s, s + n - 1)
    fresh = source.df.select(*[c.alias(f"i{d}") for d, c in enumerate(at)], F.col("v").cast(owner.sql_type).alias("v"))
    return owner.with_df(owner.df.where(~inside).select(*owner.coords, "v").unionByName(fresh))


def _border(t: TensorFrame, shape: shapes.Shape, inside, value) -> TensorFrame:
    """The cells of ``shape`` that ``inside`` (a condition on coordinates) leaves out, all of one value."""
    grid = flat_grid(t.df.sparkSession, shape).where(~inside)
    return grid.withColumn("v", F.lit(value).cast(t.sql_type))


def pad(t: TensorFrame, top: int, bottom: int, left: int, right: int, value=0) -> TensorFrame:
    """A constant border around the last two axes."""
    _has(t, "pad")
    require(t.rank >= 2, ValidationError, "pad", "two axes are needed")
    require(min(top, bottom, left, right) >= 0, ValidationError, "pad", "a negative width")
    *lead, h, w = t.shape
    shape = shapes.checked((*lead, h + top + bottom, w + left + right), "pad")
    r, c = f"i{t.rank - 2}", f"i{t.rank - 1}"
    moved = t.df.select(*t.coords[:-2], (F.col(r) + top).alias(r), (F.col(c) + left).alias(c), "v")
    inside = F.col(r).between(top, top + h - 1) & F.col(c).between(left, left + w - 1)
    return t.with_df(moved.unionByName(_border(t, shape, inside, value)), shape)


def pad_symmetric(t: TensorFrame, height: int, width: int, value=0) -> TensorFrame:
    return pad(t, height, height, width, width, value)


def upsample(t: TensorFrame, stride: int, mode: UpsampleMode = UpsampleMode.ZEROS) -> TensorFrame:
    """The last two axes at ``stride`` times the resolution, n s - (s - 1) cells: zeros between, or repeats."""
    _has(t, "upsample")
    require(t.rank >= 3, ValidationError, "upsample", "three axes are needed")
    require(stride >= 1, ValidationError, "upsample", "the stride is 0")
    *lead, h, w = t.shape
    shape = shapes.checked((*lead, h * stride - stride + 1, w * stride - stride + 1), "upsample")
    r, c = f"i{t.rank - 2}", f"i{t.rank - 1}"
    if mode == UpsampleMode.ZEROS:
        moved = t.df.select(*t.coords[:-2], (F.col(r) * stride).alias(r), (F.col(c) * stride).alias(c), "v")
        inside = (F.col(r) % stride == 0) & (F.col(c) % stride == 0)
        return t.with_df(moved.unionByName(_border(t, shape, inside, 0)), shape)
    steps = F.explode(F.sequence(F.lit(0), F.lit(stride - 1)))
    df = t.df.withColumn("_r", steps).withColumn("_c", steps)
    df = df.select(*t.coords[:-2], (F.col(r) * stride + F.col("_r")).alias(r), (F.col(c) * stride + F.col("_c")).alias(c), "v")
    return t.with_df(df.where((F.col(r) < shape[-2]) & (F.col(c) < shape[-1])), shape)


#: A key with one of so many rows is frequent, and its rows are dealt to as many tasks.
SHARE = 256


def frequent(wanted: DataFrame, keys: list[str], rows: int) -> list[int]:
    """Hashes of the keys that hold 1 of SHARE of the rows: SHARE of them at most, by a summary that is merged."""
    top = wanted.select(F.xxhash64(*keys).alias("h")).agg(F.expr(f"approx_top_k(h, {2 * SHARE}, {16 * SHARE})").alias("top"))
    return [r["item"] for r in top.first()["top"] or [] if r["count"] * SHARE >= rows]


def salted(wanted: DataFrame, source: DataFrame, keys: list[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows that want a frequent key are dealt to SHARE salts, with which its source rows repeat."""
    often = F.xxhash64(*keys).isin(hot)
    dealt = F.when(often, F.pmod(F.xxhash64(*wanted.columns), F.lit(SHARE))).otherwise(F.lit(0)).cast("int")
    salts = F.when(often, F.sequence(F.lit(0), F.lit(SHARE - 1))).otherwise(F.array(F.lit(0)))
    return wanted.withColumn("_salt", dealt), source.withColumn("_salt", F.explode(salts))


def _looked_up(wanted: DataFrame, rows: int, source: DataFrame, elements: int, keys: list[str], most: int) -> DataFrame:
    """``wanted`` with the value of ``source`` for equal keys; no key has more than ``most`` rows of ``wanted``."""
    if elements <= BROADCAST_ELEMENTS or rows <= BROADCAST_ELEMENTS or most <= BLOCK:
        return small(wanted, rows).join(small(source, elements), keys) if elements > rows else wanted.join(small(source, elements), keys)
    hot = frequent(wanted, keys, rows)
    if not hot:
        return wanted.join(source, keys)
    wanted, source = salted(wanted, source, keys, hot)
    return wanted.join(source, [*keys, "_salt"])


def gather(t: TensorFrame, indexes: TensorFrame, axis: int | None = None) -> TensorFrame:
    """Elements by index. Without an axis: positions in row-major order, as many as there are elements.

    With an axis: ``indexes`` broadcasts to the tensor's shape, and each replaces the coordinate of that axis. The tensor
    is read once, and joined with the indexes on the axes along which these extend.
    """
    _has(t, "gather")
    _has(indexes, "gather")
    limit = t.num_elements if axis is None else t.shape[shapes.axis_of(axis, t.rank, "gather")]
    index = F.col("v").cast("long")
    told = F.when((index < 0) | (index >= limit), F.raise_error(F.lit(message(BoundsError, "gather", f"an index is outside 0 to {limit - 1}"))).cast("long")).otherwise(index)
    if axis is None:
        require(indexes.rank == 1 and indexes.num_elements == t.num_elements, ValidationError, "gather", "an index for each element is needed")
        source = t.df.select(t.flat().alias("_at"), "v")
        wanted = indexes.df.select(F.col("i0").alias("k"), told.alias("_at"))
        return t.with_df(from_flat(_looked_up(wanted, t.num_elements, source, t.num_elements, ["_at"], t.num_elements), t.shape))
    axis = shapes.axis_of(axis, t.rank, "gather")
    require(indexes.rank <= t.rank, ValidationError, "gather", "the indexes have more axes than the tensor")
    require(shapes.broadcast([indexes.shape, t.shape], "gather") == t.shape, ValidationError, "gather", "the indexes don't fit the tensor")
    lead = t.rank - indexes.rank
    own = [lead + d for d, n in enumerate(indexes.shape) if n > 1]
    places = [F.col(f"i{axis - lead}").alias("_to")] if axis in own else []
    wanted = indexes.df.select(*[F.col(f"i{d - lead}").alias(f"_{d}") for d in own if d != axis], *places, told.alias(f"_{axis}"))
    keys = [f"_{d}" for d in own if d != axis] + [f"_{axis}"]
    source = t.df.select(*[F.col(c).alias(f"_{d}") for d, c in enumerate(t.coords)], "v")
    df = _looked_up(wanted, indexes.num_elements, source, t.num_elements, keys, t.shape[axis] if axis in own else 1)
    if axis not in own:  # one index for the whole axis
        df = df.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(t.shape[axis] - 1).cast("long"))))
    return t.with_df(df.select(*[F.col("_to" if d == axis else f"_{d}").alias(c) for d, c in enumerate(t.coords)], "v"))
