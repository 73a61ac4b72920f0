"""TensorFrame: a dense n-dimensional array as a DataFrame with a row for each element.

The columns are the coordinates i0, i1, ... (BIGINT) and the value v: DOUBLE, or DECIMAL(20, 0) for unsigned
64-bit integers. Shape and element type are known to the driver; the data stays a logical plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.errors import BoundsError, ValidationError, raised, require
from gridspark.functions import unsigned
from gridspark.plans import shapes
from gridspark.plans.shapes import Shape

FLOAT, UINT64 = "float", "uint64"
#: Elements up to which an operand without a common axis, or the smaller side of a join, is broadcast.
BROADCAST_ELEMENTS = 250_000


@dataclass(frozen=True)
class TensorFrame:
    df: DataFrame | None = None
    shape: Shape = ()
    dtype: str = FLOAT
    requires_grad: bool = False
    source_function: object = None
    gradient: object = None
    memory_location: str = "DEVICE"
    is_view: bool = False
    #: The value, if the driver knows it: then it is a literal in the plans that use it.
    literal: object = field(default=None, compare=False)

    # -- metadata -----------------------------------------------------------------------------------------------

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def num_elements(self) -> int:
        return prod(self.shape) if self.shape else 0

    @property
    def strides(self) -> Shape:
        return shapes.strides(self.shape)

    @property
    def owns_data(self) -> bool:
        return not self.is_view

    @property
    def element_size_bytes(self) -> int:
        return 8 if self.dtype == UINT64 else 4

    @property
    def total_bytes(self) -> int:
        return self.num_elements * self.element_size_bytes

    @property
    def sql_type(self) -> str:
        return unsigned.TYPE if self.dtype == UINT64 else "double"

    @property
    def is_float(self) -> bool:
        return self.dtype == FLOAT

    def index_to_coords(self, flat: int) -> Shape:
        return shapes.unravel(flat, self.shape) if self.shape else ()

    def coords_to_index(self, coords) -> int:
        return shapes.ravel(coords, self.shape)

    def set_requires_grad(self, on: bool) -> TensorFrame:
        return replace(self, requires_grad=on)

    # -- columns ------------------------------------------------------------------------------------------------

    @property
    def coords(self) -> list[str]:
        return [f"i{d}" for d in range(self.rank)]

    def flat(self) -> Column:
        """The row-major position."""
        out = F.lit(0).cast("long")
        for name, step in zip(self.coords, self.strides):
            out = out + F.col(name) * F.lit(step)
        return out

    def with_df(self, df: DataFrame, shape: Shape | None = None, dtype: str | None = None, view: bool = False) -> TensorFrame:
        """A result of this tensor: the graph is not carried on."""
        dtype = dtype or self.dtype
        return TensorFrame(df, self.shape if shape is None else shape, dtype, is_view=view, memory_location=self.memory_location)

    def map(self, value: Callable[[Column], Column], dtype: str | None = None) -> TensorFrame:
        """A projection of the values; the coordinates stay."""
        kind = TensorFrame(dtype=dtype or self.dtype).sql_type
        return self.with_df(self.df.select(*self.coords, value(F.col("v")).cast(kind).alias("v")), dtype=dtype)

    # -- reading ------------------------------------------------------------------------------------------------

    def rows(self) -> list:
        with raised():
            return self.df.orderBy(self.flat()).collect() if self.shape else []

    def to_numpy(self) -> np.ndarray:
        """The elements on the driver, for tensors that fit there."""
        if not self.shape:
            return np.empty(0)
        with raised():
            table = self.df.select(self.flat().alias("k"), "v").toPandas()
        kind = np.float64 if self.is_float else object
        out = np.empty(self.num_elements, kind)
        values = table["v"].to_numpy() if self.is_float else [int(x) for x in table["v"]]
        out[table["k"].to_numpy(np.int64)] = values
        return out.reshape(self.shape)

    def item(self):
        """The only element."""
        require(self.num_elements == 1, ValidationError, "item", "the tensor must have one element")
        with raised():
            value = self.df.first()["v"]
        return value if self.is_float else int(value)

    def __iter__(self) -> Iterator:
        """Values in row-major order, fetched partition by partition."""
        if self.shape:
            with raised():
                for row in self.df.orderBy(self.flat()).toLocalIterator():
                    yield row["v"] if self.is_float else int(row["v"])

    def begin(self) -> Position:
        """The position of the first element; with ``end`` the bounds of the flat row-major order."""
        return Position(self, 0)

    def end(self) -> Position:
        return Position(self, self.num_elements)

    def at(self, flat: int) -> TensorFrame:
        """A one-element view of the element at a row-major position."""
        coords = self.index_to_coords(flat)
        require(bool(self.shape), ValidationError, "at", "an empty tensor")
        return self.view(coords, (1,) * self.rank).squeezed()

    def squeezed(self) -> TensorFrame:
        return self.with_df(self.df.select(F.lit(0).cast("long").alias("i0"), "v"), (1,), view=True)

    def to_string(self) -> str:
        """Nested brackets, a line for each innermost row."""
        if not self.shape:
            return "[]\n"
        values = self.to_numpy()

        def text(part, indent: int) -> str:
            if part.ndim == 1:
                return "[" + ", ".join(f"{x:g}" if self.is_float else str(x) for x in part) + "]"
            return "[" + (",\n" + " " * (indent + 1)).join(text(p, indent + 1) for p in part) + "]"

        return text(values, 0) + "\n"

    def shape_string(self) -> str:
        return "[" + ", ".join(map(str, self.shape)) + "]\n"

    # -- views --------------------------------------------------------------------------------------------------

    def view(self, start, shape) -> TensorFrame:
        """A block from ``start``. A lower-rank shape belongs to the last axes; the leading ones stay at start."""
        start, where = tuple(start), "view"
        require(self.rank > 0 and len(start) == self.rank, ValidationError, where, "start needs a coordinate for each axis")
        require(1 <= len(shape) <= self.rank, ValidationError, where, "the view's rank must be 1 to the owner's")
        shape = shapes.checked(shape, where)
        full = shapes.aligned(shape, self.rank)
        require(all(0 <= s and s + n <= m for s, n, m in zip(start, full, self.shape)), BoundsError, where, f"{start} + {full} of {self.shape}")
        df, lead = self.df, self.rank - len(shape)
        for name, s, n in zip(self.coords, start, full):
            df = df.where((F.col(name) == s) if n == 1 else F.col(name).between(s, s + n - 1))
        kept = [(F.col(f"i{lead + d}") - start[lead + d]).alias(f"i{d}") for d in range(len(shape))]
        return replace(self.with_df(df.select(*kept, "v"), shape, view=True), requires_grad=self.requires_grad)

    def alias_view(self, start, shape, strides) -> TensorFrame:
        """Arbitrary strides over the owner's row-major elements, overlaps and stride 0 included."""
        where = "alias_view"
        require(self.rank > 0 and len(start) == self.rank, ValidationError, where, "start needs a coordinate for each axis")
        require(len(shape) == len(strides) > 0, ValidationError, where, "a stride is needed for each dimension")
        require(all(int(n) > 0 for n in shape), ValidationError, where, "a dimension is not positive")
        require(all(0 <= s < n for s, n in zip(start, self.shape)), BoundsError, where, "start lies outside")
        shape = shapes.checked(shape, where)
        first = shapes.ravel(start, self.shape)
        reach = first + sum((n - 1) * s for n, s in zip(shape, strides))
        require(all(s >= 0 for s in strides) and reach < self.num_elements, BoundsError, where, "the view reaches outside")
        return replace(self.with_df(self._inverted(first, shape, strides), shape, view=True), requires_grad=self.requires_grad)

    def _inverted(self, first: int, shape: Shape, strides) -> DataFrame:
        """The cells of a strided view that each element is: its offset taken apart by falling strides.

        Where a stride is larger than all that smaller ones reach together, the coordinate follows by division, so
        nested strides are a filter and a projection. Others, and stride 0, have several cells of an element: their
        coordinates in question, from what smaller strides can still reach, are exploded.
        """
        axes = sorted((d for d, n in enumerate(shape) if n > 1), key=lambda d: -strides[d])
        rest = sum((shape[d] - 1) * int(strides[d]) for d in axes)
        df = self.df.select((self.flat() - F.lit(first)).alias("_o"), "v").where(F.col("_o").between(0, rest))
        found: list[str] = []
        for d in axes:
            n, step = shape[d], int(strides[d])
            rest -= (n - 1) * step
            if step > rest:
                place = F.floor(F.col("_o") / F.lit(step))
                df = df.select(*found, place.alias(f"_{d}"), (F.col("_o") - place * step).alias("_o"), "v").where(F.col(f"_{d}") < n)
            else:
                low, high = F.lit(0).cast("long"), F.lit(n - 1).cast("long")
                if step:
                    low, high = F.greatest(low, F.ceil((F.col("_o") - rest) / F.lit(step))), F.least(high, F.floor(F.col("_o") / F.lit(step)))
                places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
                df = df.select(*found, F.explode(places).alias(f"_{d}"), "_o", "v").withColumn("_o", F.col("_o") - F.col(f"_{d}") * step)
            found.append(f"_{d}")
        coords = [(F.col(f"_{d}") if d in axes else F.lit(0)).cast("long").alias(f"i{d}") for d in range(len(shape))]
        return df.where("_o = 0").select(*coords, "v")

    def __getitem__(self, index: int) -> TensorFrame:
        require(self.rank > 0, ValidationError, "index", "an empty tensor")
        require(0 <= index < self.shape[0], BoundsError, "index", f"{index} of {self.shape[0]}")
        if self.rank == 1:
            return self.view((index,), (1,))
        return self.view((index, *(0,) * (self.rank - 1)), self.shape[1:])

    def clone(self) -> TensorFrame:
        return replace(self, is_view=False)

    def to(self, location: str) -> TensorFrame:
        """HOST keeps the elements cached close by; DEVICE gives the cache back and leaves them as the plan has them."""
        require(bool(self.shape) and not self.is_view, ValidationError, "to", "a view or an empty tensor can't move")
        require(location in ("HOST", "DEVICE"), ValidationError, "to", f"no location {location}")
        if location == self.memory_location:
            return self
        return replace(self, df=self.df.cache() if location == "HOST" else self.df.unpersist(), memory_location=location)


EMPTY = TensorFrame()


@dataclass(frozen=True, eq=False)
class Position:
    """A place in the flat order of one tensor, which may lie outside; only ``value`` looks at the tensor.

    Positions of different tensors are neither equal nor one before the other. ``+=`` and ``-=`` give new positions.
    """

    owner: TensorFrame
    flat: int

    @property
    def value(self) -> TensorFrame:
        """A one-element view."""
        return self.owner.at(self.flat)

    def __add__(self, n: int) -> Position:
        return replace(self, flat=self.flat + n)

    def __sub__(self, other):
        """The position ``other`` places before, or the distance from the position ``other``."""
        return self.flat - other.flat if isinstance(other, Position) else replace(self, flat=self.flat - other)

    def __eq__(self, other) -> bool:
        return isinstance(other, Position) and self.owner is other.owner and self.flat == other.flat

    def __hash__(self) -> int:
        return hash((id(self.owner), self.flat))

    def __lt__(self, other: Position) -> bool:
        return self.owner is other.owner and self.flat < other.flat

    def __le__(self, other: Position) -> bool:
        return self.owner is other.owner and self.flat <= other.flat


def small(df: DataFrame, elements: int) -> DataFrame:
    """``df`` to be broadcast if its known number of rows is small."""
    return F.broadcast(df) if elements <= BROADCAST_ELEMENTS else df


def flat_grid(spark: SparkSession, shape: Shape) -> DataFrame:
    """Every coordinate of a shape."""
    exact = [
        (F.expr(f"(id div {s}) % {n}")).cast("long").alias(f"i{d}") for d, (s, n) in enumerate(zip(shapes.strides(shape), shape))
    ]
    return spark.range(prod(shape)).select(*exact)


def from_flat(df: DataFrame, shape: Shape) -> DataFrame:
    """(k, v) to coordinates of ``shape``: a projection."""
    parts = [F.expr(f"(k div {s}) % {n}").cast("long").alias(f"i{d}") for d, (s, n) in enumerate(zip(shapes.strides(shape), shape))]
    return df.select(*parts, "v")


def joined(tensors: list[TensorFrame], where: str) -> tuple[DataFrame, Shape]:
    """The operands' elements side by side, broadcast to their common shape: columns i0, ..., v0, v1, ...

    Operands meet on the axes along which both extend; a literal takes part without a join, and an operand
    without a common axis is a product with what it must be repeated over anyway.
    """
    require(all(t.rank for t in tensors), ValidationError, where, "an empty operand")
    shape = shapes.broadcast([t.shape for t in tensors], where)
    rank = len(shape)
    have: DataFrame | None = None
    axes: list[int] = []
    elements = 1
    literals = {}
    for k, t in enumerate(tensors):
        if t.literal is not None and t.num_elements == 1 and len(tensors) > 1:
            literals[k] = F.lit(str(t.literal)).cast(t.sql_type) if not t.is_float else F.lit(float(t.literal))
            continue
        lead = rank - t.rank
        own = [lead + d for d, n in enumerate(t.shape) if n > 1]
        side = t.df.select(*[F.col(f"i{a - lead}").alias(f"_{k}_{a}") for a in own], F.col("v").alias(f"v{k}"))
        if have is None:
            have = side.select(*[F.col(f"_{k}_{a}").alias(f"i{a}") for a in own], f"v{k}")
            axes, elements = own, t.num_elements
            continue
        common = [a for a in own if a in axes]
        if elements < t.num_elements and elements <= BROADCAST_ELEMENTS:
            have = F.broadcast(have)
        else:
            side = small(side, t.num_elements)
        if common:
            on = F.lit(True)
            for a in common:
                on = on & (F.col(f"i{a}") == F.col(f"_{k}_{a}"))
            have = have.join(side, on)
        else:
            have = have.crossJoin(side)
        fresh = [a for a in own if a not in axes]
        have = have.select(
            *[f"i{a}" for a in axes], *[F.col(f"_{k}_{a}").alias(f"i{a}") for a in fresh], *[c for c in have.columns if c[0] == "v"]
        )
        axes = axes + fresh
        elements = prod(shape[a] for a in axes)
    if have is None:
        have = tensors[0].df.select(F.lit(0).alias("i0"))
        have, axes = have.select(), []
    values = [literals[k].alias(f"v{k}") if k in literals else F.col(f"v{k}") for k in range(len(tensors))]
    coords = [F.col(f"i{a}") if a in axes else F.lit(0).cast("long").alias(f"i{a}") for a in range(rank)]
    return have.select(*coords, *values), shape
