"""Where tensors come from: generators, values on the driver, and tables."""

from __future__ import annotations

import builtins
import math
from itertools import accumulate, chain
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.errors import BoundsError, NanError, NonFiniteError, ValidationError, require
from gridspark.frame import FLOAT, UINT64, TensorFrame, flat_grid, from_flat, joined, small
from gridspark.functions import unsigned
from gridspark.functions.guards import finite, no_nan, no_null
from gridspark.plans import shapes
from gridspark.plans.scan import numbered

#: Files up to which their offsets are a constant, and up to which they are broadcast.
FEW_FILES, MANY_FILES = 256, 1_000_000


def zeros(spark: SparkSession, shape, dtype: str = FLOAT, requires_grad: bool = False) -> TensorFrame:
    shape = shapes.checked(shape, "zeros")
    kind = TensorFrame(dtype=dtype).sql_type
    return TensorFrame(flat_grid(spark, shape).withColumn("v", F.lit(0).cast(kind)), shape, dtype, requires_grad)


def scalar(spark: SparkSession, value, dtype: str = FLOAT, requires_grad: bool = False) -> TensorFrame:
    """One value; operators use it as a literal."""
    value = float(value) if dtype == FLOAT else int(value) % unsigned.MODULUS
    column = F.lit(value) if dtype == FLOAT else unsigned.literal(value).cast(unsigned.TYPE)
    df = spark.range(1).select(F.col("id").alias("i0"), column.alias("v"))
    return TensorFrame(df, (1,), dtype, requires_grad, literal=value)


def from_values(spark: SparkSession, values, shape=None, dtype: str = FLOAT, requires_grad: bool = False) -> TensorFrame:
    """Values that the driver holds, in row-major order."""
    array = np.asarray(values, dtype=float if dtype == FLOAT else object)
    shape = shapes.checked(array.shape if shape is None else shape, "from_values")
    flat = array.ravel()
    require(len(flat) == prod(shape), ValidationError, "from_values", f"{len(flat)} values for the shape {shape}")
    if dtype == FLOAT:
        rows, kind = [(k, float(v)) for k, v in enumerate(flat)], "k long, v double"
    else:
        rows, kind = [(k, str(int(v) % unsigned.MODULUS)) for k, v in enumerate(flat)], "k long, v string"
    df = spark.createDataFrame(rows, kind).withColumn("v", F.col("v").cast(TensorFrame(dtype=dtype).sql_type))
    return TensorFrame(from_flat(df, shape), shape, dtype, requires_grad)


def from_array_column(df: DataFrame, key: str, column: str, rows: int, width: int) -> TensorFrame:
    """A matrix {rows, width} of an ARRAY column; ``key`` is its dense row number."""
    long = df.select(F.col(key).cast("long").alias("i0"), F.posexplode(column).alias("_p", "_x"))
    value = no_null(F.col("_x").cast("double"), "from_array_column")
    return TensorFrame(long.select("i0", F.col("_p").cast("long").alias("i1"), value.alias("v")), shapes.checked((rows, width)))


def from_column(df: DataFrame, key: str, column: str | Column, rows: int) -> TensorFrame:
    """A vector; ``key`` is its dense row number."""
    value = F.col(column) if isinstance(column, str) else column
    return TensorFrame(
        df.select(F.col(key).cast("long").alias("i0"), no_null(value.cast("double"), "from_column").alias("v")), shapes.checked((rows,))
    )


def from_columns(df: DataFrame, key: str, columns: list[str], rows: int) -> TensorFrame:
    """A matrix {rows, columns}; ``key`` is its dense row number."""
    packed = df.select(F.col(key).alias("_key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_values"))
    return from_array_column(packed, "_key", "_values", rows, len(columns))


def from_table(df: DataFrame, order: list[str] | None, columns: list[str]) -> TensorFrame:
    """A matrix of a table without a dense key. Rows go by ``order``, which takes a sort; without one, as the files have them.

    For the files' order the table must be read from Parquet, not yet joined or aggregated: a row's number is its place in
    its file, which the reader knows, after the rows of the files before by name. That takes no sort and no shuffle of
    rows, only a count of each file's rows (of which the read needs no column).
    """
    if order is None:
        return from_columns(*_by_file(df, columns))
    kept = df.select(*dict.fromkeys([*order, *columns]))
    rows = df.count()
    return from_columns(numbered(kept, order, "_row", rows), "_row", columns, max(1, rows))


def _by_file(df: DataFrame, columns: list[str]) -> tuple[DataFrame, str, list[str], int]:
    """The columns with ``_row``, and how many rows there are."""
    file = F.col("_metadata.file_path")
    counts = df.select(file.alias("_file")).groupBy("_file").count()
    sizes = sorted((r["_file"], r["count"]) for r in counts.collect())  # a row a file
    offsets = list(zip((f for f, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    rows = builtins.sum(n for _, n in sizes)
    kept = list(dict.fromkeys(columns))
    placed = df.select(*kept, file.alias("_in"), F.col("_metadata.row_index").alias("_at"))
    if 0 < len(offsets) <= FEW_FILES:  # a projection, so that what does not use the numbers does not pay for them
        before = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[F.col("_in")]
        return placed.select(*kept, (before + F.col("_at")).alias("_row")), "_row", columns, max(1, rows)
    found = df.sparkSession.createDataFrame(offsets, "_file string, _before long")
    joined = placed.join(F.broadcast(found) if len(offsets) <= MANY_FILES else found, F.col("_in") == F.col("_file"))
    return joined.select(*kept, (F.col("_before") + F.col("_at")).alias("_row")), "_row", columns, max(1, rows)


def to_table(t: TensorFrame) -> DataFrame:
    """The rows of a matrix with a column for each of its columns, of which there may be 1,024; of other tensors the long form."""
    if t.rank != 2:
        return t.df
    require(t.shape[1] <= 1024, ValidationError, "to_table", f"a table of {t.shape[1]} columns is too wide; use the long form, df")
    cells = [F.max(F.when(F.col("i1") == k, F.col("v"))).alias(f"c{k}") for k in range(t.shape[1])]
    return t.df.groupBy("i0").agg(*cells)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1.0) -> TensorFrame:
    """start, start + step, ... before stop; an empty range is the single element 0."""
    start, stop = (0.0, start) if stop is None else (start, stop)
    for x in (start, stop, step):
        require(math.isfinite(x), NonFiniteError, "arange", "an argument is not finite")
    require(step != 0, ValidationError, "arange", "the step is 0")
    n = math.ceil((stop - start) / step)
    if n <= 0:
        return zeros(spark, (1,))
    value = F.lit(float(start)) + F.col("id") * F.lit(float(step))
    return TensorFrame(spark.range(n).select(F.col("id").alias("i0"), value.alias("v")), (n,))


def linspace(start: TensorFrame, stop: TensorFrame, num: int, axis: int = 0, endpoint: bool = True) -> tuple[TensorFrame, TensorFrame]:
    """(values, step): ``num`` evenly spaced values from start to stop along a new axis, and their distance.

    Operands broadcast; two single values give a vector. ``num`` 0 gives a single 0 twice. With ``num`` 1 the
    value is start and the step 0.
    """
    spark = next(t.df.sparkSession for t in (start, stop) if t.df is not None)
    require(start.rank > 0 and stop.rank > 0, ValidationError, "linspace", "an empty operand")
    for t in (start, stop):
        for x in [t.literal] if t.literal is not None else []:
            require(not math.isnan(x), NanError, "linspace", "NaN in the input")
            require(math.isfinite(x), NonFiniteError, "linspace", "an input is not finite")
    if num == 0:
        return zeros(spark, (1,)), zeros(spark, (1,))
    require(num > 0, ValidationError, "linspace", "a negative number of values")
    df, shape = joined([start, stop], "linspace")
    flat = shape == (1,)
    axis = 0 if flat else shapes.axis_of(axis, len(shape) + 1, "linspace")
    a, b = (finite(no_nan(F.col(c), "linspace"), "linspace") for c in ("v0", "v1"))
    parts = num - 1 if endpoint else num
    step = F.lit(0.0) if num == 1 else (b - a) / F.lit(float(parts))
    coords = [f"i{d}" for d in range(len(shape))]
    base = df.select(*coords, a.alias("_a"), finite(step, "linspace").alias("_s"))
    steps = TensorFrame(base.select(*coords, F.col("_s").alias("v")), shape)
    grid = base.crossJoin(small(spark.range(num).select(F.col("id").alias("_p")), num))
    names = [] if flat else coords
    order = chain(names[:axis], ["_p"], names[axis:])
    out = grid.select(*[F.col(c).alias(f"i{d}") for d, c in enumerate(order)], (F.col("_a") + F.col("_s") * F.col("_p")).alias("v"))
    return TensorFrame(out, (num,) if flat else (*shape[:axis], num, *shape[axis:])), steps


def integral(spark: SparkSession, f, a: float, b: float, n_bins: int = 1000) -> TensorFrame:
    """Composite Simpson rule of ``f``, a function of a column, from a to b; a above b gives the negative."""
    require(n_bins >= 1, ValidationError, "integral", "at least one bin is needed")
    width = (b - a) / n_bins
    x = lambda shift: F.lit(float(a)) + (F.col("id") + shift) * F.lit(width)
    each = F.lit(width / 6) * (f(x(F.lit(0.0))) + 4 * f(x(F.lit(0.5))) + f(x(F.lit(1.0))))
    df = spark.range(n_bins).agg(F.sum(each).alias("v")).select(F.lit(0).cast("long").alias("i0"), "v")
    return TensorFrame(df, (1,))


__all__ = ["BoundsError", "UINT64", "arange", "from_array_column", "from_column", "from_columns", "from_table", "from_values", "integral", "linspace", "scalar", "to_table", "zeros"]
