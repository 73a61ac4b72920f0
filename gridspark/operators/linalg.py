"""Matrix products, covariance and symmetric eigen-decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, prod, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.errors import NanError, NonFiniteError, ValidationError, message, raised, require
from gridspark.frame import TensorFrame
from gridspark.functions import unsigned
from gridspark.functions.guards import finite, no_nan
from gridspark.operators import moments, reduce, spectra, structure
from gridspark.plans import shapes, tiles
from gridspark.plans.storage import stored

#: Products of elements from which a matrix product multiplies blocks instead of pairing elements.
BLOCK_PRODUCTS = 32_000_000
#: Elements of one operand in one tile.
BLOCK_ELEMENTS = 1 << 20
#: Rows, and columns, of one tile's product.
TILE = 1_024
#: Bytes of packed tiles up to which a side is broadcast.
BROADCAST_BYTES = 32 << 20
#: Elements of partial products that a task holds at once.
HELD_ELEMENTS = 4 << 20
#: Rows of a matrix up to which one task finds its spectrum, in the order of row-by-row rotations.
EIG_TASK = 128
#: Events up to which covariances are sums of products in one aggregate.
FEW_EVENTS = 16
#: Events up to which a task adds up all covariances of its samples: 32 MB.
GRAM_EVENTS = 2_048


def matmul(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """The product over the last axis of ``a`` and the one before the last of ``b``; leading axes broadcast.

    A vector on either side is a row or a column, whose axis the result lacks; two vectors give a single value.
    """
    require(a.rank > 0 and b.rank > 0, ValidationError, "matmul", "an empty operand")
    require(a.dtype == b.dtype, ValidationError, "matmul", "operands of different element types")
    row, column = a.rank == 1, b.rank == 1
    left = structure.reshape(a, (1, *a.shape)) if row else a
    right = structure.reshape(b, (*b.shape, 1)) if column else b
    require(left.shape[-1] == right.shape[-2], ValidationError, "matmul", f"{a.shape} and {b.shape} don't fit")
    batch = shapes.broadcast([left.shape[:-2] or (1,), right.shape[:-2] or (1,)], "matmul") if max(left.rank, right.rank) > 2 else ()
    m, k, n = left.shape[-2], left.shape[-1], right.shape[-1]
    sides = [_side(left, batch, 0), _side(right, batch, 1)]
    if a.is_float and prod(batch) * m * k * n > BLOCK_PRODUCTS:
        df = _blocks(*sides, left, right, batch, m, k, n)
    else:
        df = _pairs(*sides, a.is_float, batch)
    shape = (*batch, m, n)
    out = TensorFrame(df, shape, a.dtype)
    if row or column:
        kept = [d for d, size in enumerate(shape) if not (row and d == len(shape) - 2 or column and d == len(shape) - 1)]
        cols = [F.col(f"i{d}").alias(f"i{e}") for e, d in enumerate(kept)] or [F.lit(0).cast("long").alias("i0")]
        out = out.with_df(out.df.select(*cols, "v"), tuple(shape[d] for d in kept) or (1,))
    return out


def _side(t: TensorFrame, batch: shapes.Shape, number: int) -> tuple[DataFrame, list[int]]:
    """Rows (batch axes that extend, outer, inner, value) of an operand, and which batch axes those are."""
    lead = t.rank - 2
    own = [len(batch) - lead + d for d in range(lead) if t.shape[d] > 1]
    outer, inner = (f"i{lead}", f"i{lead + 1}") if number == 0 else (f"i{lead + 1}", f"i{lead}")
    value = no_nan(F.col("v"), "matmul") if t.is_float else F.col("v")
    names = [F.col(f"i{d - len(batch) + lead}").alias(f"_{number}_{d}") for d in own]
    return t.df.select(*names, F.col(outer).alias(f"_o{number}"), F.col(inner).alias(f"_k{number}"), value.alias(f"_v{number}")), own


def _pairs(left, right, is_float: bool, batch: shapes.Shape) -> DataFrame:
    """Elements that share the inner coordinate are paired, and products summed where they arise, then after the shuffle."""
    (a, axes_a), (b, axes_b) = left, right
    on = F.col("_k0") == F.col("_k1")
    for d in set(axes_a) & set(axes_b):
        on = on & (F.col(f"_0_{d}") == F.col(f"_1_{d}"))
    coords = [_batch_column(d, axes_a, axes_b) for d in range(len(batch))]
    both = a.join(b, on).select(*coords, F.col("_o0").alias(f"i{len(batch)}"), F.col("_o1").alias(f"i{len(batch) + 1}"), "_v0", "_v1")
    keys = [f"i{d}" for d in range(len(batch) + 2)]
    if is_float:
        return both.groupBy(*keys).agg(finite(F.sum(F.col("_v0") * F.col("_v1")), "matmul").alias("v"))
    return both.groupBy(*keys).agg(unsigned.wrapped(F.sum(unsigned.multiply(F.col("_v0"), F.col("_v1")))).alias("v"))


def _batch_column(d: int, axes_a: list[int], axes_b: list[int]):
    if d in axes_a:
        return F.col(f"_0_{d}").alias(f"i{d}")
    return F.col(f"_1_{d}").alias(f"i{d}") if d in axes_b else F.lit(0).cast("long").alias(f"i{d}")


def _blocks(left, right, a: TensorFrame, b: TensorFrame, batch: shapes.Shape, m: int, k: int, n: int) -> DataFrame:
    """Both sides as packed tiles, joined on the inner axis; NumPy multiplies each pair, and partial products are added as tiles.

    A side of few bytes, which its shape tells, is broadcast. Where all tiles of one side meet all of the other's, both are
    kept as tables and each pair of their partitions is a task, so nothing is copied. Otherwise tiles are dealt to groups of
    rows and of columns, as many as keep the session's cores busy, and a tile goes to the other side's groups, not to all its tiles.
    """
    (x, axes_a), (y, axes_b) = left, right
    high, wide = min(m, TILE), min(n, TILE)
    width = max(1, min(k, BLOCK_ELEMENTS // max(high, wide)))
    every, common = sorted({*axes_a, *axes_b}), sorted({*axes_a} & {*axes_b})
    names = {0: [f"_0_{d}" for d in axes_a], 1: [f"_1_{d}" for d in axes_b]}
    times = [prod(batch[d] for d in axes) for axes in (axes_a, axes_b)]
    bytes_of = [8 * times[0] * m * k, 8 * times[1] * k * n]
    one = tiles.packed(x, names[0], F.col("_o0"), F.col("_k0"), F.col("_v0"), (m, k), (high, width), True, times[0])
    two = tiles.packed(y, names[1], F.col("_k1"), F.col("_o1"), F.col("_v1"), (k, n), (width, wide), True, times[1])
    p = one.df.select(*names[0], "row", F.col("col").alias("part"), F.col("block").alias("a"))
    q = two.df.select(*names[1], F.col("row").alias("_part"), "col", F.col("block").alias("b"))
    on = F.col("part") == F.col("_part")
    for d in common:
        on = on & (F.col(f"_0_{d}") == F.col(f"_1_{d}"))
    if min(bytes_of) <= BROADCAST_BYTES:
        pairs = F.broadcast(p).join(q, on) if bytes_of[0] < bytes_of[1] else p.join(F.broadcast(q), on)
    elif one.counts[1] == 1 and not common:
        with raised():
            pairs = stored(p, "tiles").crossJoin(stored(q, "tiles"))
    else:
        wanted = 2 * p.sparkSession.sparkContext.defaultParallelism
        apart = prod(batch[d] for d in common) * one.counts[1]
        downs = min(one.counts[0], max(1, ceil(sqrt(wanted / apart))))
        acrosses = min(two.counts[1], max(1, ceil(wanted / apart / downs)))
        each = lambda times: F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
        p = p.withColumn("_down", (F.col("row") % downs).cast("int")).withColumn("_across", each(acrosses))
        q = q.withColumn("_across_", (F.col("col") % acrosses).cast("int")).withColumn("_down_", each(downs))
        pairs = p.join(q, on & (F.col("_down") == F.col("_down_")) & (F.col("_across") == F.col("_across_")))
    outer = [f"b{d}" for d in every]
    renamed = [F.col(f"_0_{d}" if d in axes_a else f"_1_{d}").alias(f"b{d}") for d in every]
    pairs = pairs.select(*renamed, "row", "col", "part", "a", "b")

    def products(batches: tiles.Batches) -> Iterator[tuple[tuple, np.ndarray]]:
        for found in batches:
            keys = list(zip(*(found.column(i).to_pylist() for i in range(len(outer) + 3))))
            for key, u, v in zip(keys, found.column(len(outer) + 3), found.column(len(outer) + 4)):
                inner = tiles.edge(key[-1], width, k)
                block = tiles.as_block(u.as_buffer(), tiles.edge(key[-3], high, m), inner)
                yield key[:-1], block @ tiles.as_block(v.as_buffer(), inner, tiles.edge(key[-2], wide, n))

    def elements(key: tuple, block: np.ndarray) -> tiles.Batches:
        return tiles.rows_of(list(zip(outer, key)), block, key[-2] * high, key[-1] * wide, ("r", "c"))

    def whole(batches: tiles.Batches) -> tiles.Batches:
        for key, block in products(batches):
            yield from elements(key, block)

    def partial(batches: tiles.Batches) -> tiles.Batches:
        """Products of one tile of the result are added up in the task, as long as there are few."""
        held: dict[tuple, np.ndarray] = {}

        def sent() -> tiles.Batches:
            for key, block in held.items():
                columns = [pa.array([x], pa.int64()) for x in key] + [pa.array([block.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*outer, "row", "col", "block"])
            held.clear()

        for key, block in products(batches):
            held[key] = held[key] + block if key in held else block
            if len(held) * high * wide > HELD_ELEMENTS:
                yield from sent()
        yield from sent()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = tuple(x.as_py() for x in key), 0.0
        for found in batches:
            for block in found.column(found.schema.get_field_index("block")):
                total = total + tiles.as_block(block.as_buffer(), tiles.edge(key[-2], high, m))
        yield from elements(key, total)

    schema = ", ".join([*[f"{c} long" for c in outer], "r long", "c long", "v double"])
    if k <= width:  # each tile of the product comes from one pair
        cells = pairs.mapInArrow(whole, schema)
    else:
        parts = pairs.mapInArrow(partial, ", ".join([*[f"{c} long" for c in outer], "row long", "col long", "block binary"]))
        cells = parts.groupBy(*outer, "row", "col").applyInArrow(added, schema)
    coords = [F.col(f"b{d}").alias(f"i{d}") if d in every else F.lit(0).cast("long").alias(f"i{d}") for d in range(len(batch))]
    return cells.select(*coords, F.col("r").alias(f"i{len(batch)}"), F.col("c").alias(f"i{len(batch) + 1}"), finite(F.col("v"), "matmul").alias("v"))


def cov(t: TensorFrame, sample_axes: list[int] | None = None, event_axes: list[int] | None = None, ddof: int = 0) -> TensorFrame:
    """Covariances between events, over samples: {batch..., E, E}. Without axes: the last two, samples first.

    Several axes flatten in the order given; all others are batch axes, in their order.
    """
    where = "cov"
    require(t.rank >= 2 and t.is_float, ValidationError, where, "a float tensor of two axes or more is needed")
    sample_axes = [t.rank - 2] if sample_axes is None else sample_axes
    event_axes = [t.rank - 1] if event_axes is None else event_axes
    require(len(sample_axes) > 0 and len(event_axes) > 0, ValidationError, where, "no sample or event axis")
    samples = [shapes.axis_of(a, t.rank, where) for a in sample_axes]
    events = [shapes.axis_of(a, t.rank, where) for a in event_axes]
    require(len({*samples, *events}) == len(samples) + len(events), ValidationError, where, "an axis is named twice")
    batch = [d for d in range(t.rank) if d not in samples and d not in events]
    n, e = prod(t.shape[d] for d in samples), prod(t.shape[d] for d in events)
    require(0 <= ddof < n, ValidationError, where, f"ddof {ddof} with {n} samples")
    flat = structure.reshape(structure.transpose(t, [*batch, *samples, *events]), (*[t.shape[d] for d in batch], n, e))
    if e <= FEW_EVENTS:
        return _few_events(flat, n, e, ddof)
    if e <= GRAM_EVENTS:
        return moments.covariances(flat, ddof)
    centered = reduce.center(flat, -2)
    last = list(range(flat.rank))
    turned = structure.transpose(centered, [*last[:-2], last[-1], last[-2]])
    product = matmul(turned, centered)
    return product.map(lambda v: finite(v / F.lit(float(n - ddof)), where))


def _few_events(t: TensorFrame, n: int, e: int, ddof: int) -> TensorFrame:
    """Each sample's events side by side, then one aggregate of all pairs' co-moments, which merge without losing digits."""
    *batch, sample, event = t.coords
    value = no_nan(F.col("v"), "cov")
    wide = t.df.groupBy(*batch, sample).agg(*[F.max(F.when(F.col(event) == k, value)).alias(f"_{k}") for k in range(e)])
    pairs = [(a, b) for a in range(e) for b in range(a, e)]
    moments = wide.groupBy(*batch).agg(*[F.covar_pop(f"_{a}", f"_{b}").alias(f"_{a}_{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.col(f"_{min(a, b)}_{max(a, b)}").alias("v"))
        for a in range(e) for b in range(e)
    ]
    long = moments.select(*batch, F.explode(F.array(*cells)).alias("x"))
    out = long.select(*batch, F.col("x.a").alias(sample), F.col("x.b").alias(event), finite(F.col("x.v") * F.lit(n / (n - ddof)), "cov").alias("v"))
    return t.with_df(out, (*t.shape[:-2], e, e))


def jacobi(a: np.ndarray, max_iters: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, in the order the rotations leave them, and eigenvectors (columns) of a symmetric matrix.

    The upper triangle counts. A sweep goes over the pairs row by row; pairs with |a_pq| < 1e-10 are left, and
    the largest off-diagonal element is compared with ``tol`` after every tenth sweep.
    """
    n = len(a)
    a = np.triu(a) + np.triu(a, 1).T
    q = np.eye(n)
    for sweep in range(1, max_iters + 1):
        for row in range(n):
            for col in range(row):
                i, j = col, row
                if abs(a[i, j]) < 1e-10:
                    continue
                tau = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.sqrt(1 + tau * tau))
                c = 1 / np.sqrt(1 + t * t)
                s = t * c
                turn = np.array([[c, s], [-s, c]])
                pair = [i, j]
                a[pair, :] = turn.T @ a[pair, :]
                a[:, pair] = a[:, pair] @ turn
                q[:, pair] = q[:, pair] @ turn
                a[i, j] = a[j, i] = 0.0
        if sweep % 10 == 0 and n > 1 and np.abs(a - np.diag(np.diag(a))).max() < tol:
            break
    return np.diag(a).copy(), q


def _spectra(t: TensorFrame, max_iters: int, tol: float, largest: int | None) -> DataFrame:
    """Of every matrix on the last two axes: the eigenvalues in row -1, and the eigenvectors by columns.

    With ``largest``, only so many, by falling eigenvalue (ties in the order of the rotations). A group is one
    matrix, so its size is the tensor's last two dimensions.
    """
    n, lead = t.shape[-1], t.rank - 2
    keys = t.coords[:lead]
    r, c = t.coords[lead:]
    bad = [message(NanError, "eig", "NaN in the input"), message(NonFiniteError, "eig", "an input is not finite")]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[part[r].to_numpy(), part[c].to_numpy()] = part["v"].to_numpy()
        if np.isnan(a).any():
            raise ValueError(bad[0])
        if np.isinf(a).any():
            raise ValueError(bad[1])
        values, vectors = jacobi(a, max_iters, tol)
        if largest is not None:
            best = np.argsort(-values, kind="stable")[:largest]
            values, vectors = values[best], vectors[:, best]
        k = len(values)
        rows, cols = np.divmod(np.arange(n * k), k)
        out = pd.DataFrame({r: np.append(np.full(k, -1), rows), c: np.append(np.arange(k), cols), "v": np.append(values, vectors.ravel())})
        for name in keys:
            out[name] = int(part[name].iloc[0])
        return out[[*keys, r, c, "v"]]

    schema = ", ".join([*[f"{k} long" for k in (*keys, r, c)], "v double"])
    return (t.df.groupBy(*keys) if keys else t.df.withColumn("_one", F.lit(0)).groupBy("_one")).applyInPandas(solve, schema)


def _large_spectra(t: TensorFrame, max_iters: int, largest: int | None) -> DataFrame:
    """As ``_spectra``, by falling value, with every matrix in blocks of columns."""
    *keys, r, c = t.coords
    flat = F.lit(0).cast("long")
    for name, size in zip(keys, t.shape):
        flat = flat * size + F.col(name)
    cells = t.df.select(flat.alias("b"), F.col(r).alias("r"), F.col(c).alias("c"), finite(no_nan(F.col("v"), "eig"), "eig").alias("v"))
    with raised():
        found = spectra.block_jacobi(cells, t.shape[-1], max_iters)
    if largest is not None:
        found = found.where(F.col("c") < largest)
    step, names = prod(t.shape[:-2]), []
    for name, size in zip(keys, t.shape):
        step //= size
        names.append(F.expr(f"(b div {step}) % {size}").cast("long").alias(name))
    return found.select(*names, F.col("r").alias(r), F.col("c").alias(c), "v")


def eig(t: TensorFrame, max_iters: int = 100, tol: float = 1e-4, largest: int | None = None) -> tuple[TensorFrame, TensorFrame]:
    """(values {batch..., 1, N}, vectors {batch..., N, N} by columns) of symmetric matrices on the last two axes.

    ``largest``: only so many, by falling value; otherwise all, in the order that the rotations leave. Matrices of over
    EIG_TASK rows are rotated by blocks in many tasks: theirs always come by falling value, and ``max_iters`` counts sweeps.
    """
    require(t.rank >= 2 and t.is_float, ValidationError, "eig", "a float tensor of two axes or more is needed")
    require(t.shape[-1] == t.shape[-2], ValidationError, "eig", "the matrices are not square")
    both = _spectra(t, max_iters, tol, largest) if t.shape[-1] <= EIG_TASK else _large_spectra(t, max_iters, largest)
    r, k = t.coords[-2], largest or t.shape[-1]
    values = both.where(F.col(r) == -1).withColumn(r, F.lit(0).cast("long"))
    vectors = both.where(F.col(r) >= 0).select(*t.coords, "v")
    return t.with_df(values.select(*t.coords, "v"), (*t.shape[:-2], 1, k)), t.with_df(vectors, (*t.shape[:-1], k))
