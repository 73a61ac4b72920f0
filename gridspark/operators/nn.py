"""Two-dimensional convolution and its transpose.

Output planes are dealt to tiles, several small images to a group of tiles. An input element goes to the tiles whose
outputs it takes part in: one, or a few where tiles border on each other, so what is shuffled grows with the input and
not with the kernel. A task multiplies whole patches of its tiles with the kernel. Kernels that differ along leading
axes, or that are large, meet the input element by element instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.errors import ValidationError, raised, require
from gridspark.frame import BROADCAST_ELEMENTS, TensorFrame, flat_grid, small
from gridspark.functions.guards import finite, no_nan
from gridspark.operators.elementwise import relu
from gridspark.plans import shapes, tiles

#: Rows, and columns, of an output tile, and elements (input, or output) of a group of tiles, about.
TILE = 256
GROUP_ELEMENTS = 1 << 20
NOWHERE = -(1 << 60)


def _pair(x) -> tuple[int, int]:
    return (x, x) if isinstance(x, int) else tuple(x)


def _meet(x: TensorFrame, kernel: TensorFrame, channel: int, where: str) -> tuple[DataFrame, shapes.Shape]:
    """Input elements with the kernel cells of their channel: leading coordinates, _o (out channel), _h _w, _r _c, _p."""
    lead_x, lead_k = x.shape[:-3], kernel.shape[:-4]
    lead = shapes.broadcast([lead_x or (1,), lead_k or (1,)], where) if lead_x or lead_k else ()
    own = {0: (x, len(lead_x)), 1: (kernel, len(lead_k))}
    axes = {n: [len(lead) - m + d for d in range(m) if t.shape[d] > 1] for n, (t, m) in own.items()}

    def named(n: int) -> list:
        t, m = own[n]
        return [F.col(f"i{d - len(lead) + m}").alias(f"_{n}_{d}") for d in axes[n]]

    m, k = len(lead_x), len(lead_k)
    a = x.df.select(*named(0), F.col(f"i{m}").alias("_ci"), F.col(f"i{m + 1}").alias("_h"), F.col(f"i{m + 2}").alias("_w"), no_nan(F.col("v"), where).alias("_x"))
    b = kernel.df.select(
        *named(1), F.col(f"i{k + channel}").alias("_cj"), F.col(f"i{k + 1 - channel}").alias("_o"), F.col(f"i{k + 2}").alias("_r"), F.col(f"i{k + 3}").alias("_c"), no_nan(F.col("v"), where).alias("_y")
    )
    on = F.col("_ci") == F.col("_cj")
    for d in set(axes[0]) & set(axes[1]):
        on = on & (F.col(f"_0_{d}") == F.col(f"_1_{d}"))
    coords = [
        F.col(f"_0_{d}").alias(f"i{d}") if d in axes[0] else F.col(f"_1_{d}").alias(f"i{d}") if d in axes[1] else F.lit(0).cast("long").alias(f"i{d}")
        for d in range(len(lead))
    ]
    pairs = a.join(small(b, kernel.num_elements), on)
    return pairs.select(*coords, "_o", "_h", "_w", "_r", "_c", (F.col("_x") * F.col("_y")).alias("_p")), lead


def _summed(x: TensorFrame, df: DataFrame, lead: shapes.Shape, row, column, out: tuple[int, int, int], covered: bool, where: str) -> TensorFrame:
    n = len(lead)
    placed = df.withColumn(f"i{n + 1}", row).withColumn(f"i{n + 2}", column).withColumnRenamed("_o", f"i{n}")
    inside = F.col(f"i{n + 1}").between(0, out[1] - 1) & F.col(f"i{n + 2}").between(0, out[2] - 1)
    coords = [f"i{d}" for d in range(n + 3)]
    placed = placed.where(inside).select(*[F.col(c).cast("long").alias(c) for c in coords], F.col("_p").alias("v"))
    shape = shapes.checked((*lead, *out), where)
    if not covered:  # cells that no input reaches are 0
        placed = placed.unionByName(flat_grid(x.df.sparkSession, shape).withColumn("v", F.lit(0.0)))
    return TensorFrame(placed.groupBy(*coords).agg(finite(F.sum("v"), where).alias("v")), shape)


class _Way:
    """One axis: which outputs, of ``size``, the input at x takes part in, and which inputs an output tile needs.

    ``turned``: of the transposed convolution, where x reaches the outputs x s - p to x s - p + k - 1.
    """

    def __init__(self, size: int, length: int, k: int, s: int, p: int, turned: bool) -> None:
        self.size, self.length, self.k, self.s, self.p, self.turned = size, length, k, s, p, turned
        self.tiles = -(-size // TILE)
        self.tile = -(-size // self.tiles)

    def reached(self, x: Column) -> tuple[Column, Column]:
        """The first and last output, before they are clipped."""
        if self.turned:
            return x * self.s - self.p, x * self.s - self.p + self.k - 1
        return F.ceil((x + self.p - self.k + 1) / self.s), F.floor((x + self.p) / self.s)

    def numbers(self, x: Column) -> Column:
        """The tiles of x's outputs, none if it has none."""
        first, last = self.reached(x)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(self.size - 1))
        of = lambda at: F.floor(at / F.lit(self.tile)).cast("int")
        return F.when(first <= last, F.sequence(of(first), of(last))).otherwise(F.array().cast("array<int>"))

    def inputs(self, tile: int) -> tuple[int, int, int, int]:
        """(first output, outputs, first input, inputs) of a tile; inputs may lie outside."""
        first = tile * self.tile
        count = min(self.tile, self.size - first)
        if self.turned:
            low = -(-(first + self.p - self.k + 1) // self.s)
            return first, count, low, (first + count - 1 + self.p) // self.s - low + 1
        return first, count, first * self.s - self.p, (count - 1) * self.s + self.k


def _by_tiles(x: TensorFrame, kernel: TensorFrame, rows: _Way, columns: _Way, lead: shapes.Shape, where: str) -> TensorFrame:
    """The convolution with one kernel, {Co, Ci, kh, kw} or {Ci, Co, kh, kw} if turned, which every task has."""
    with raised():
        weights = kernel.map(lambda v: no_nan(v, where)).to_numpy().reshape(kernel.shape[-4:])
    weights = weights.swapaxes(0, 1) if rows.turned else weights
    co, ci, kh, kw = weights.shape
    m, images = x.rank - 3, prod(x.shape[:-3])
    of_image = max(ci * min(rows.length, rows.tile * rows.s + kh) * min(columns.length, columns.tile * columns.s + kw), co * rows.tile * columns.tile)
    together = max(1, min(GROUP_ELEMENTS // of_image, -(-images * rows.tiles * columns.tiles // x.df.sparkSession.sparkContext.defaultParallelism)))
    flat = F.lit(0).cast("long")
    for d in range(m):
        flat = flat * x.shape[d] + F.col(f"i{d}")
    cells = x.df.select(flat.alias("_n"), F.col(f"i{m}").alias("_ci"), F.col(f"i{m + 1}").alias("_h"), F.col(f"i{m + 2}").alias("_w"), no_nan(F.col("v"), where).alias("_x"))
    cells = cells.withColumn("_group", F.floor(F.col("_n") / F.lit(together)))
    for name, way, at in (("_a", rows, "_h"), ("_b", columns, "_w")):
        cells = cells.withColumn(name, F.explode(way.numbers(F.col(at))) if way.tiles > 1 else F.lit(0))
    if rows.tiles * columns.tiles > 1:  # a tile that no input reaches is a group all the same: an element that lies nowhere
        every = flat_grid(x.df.sparkSession, (-(-images // together), rows.tiles, columns.tiles)).toDF("_group", "_a", "_b")
        none = every.select((F.col("_group") * together).alias("_n"), *[F.lit(v).cast("long").alias(c) for c, v in (("_ci", 0), ("_h", NOWHERE), ("_w", NOWHERE))], F.lit(0.0).alias("_x"), "_group", F.col("_a").cast("int"), F.col("_b").cast("int"))
        cells = cells.unionByName(none)

    def convolve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, a, b = (k.as_py() for k in key)
        first = group * together
        count = min(together, images - first)
        y, high, top, tall = rows.inputs(a)
        z, wide, left, broad = columns.inputs(b)
        patch = np.zeros((count, ci, tall, broad))  # what lies outside the planes stays 0
        for found in batches:
            n, c, h, w, v = (found.column(found.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in ("_n", "_ci", "_h", "_w", "_x"))
            near = (h >= top) & (h < top + tall) & (w >= left) & (w < left + broad)
            patch[n[near] - first, c[near], h[near] - top, w[near] - left] = v[near]
        out = np.zeros((count, co, high, wide))
        for r in range(kh):
            for c in range(kw):
                if rows.turned:  # input i adds to output i s + r - p
                    (i, j), (s, t) = (_first(top, rows.s, r - rows.p, y), _first(left, columns.s, c - columns.p, z)), (rows.s, columns.s)
                    u, v = (top + i) * s + r - rows.p - y, (left + j) * t + c - columns.p - z
                    tall_, broad_ = min(tall - i, -(-(high - u) // s)), min(broad - j, -(-(wide - v) // t))
                    if tall_ > 0 and broad_ > 0:
                        part = np.matmul(weights[:, :, r, c], patch[:, :, i : i + tall_, j : j + broad_].reshape(count, ci, -1))
                        out[:, :, u : u + (tall_ - 1) * s + 1 : s, v : v + (broad_ - 1) * t + 1 : t] += part.reshape(count, co, tall_, broad_)
                else:  # the kernel is flipped
                    i, j = kh - 1 - r, kw - 1 - c
                    seen = patch[:, :, i : i + (high - 1) * rows.s + 1 : rows.s, j : j + (wide - 1) * columns.s + 1 : columns.s]
                    out += np.matmul(weights[:, :, r, c], seen.reshape(count, ci, -1)).reshape(out.shape)
        at = np.arange(high * wide)
        step = max(1, tiles.OUT_ROWS // len(at))
        planes = out.reshape(count * co, -1)
        for low in range(0, len(planes), step):
            part = planes[low : low + step]
            image, channel = np.divmod(np.repeat(np.arange(low, low + len(part)), len(at)), co)
            place = np.tile(at, len(part))
            columns_ = [image + first, channel, place // wide + y, place % wide + z, part.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns_], names=["n", "o", "y", "z", "v"])

    made = cells.groupBy("_group", "_a", "_b").applyInArrow(convolve, "n long, o long, y long, z long, v double")
    coords, step = [], images
    for d in range(m):
        step //= x.shape[d]
        coords.append(F.expr(f"(n div {step}) % {x.shape[d]}").cast("long"))
    coords = [F.lit(0).cast("long")] * (len(lead) - m) + coords + [F.col("o"), F.col("y"), F.col("z")]
    named = [c.alias(f"i{d}") for d, c in enumerate(coords)]
    return TensorFrame(made.select(*named, finite(F.col("v"), where).alias("v")), shapes.checked((*lead, co, rows.size, columns.size), where))


def _first(low: int, step: int, shift: int, least: int) -> int:
    """How many inputs from ``low`` on lie before the first whose output, input * step + shift, is ``least`` or more."""
    return max(0, -(-(least - shift) // step) - low)


def _one_kernel(x: TensorFrame, kernel: TensorFrame) -> tuple[bool, shapes.Shape]:
    """Whether all inputs have the same kernel, of bounded size; and the leading axes of the result."""
    a, b = x.shape[:-3], kernel.shape[:-4]
    lead = shapes.broadcast([a or (1,), b or (1,)], "conv2d") if a or b else ()
    return prod(b) == 1 and kernel.num_elements <= BROADCAST_ELEMENTS, lead


def conv2d(x: TensorFrame, kernel: TensorFrame, stride=1, padding=(0, 0)) -> TensorFrame:
    """Convolution (the kernel is flipped) of {..., Ci, H, W} with {..., Co, Ci, kh, kw}; leading axes broadcast."""
    where, (s, t), (p, q) = "conv2d", _pair(stride), _pair(padding)
    require(x.rank >= 3 and kernel.rank >= 4, ValidationError, where, "three axes of input and four of the kernel are needed")
    require(s >= 1 and t >= 1 and p >= 0 and q >= 0, ValidationError, where, "the stride must be positive, the padding not negative")
    co, ci, kh, kw = kernel.shape[-4:]
    _, h, w = x.shape[-3:]
    require(x.shape[-3] == ci, ValidationError, where, "the channels differ")
    require(kh <= h + 2 * p and kw <= w + 2 * q, ValidationError, where, "the kernel is larger than the padded input")
    one, lead = _one_kernel(x, kernel)
    if one:
        return _by_tiles(x, kernel, _Way((h + 2 * p - kh) // s + 1, h, kh, s, p, False), _Way((w + 2 * q - kw) // t + 1, w, kw, t, q, False), lead, where)
    pairs, lead = _meet(x, kernel, 1, where)
    a, b = F.col("_h") + p - (kh - 1 - F.col("_r")), F.col("_w") + q - (kw - 1 - F.col("_c"))
    pairs = pairs.withColumn("_a", a).withColumn("_b", b).where((F.col("_a") % s == 0) & (F.col("_b") % t == 0))
    out = (co, (h + 2 * p - kh) // s + 1, (w + 2 * q - kw) // t + 1)
    return _summed(x, pairs, lead, F.col("_a") / s, F.col("_b") / t, out, p < kh and q < kw, where)


def conv2d_transpose(x: TensorFrame, kernel: TensorFrame, stride=1, padding=(0, 0), output_padding=(0, 0)) -> TensorFrame:
    """Transposed convolution of {..., Ci, H, W} with {..., Ci, Co, kh, kw}: products are added where the kernel falls.

    A padding of the kernel's size or more counts as one less than that size.
    """
    where, (s, t), (p, q), (u, v) = "conv2d_transpose", _pair(stride), _pair(padding), _pair(output_padding)
    require(x.rank >= 3 and kernel.rank >= 4, ValidationError, where, "three axes of input and four of the kernel are needed")
    require(s >= 1 and t >= 1 and min(p, q, u, v) >= 0, ValidationError, where, "the stride must be positive, paddings not negative")
    ci, co, kh, kw = kernel.shape[-4:]
    _, h, w = x.shape[-3:]
    require(x.shape[-3] == ci, ValidationError, where, "the channels differ")
    p, q = min(p, kh - 1), min(q, kw - 1)
    out = (co, (h - 1) * s + kh - 2 * p + u, (w - 1) * t + kw - 2 * q + v)
    require(out[1] >= 1 and out[2] >= 1, ValidationError, where, "the kernel is larger than the padded input")
    one, lead = _one_kernel(x, kernel)
    if one:
        return _by_tiles(x, kernel, _Way(out[1], h, kh, s, p, True), _Way(out[2], w, kw, t, q, True), lead, where)
    pairs, lead = _meet(x, kernel, 0, where)
    row, column = F.col("_h") * s + F.col("_r") - p, F.col("_w") * t + F.col("_c") - q
    return _summed(x, pairs, lead, row, column, out, s <= kh and t <= kw and u == 0 and v == 0, where)


__all__ = ["conv2d", "conv2d_transpose", "relu"]
