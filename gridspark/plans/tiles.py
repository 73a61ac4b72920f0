"""Matrices as dense packed tiles: a row for each tile, whose float64 elements are one binary value.

Elements are shuffled once, to be packed, and go as parts of tiles that a task has gathered; from then on tiles are what
joins and moves. A tile is bounded by its edges, and Spark hands tiles to Python in batches of bounded bytes, so a task
holds a few tiles however large the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are handed back to Spark at once.
OUT_ROWS = 1 << 17
#: Elements that a task gathers before it hands on their parts of tiles.
GATHERED = 1 << 19
#: Bytes of tiles (as float64) in one partition.
PART_BYTES = 16 << 20

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Tiles:
    """``df``: the ``keys`` (longs), row and col (numbers of the tile), block (row-major float64, or float32 as ``packed`` says).

    Tiles at the lower and right edge are smaller than ``size``.
    """

    df: DataFrame
    keys: list[str]
    shape: tuple[int, int]
    size: tuple[int, int]

    @property
    def counts(self) -> tuple[int, int]:
        return -(-self.shape[0] // self.size[0]), -(-self.shape[1] // self.size[1])


def edge(number: int, size: int, length: int) -> int:
    """How many places the tile ``number`` of an axis has."""
    return min(size, length - number * size)


def as_block(scalar, rows: int, cols: int | None = None) -> np.ndarray:
    """The block of a tile; where tiles may be narrow, ``cols`` is needed too."""
    narrow = cols is not None and len(memoryview(scalar)) == 4 * rows * cols
    return np.frombuffer(scalar, np.float32 if narrow else np.float64).astype(np.float64, copy=False).reshape(rows, -1)


def narrowed(values: np.ndarray) -> np.ndarray:
    """The values as float32 if that changes none of them."""
    with np.errstate(over="ignore"):
        small = values.astype(np.float32)
    return small if np.array_equal(small, values) else values


def packed(
    df: DataFrame, keys: list[str], row: Column, col: Column, value: Column, shape: tuple[int, int], size: tuple[int, int], narrow: bool = False, times: int = 0
) -> Tiles:
    """The tiles of a dense matrix for each value of ``keys``; ``row`` and ``col`` are the elements' places in it.

    With ``narrow``, blocks whose values are all float32's are float32. ``times``: how many values of ``keys`` there are, from
    which the number of the tiles' partitions follows; 0 leaves that to Spark, which goes by the bytes that are shuffled.
    """
    (height, width), (high, wide) = shape, size
    cells = df.select(*[F.col(k).cast("long") for k in keys], row.cast("long").alias("_r"), col.cast("long").alias("_c"), value.cast("double").alias("_v"))
    across = -(-width // wide)

    def fragments(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """A row for each tile that has elements here: their places in it, as steps from one to the next, and their values."""
        table = pa.Table.from_batches(held)
        *outer, r, c, v = (table.column(k).to_numpy() for k in range(table.num_columns))
        place = (r // high * across + c // wide) * (high * wide) + r % high * wide + c % wide
        order = np.lexsort((place, *outer)) if outer else np.argsort(place, kind="stable")
        outer, place, v = [k[order] for k in outer], place[order], v[order]
        tile, at = np.divmod(place, high * wide)
        new = np.append(True, np.any([k[1:] != k[:-1] for k in (*outer, tile)], 0))
        first = np.flatnonzero(new)
        step = np.where(new, at, np.diff(at, prepend=0)).astype(np.int32)
        spans = list(pairwise([*first.tolist(), len(at)]))
        columns = [pa.array(k[first]) for k in (*outer, tile // across, tile % across)]
        columns += [pa.array([x(a, b) for a, b in spans], pa.binary()) for x in (lambda a, b: step[a:b].tobytes(), lambda a, b: narrowed(v[a:b]).tobytes())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "row", "col", "_step", "_v"])

    def gathered(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= GATHERED:
                yield fragments(held)
                held = []
        if any(b.num_rows for b in held):
            yield fragments(held)

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *outer, i, j = (k.as_py() for k in key)
        block = np.zeros((edge(i, high, height), edge(j, wide, width)))
        for b in batches:
            for step, v in zip(*(b.column(b.schema.get_field_index(n)) for n in ("_step", "_v"))):
                at = np.cumsum(np.frombuffer(step.as_buffer(), np.int32), dtype=np.int64)
                block[at // wide, at % wide] = as_block(v.as_buffer(), 1, len(at))[0]
        columns = [pa.array([x], pa.int64()) for x in (*outer, i, j)] + [pa.array([(narrowed(block) if narrow else block).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "row", "col", "block"])

    schema = ", ".join([*[f"{k} long" for k in keys], "row long", "col long"])
    some = cells.mapInArrow(gathered, f"{schema}, _step binary, _v binary")
    if times:
        wanted = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-8 * times * height * width // PART_BYTES))
        some = some.repartition(min(wanted, 4 * times * across * -(-height // high)), *keys, "row", "col")
    return Tiles(some.groupBy(*keys, "row", "col").applyInArrow(fill, f"{schema}, block binary"), keys, shape, size)


def rows_of(coords: list[tuple[str, int]], block: np.ndarray, row: int, col: int, names: tuple[str, str], dtype=np.float64) -> Batches:
    """A block's elements as rows: the constant ``coords``, then its coordinates from (row, col) and v."""
    width = max(1, block.shape[1])
    step = max(1, OUT_ROWS // width)
    for low in range(0, block.shape[0], step):
        part = block[low : low + step]
        n = part.size
        columns = [pa.array(np.full(n, x, np.int64)) for _, x in coords]
        columns.append(pa.array(np.repeat(np.arange(row + low, row + low + len(part), dtype=np.int64), width)))
        columns.append(pa.array(np.tile(np.arange(col, col + width, dtype=np.int64), len(part))))
        columns.append(pa.array(np.ascontiguousarray(part, dtype).ravel()))
        yield pa.RecordBatch.from_arrays(columns, names=[*[k for k, _ in coords], *names, "v"])
