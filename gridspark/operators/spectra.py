"""Spectra of matrices that are too large for one task's rotations, and few components of many columns.

``block_jacobi`` rotates pairs of column blocks. In a step every block is in one pair, by the order of a round-robin
tournament, so all pairs are rotated in parallel tasks; after p - 1 steps, a sweep, each of p blocks has met each other.
The matrix is shifted to be positive, so that orthogonal columns are eigenvectors (one-sided rotations, which leave rows
alone), and only column blocks move.

``components`` finds the leading components of {rows, columns} without a matrix of columns x columns: panels of a few
vectors go through the rows (a randomised block Krylov basis), and the rows, projected on the basis, meet in a tree of
small QR decompositions, whose last triangle has the same singular values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.errors import ComputationError, raised, require
from gridspark.frame import TensorFrame
from gridspark.functions.guards import finite, no_nan
from gridspark.plans import tiles
from gridspark.plans.storage import stored

#: Columns of a block: as many as make a block of so many elements, within these bounds.
BLOCK_ELEMENTS = 4 << 20
LEAST_COLUMNS, MOST_COLUMNS = 8, 128
#: Largest cosine between two columns at which they count as orthogonal.
ORTHOGONAL = 1e-10
#: Steps after which the blocks are kept, so that plans stay short.
STEPS = 8
STATE = "b long, slot long, w binary, v binary, off double"


# -- rotations --------------------------------------------------------------------------------------------------


def pair_of(slot: Column, step: int, slots: int) -> Column:
    """The lower slot of the pair that a slot is in; ``slots`` is even. All pairs meet once in ``slots`` - 1 steps."""
    last = slots - 1
    alone = step * ((last + 1) // 2) % last  # who would meet itself meets the last slot
    partner = F.when(slot == last, F.lit(alone)).when(slot == alone, F.lit(last)).otherwise(F.pmod(F.lit(step) - slot, F.lit(last)))
    return F.least(slot, partner.cast("long"))


def _rotated(n: int) -> Callable:
    def rotate(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).sort_by("slot").to_pylist()  # two blocks
        w, v = (np.hstack([np.frombuffer(r[c]).reshape(n, -1) for r in found]) for c in ("w", "v"))
        gram = w.T @ w
        length = np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
        cosines = np.abs(gram / np.outer(length, length))
        np.fill_diagonal(cosines, 0)
        off = cosines.max(initial=0.0)
        if off > ORTHOGONAL:
            turn = np.linalg.eigh(gram)[1][:, ::-1]
            w, v = w @ turn, v @ turn
        low = 0
        for r in found:
            high = low + len(r["w"]) // (8 * n)
            row = [r["b"], r["slot"], np.ascontiguousarray(w[:, low:high]).tobytes(), np.ascontiguousarray(v[:, low:high]).tobytes(), max(off, r["off"])]
            low = high
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["b", "slot", "w", "v", "off"])

    return rotate


def block_jacobi(cells: DataFrame, n: int, max_sweeps: int) -> DataFrame:
    """(b, r, c, v) of the symmetric n x n matrix of each b, of whose cells (b, r, c, v) the upper triangle counts.

    Row -1 has the eigenvalues, by falling value; the other rows are the eigenvectors, by columns.
    """
    upper = cells.where("r <= c")
    both = upper.unionByName(upper.where("r < c").select("b", F.col("c").alias("r"), F.col("r").alias("c"), "v"))
    wide = max(1, min(MOST_COLUMNS, max(LEAST_COLUMNS, BLOCK_ELEMENTS // n), -(-n // 2)))
    slots = -(-n // wide)
    slots += slots % 2  # one may be empty
    packed = tiles.packed(both, ["b"], F.col("r"), F.col("c"), F.col("v"), (n, n), (n, wide)).df
    # no eigenvalue is below minus the root of the sum of squares
    shift = both.groupBy("b").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("shift"))

    def begun(batches: tiles.Batches) -> tiles.Batches:
        for found in batches:
            for r in found.to_pylist():
                w = np.frombuffer(r["block"]).reshape(n, -1).copy()
                v = np.zeros_like(w)
                v[r["col"] * wide + np.arange(w.shape[1]), np.arange(w.shape[1])] = 1
                w += r["shift"] * v
                columns = [pa.array([r["b"]]), pa.array([r["col"]]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([0.0])]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "slot", "w", "v", "off"])

    state = packed.join(shift, "b").select("b", "col", "block", "shift").mapInArrow(begun, STATE)
    for _ in range(max_sweeps):
        state = state.withColumn("off", F.lit(0.0))
        for step in range(slots - 1):
            state = state.groupBy("b", pair_of(F.col("slot"), step, slots).alias("_pair")).applyInArrow(_rotated(n), STATE)
            if step % STEPS == STEPS - 1 or step == slots - 2:
                state = stored(state, "columns")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= ORTHOGONAL:
            break

    def told(batches: tiles.Batches) -> tiles.Batches:
        for found in batches:
            for r in found.to_pylist():
                w, v = (np.frombuffer(r[c]).reshape(n, -1) for c in ("w", "v"))
                both = np.vstack([(w * v).sum(0), v])
                yield from tiles.rows_of([("b", r["b"])], both, -1, r["slot"] * wide, ("r", "c"))

    rows = state.select("b", "slot", "w", "v").mapInArrow(told, "b long, r long, c long, v double")
    values = rows.where("r = -1").join(shift, "b").select("b", "c", (F.col("v") - F.col("shift")).alias("value"))
    order = Window.partitionBy("b").orderBy(F.col("value").desc(), "c")
    ranked = values.withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    placed = rows.join(ranked, ["b", "c"])
    return placed.select("b", "r", F.col("k").alias("c"), F.when(F.col("r") == -1, F.col("value")).otherwise(F.col("v")).alias("v"))


# -- panels -----------------------------------------------------------------------------------------------------

#: Vectors of a panel besides those wanted, and panels of a basis.
OVERSAMPLE = 8
PANELS = 6
#: Bases that are built at most, each from the best vectors of the one before, and the residual that ends this.
RESTARTS = 12
RESIDUAL = 1e-11
#: Elements of a block of rows.
ROW_ELEMENTS = 1 << 20
BRANCHES = 32


class Components(NamedTuple):
    projections: TensorFrame
    variances: np.ndarray
    vectors: np.ndarray


def _gathered(blocks: DataFrame, of_task: Callable, join: Callable, shape: tuple[int, int]) -> np.ndarray:
    """What ``of_task`` makes of a task's blocks, a matrix a task, joined in a tree of two levels."""

    def run(batches: tiles.Batches) -> tiles.Batches:
        made = of_task(x for found in batches for x in found.column(0))
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % BRANCHES]), pa.array([made.tobytes()], pa.binary())], names=["part", "m"])

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for found in batches:
            for x in found.column(found.schema.get_field_index("m")):
                m = np.frombuffer(x.as_buffer()).reshape(-1, shape[1])
                total = m if total is None else join(total, m)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    parts = blocks.select("block").mapInArrow(run, "part long, m binary").groupBy("part").applyInArrow(level, "part long, m binary")
    return reduce(join, (np.frombuffer(r["m"]).reshape(-1, shape[1]) for r in parts.collect()))  # BRANCHES rows at most


def components(t: TensorFrame, k: int, standardize: bool) -> Components:
    """The ``k`` leading principal components of {rows, columns}; a component's largest entry is positive.

    The driver holds PANELS panels of columns x (k + OVERSAMPLE); a task holds a panel and a block of rows.
    """
    rows, n = t.shape
    value = finite(no_nan(F.col("v"), "pca"), "pca")
    with raised():
        told = t.df.groupBy("i1").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("s")).toPandas()  # a row a column
    mean, scale = np.empty(n), np.ones(n)
    at = told["i1"].to_numpy()
    mean[at] = told["mean"]
    if standardize:
        scale[at] = told["s"]
        require(bool(scale.all()), ComputationError, "pca", "a column is constant")
    high = max(1, min(rows, ROW_ELEMENTS // n, -(-rows // t.df.sparkSession.sparkContext.defaultParallelism)))
    blocks = stored(tiles.packed(t.df, [], F.col("i0"), F.col("i1"), value, (rows, n), (high, n), times=1).df.select("row", "block"), "rows")

    def centred(x: pa.Scalar) -> np.ndarray:
        return (np.frombuffer(x.as_buffer()).reshape(-1, n) - mean) / scale

    def through(panel: np.ndarray) -> np.ndarray:
        """The covariance times a panel, in one pass over the rows."""

        def of_task(found: Iterator[pa.Scalar]) -> np.ndarray | None:
            total = None
            for x in map(centred, found):
                made = x.T @ (x @ panel)
                total = made if total is None else total + made
            return total

        return _gathered(blocks, of_task, np.add, panel.shape) / (rows - 1)

    def triangle(basis: np.ndarray) -> np.ndarray:
        """R of the rows projected on the basis: a tree of small QR decompositions."""
        small = lambda m: np.linalg.qr(m, "r")

        def of_task(found: Iterator[pa.Scalar]) -> np.ndarray | None:
            total = None
            for x in map(centred, found):
                made = small(x @ basis)
                total = made if total is None else small(np.vstack([total, made]))
            return total

        return _gathered(blocks, of_task, lambda a, b: small(np.vstack([a, b])), (0, basis.shape[1]))

    width = min(n, k + OVERSAMPLE)
    start = np.linalg.qr(np.random.default_rng(n).normal(size=(n, width)))[0]
    for _ in range(RESTARTS):
        basis = panel = start
        while basis.shape[1] < min(n, PANELS * width):
            panel = through(panel)
            least = 1e-12 * np.linalg.norm(panel)
            for _ in range(2):  # once more, for what rounding leaves
                panel, r = np.linalg.qr(panel - basis @ (basis.T @ panel))
                panel, least = panel[:, np.abs(np.diag(r)) > least], 0.5
            panel = panel[:, : n - basis.shape[1]]
            if not panel.shape[1]:  # the basis holds all that the rows span
                break
            basis = np.hstack([basis, panel])
        values, turn = np.linalg.svd(triangle(basis))[1:]
        values = np.append(values, np.zeros(len(turn) - len(values))) ** 2 / (rows - 1)
        start = basis @ turn[:width].T
        if basis.shape[1] == n or not panel.shape[1]:
            break
        gap = through(start[:, :k]) - start[:, :k] * values[:k]
        if np.linalg.norm(gap, axis=0).max() <= RESIDUAL * values[0]:
            break
    vectors, values = start[:, :k], values[:k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)

    def projected(batches: tiles.Batches) -> tiles.Batches:
        for found in batches:
            for row, x in zip(found.column(0).to_pylist(), found.column(1)):
                yield from tiles.rows_of([], centred(x) @ vectors, row * high, 0, ("i0", "i1"))

    return Components(t.with_df(blocks.mapInArrow(projected, "i0 long, i1 long, v double"), (rows, k)), values, vectors)
