"""Counts, means and Gram matrices of centred rows that merge, as one packed row a task.

The elements of a sample (a row of the matrix) mostly come together. A task adds up the samples that it has whole, in one
pass over its elements, and hands on a single row; only elements whose sample is not whole in the task are shuffled, by
sample, and added up there. Moments are centred, so merging them loses no digits, and they are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from gridspark.frame import TensorFrame
from gridspark.functions.guards import finite, no_nan
from gridspark.plans import tiles

#: Elements of unfinished samples that a task holds, and that one group of them has.
PENDING = 1 << 20
#: Elements of moments that a task holds.
HELD = 8 << 20
#: Branches of a level of the tree.
BRANCHES = 32
NAMES = ["b", "bucket", "sample", "event", "v", "n", "mean", "gram"]
SCHEMA = "b long, bucket long, sample long, event long, v double, n long, mean binary, gram binary"
KINDS = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.binary(), pa.binary()]

Moments = tuple[int, np.ndarray, np.ndarray]


def of_block(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    x = x - mean
    return len(x), mean, x.T @ x


def merged(a: Moments | None, b: Moments) -> Moments:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


class Gathered:
    """Moments by batch, and the elements of samples that are not whole yet."""

    def __init__(self, events: int) -> None:
        self.events = events
        self.moments: dict[int, Moments] = {}
        self.pending = np.empty((0, 3), np.int64), np.empty(0)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Elements: rows (batch, sample, event) of ``keys`` and their values."""
        keys, values = np.concatenate([self.pending[0], keys]), np.concatenate([self.pending[1], values])
        order = np.lexsort(keys.T[::-1])
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.append(True, (keys[1:, :2] != keys[:-1, :2]).any(1))) if len(keys) else np.empty(0, np.int64)
        whole = np.repeat(np.diff(np.append(first, len(keys))) == self.events, np.diff(np.append(first, len(keys))))
        self.pending = keys[~whole], values[~whole]
        batch, rows = keys[whole][:: self.events, 0], values[whole].reshape(-1, self.events)
        for b in np.unique(batch).tolist():
            self.merge(b, of_block(rows[batch == b]))

    def merge(self, b: int, m: Moments) -> None:
        self.moments[b] = merged(self.moments.get(b), m)

    def told(self, bucket: int) -> Iterator[pa.RecordBatch]:
        """The moments as rows; they are given up."""
        for b, (n, mean, gram) in self.moments.items():
            row = [b, bucket, None, None, None, n, mean.tobytes(), gram.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS)], names=NAMES)
        self.moments.clear()

    def rest(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The elements of unfinished samples as rows; they are given up."""
        keys, values = self.pending
        if len(keys):
            none = [pa.nulls(len(keys), k) for k in KINDS[5:]]
            columns = [keys[:, 0], keys[:, 1] % buckets, keys[:, 1], keys[:, 2], values]
            yield pa.RecordBatch.from_arrays([*map(pa.array, map(np.ascontiguousarray, columns)), *none], names=NAMES)
        self.pending = np.empty((0, 3), np.int64), np.empty(0)


def _columns(found: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [found.column(found.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _moments(found: pa.RecordBatch, events: int) -> Iterator[tuple[int, Moments]]:
    at = {n: found.column(found.schema.get_field_index(n)) for n in ("b", "n", "mean", "gram")}
    for k in range(found.num_rows):
        if at["n"][k].is_valid:
            yield at["b"][k].as_py(), (at["n"][k].as_py(), np.frombuffer(at["mean"][k].as_buffer()), tiles.as_block(at["gram"][k].as_buffer(), events))


def covariances(t: TensorFrame, ddof: int) -> TensorFrame:
    """Of every matrix {samples, events} on the last two axes the covariances {events, events}."""
    *batch, sample, event = t.coords
    lead, (n, e) = t.shape[:-2], t.shape[-2:]
    buckets = -(-prod(lead) * n * e // PENDING)
    flat = F.lit(0).cast("long")
    for c, size in zip(batch, lead):
        flat = flat * size + F.col(c)
    cells = t.df.select(flat.alias("b"), F.col(sample).alias("sample"), F.col(event).alias("event"), no_nan(F.col("v"), "cov").alias("v"))

    def first(batches: tiles.Batches) -> tiles.Batches:
        own, part = Gathered(e), -1 - TaskContext.get().partitionId() % BRANCHES
        for found in batches:
            b, s, j, v = _columns(found, "b", "sample", "event", "v")
            own.add(np.column_stack([b, s, j]), v)
            if len(own.pending[0]) > PENDING:
                yield from own.rest(buckets)
            if len(own.moments) * e * e > HELD:
                yield from own.told(part)
        yield from own.told(part)
        yield from own.rest(buckets)

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (b, bucket) = Gathered(e), (k.as_py() for k in key)
        for found in batches:
            for k, m in _moments(found, e):
                own.merge(k, m)
            s, j, v, told = _columns(found, "sample", "event", "v", "n")
            rest = np.isnan(told.astype(float))
            if rest.any():
                s, j = s[rest].astype(np.int64), j[rest].astype(np.int64)
                own.add(np.column_stack([np.full(len(s), b), s, j]), v[rest].astype(float))
        yield from own.told(-1 - bucket % BRANCHES if bucket >= 0 else bucket)

    def last(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for found in batches:
            for _, m in _moments(found, e):
                total = merged(total, m)
        yield from tiles.rows_of([("b", key[0].as_py())], total[2] / (n - ddof), 0, 0, ("r", "c"))

    level_of = lambda df: df.groupBy("b", "bucket").applyInArrow(level, SCHEMA)
    parts = level_of(cells.mapInArrow(first, SCHEMA))
    if buckets > BRANCHES:  # groups of unfinished samples are many: a further level
        parts = level_of(parts)
    out = parts.groupBy("b").applyInArrow(last, "b long, r long, c long, v double")
    coords, step = [], prod(lead)
    for c, size in zip(batch, lead):
        step //= size
        coords.append(F.expr(f"(b div {step}) % {size}").cast("long").alias(c))
    return t.with_df(out.select(*coords, F.col("r").alias(sample), F.col("c").alias(event), finite(F.col("v"), "cov").alias("v")), (*lead, e, e))
