"""Encodings, losses and principal components."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.errors import BoundsError, ValidationError, require
from gridspark.frame import TensorFrame, joined
from gridspark.functions.guards import ensure, finite, no_nan
from gridspark.operators import elementwise, linalg, reduce, spectra
from gridspark.plans import shapes
from gridspark.plans.scan import BLOCK
from gridspark.sources import tensors

#: Components are few if there are so many columns for each.
PANEL_SHARE = 4


def one_hot_expand_at(t: TensorFrame, axis: int, axis_index: int, depth: int, on: float = 1, off: float = 0) -> TensorFrame:
    """Slice ``axis_index`` of ``axis`` holds labels from 0 below ``depth``; ``depth`` slices take its place."""
    where = "one_hot_expand_at"
    require(t.rank > 0, ValidationError, where, "an empty tensor")
    axis = shapes.axis_of(axis, t.rank, where)
    require(depth >= 1, ValidationError, where, "the depth is 0")
    require(0 <= axis_index < t.shape[axis], BoundsError, where, f"slice {axis_index} of {t.shape[axis]}")
    at = F.col(f"i{axis}")
    value = no_nan(F.col("v"), where) if t.is_float else F.col("v")
    checked = t.df.withColumn("v", value)
    label = F.round("v") if t.is_float else F.col("v")
    bad = (F.abs(F.col("v") - label) > 1e-3) | (label < 0) | (label >= depth)
    label = F.when(bad, F.raise_error(F.lit(f"{ValidationError.prefix}: {where}: a label is not 0 to {depth - 1}")).cast("double")).otherwise(label)
    hot = (
        checked.where(at == axis_index)
        .withColumn("_label", label)
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        .withColumn("v", F.when(F.col("_slot") == F.col("_label"), F.lit(on)).otherwise(F.lit(off)).cast(t.sql_type))
        .withColumn(f"i{axis}", (at + F.col("_slot")).cast("long"))
    )
    rest = checked.where(at != axis_index).withColumn(f"i{axis}", F.when(at > axis_index, at + (depth - 1)).otherwise(at))
    shape = tuple(n - 1 + depth if d == axis else n for d, n in enumerate(t.shape))
    return t.with_df(rest.select(*t.coords, "v").unionByName(hot.select(*t.coords, "v")), shape)


def softmax(t: TensorFrame, axis: int | None = None) -> TensorFrame:
    """e^v over its sum along an axis, or over all elements. Not shifted: a large value is the non-finite error."""
    require(t.rank > 0 and t.is_float, ValidationError, "softmax", "a float tensor is needed")
    powers = t.map(lambda v: elementwise.single(F.exp(no_nan(v, "softmax")), "softmax"))
    if axis is not None and t.shape[shapes.axis_of(axis, t.rank, "softmax")] <= BLOCK and t.rank > 1:
        axis = shapes.axis_of(axis, t.rank, "softmax")
        others = [c for d, c in enumerate(t.coords) if d != axis]
        share = F.col("v") / F.sum("v").over(Window.partitionBy(*others))
        return t.with_df(powers.df.select(*t.coords, finite(share, "softmax").alias("v")))
    return elementwise.div(powers, reduce.sum(powers, axis))


def cross_entropy(
    logits: TensorFrame, labels: TensorFrame, axis: int | None = None, from_logits: bool = True, reduction_mean: bool = True
) -> TensorFrame:
    """-sum of labels * ln p along the class axis, which stays as 1; then the mean of what is left.

    The axis counts in the operands' common rank. Without an axis everything is one distribution.
    """
    where = "cross_entropy"
    require(logits.rank > 0 and labels.rank > 0, ValidationError, where, "an empty operand")
    rank = max(logits.rank, labels.rank)
    own = None
    if axis is not None:
        axis = shapes.axis_of(axis, rank, where)
        own = axis - (rank - logits.rank)
        require(own >= 0, BoundsError, where, "the logits lack the class axis")
    p = softmax(logits, own) if from_logits else logits
    df, shape = joined([p, labels], where)
    v0, v1 = no_nan(F.col("v0"), where), no_nan(F.col("v1"), where)
    outside = v0 <= 0
    term = ensure(v1 * F.ln(F.when(outside, F.lit(1.0)).otherwise(v0)), outside, elementwise.NonFiniteError, where, "a result is not finite")
    coords = [f"i{d}" for d in range(len(shape))]
    loss = reduce.sum(TensorFrame(df.select(*coords, (-term).alias("v")), shape), axis)
    return reduce.mean(loss) if reduction_mean else loss


def mean_squared_error(prediction: TensorFrame, target: TensorFrame, axis: int | None = None, reduction_mean: bool = True) -> TensorFrame:
    """The sum of squared differences along an axis (over everything, without one), then the mean of what is left."""
    df, shape = joined([prediction, target], "mean_squared_error")
    gap = no_nan(F.col("v0"), "mean_squared_error") - no_nan(F.col("v1"), "mean_squared_error")
    square = finite(gap * gap, "mean_squared_error").alias("v")
    loss = reduce.sum(TensorFrame(df.select(*[f"i{d}" for d in range(len(shape))], square), shape), axis)
    return reduce.mean(loss) if reduction_mean else loss


class PCAResult(NamedTuple):
    projections: TensorFrame
    explained_variance: TensorFrame
    loadings: TensorFrame


def pca(data: TensorFrame, n_components: int | None = None, standardize: bool = True) -> PCAResult:
    """Principal components of {batch..., rows, columns}: eigenvalues of the covariance (ddof 1), largest first.

    A few components of many columns are found by panels that go through the rows; then no matrix of columns x columns
    arises, and the work is done when this is called. Otherwise the covariance is solved; rows stay distributed either way.
    """
    require(data.rank >= 2 and data.is_float, ValidationError, "pca", "a float tensor of two axes or more is needed")
    rows, columns = data.shape[-2:]
    k = columns if n_components is None else n_components
    require(1 <= k <= columns, ValidationError, "pca", f"{k} components of {columns}")
    require(rows >= 2, ValidationError, "pca", "two rows are needed")
    if data.rank == 2 and columns > linalg.FEW_EVENTS and PANEL_SHARE * k <= columns:
        found, spark = spectra.components(data, k, standardize), data.df.sparkSession
        return PCAResult(found.projections, tensors.from_values(spark, found.variances, (1, k)), tensors.from_values(spark, found.vectors))
    x = reduce.center(data, -2)
    if standardize:
        x = elementwise.div(x, reduce.stddev(data, -2, 1))
    spectrum, loadings = linalg.eig(linalg.cov(x, ddof=1), 100, largest=k)
    return PCAResult(linalg.matmul(x, loadings), spectrum, loadings)
