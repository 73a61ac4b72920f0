"""Running sums and ranks over more rows than a task should hold.

Ranks take Spark's range exchange: rows are dealt to parts by the whole sort order, which tells them apart, and sorted
there; the parts' sizes are the offsets of their rows' numbers. Running sums deal positions to blocks; the blocks' sums
are scanned in the same way, level by level, and a window inside each block adds the rest.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.storage import stored

BLOCK = 65_536
#: Rows that are ranked by one task, without an exchange.
FEW = 4_096
#: Rows of a part of the range exchange.
PART_ROWS = 250_000


def running_sum(df: DataFrame, keys: list[str], at: Column, length: int, value: str, name: str, kind: str, block: int = BLOCK, *, own: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to position ``at`` (0 to ``length`` - 1) among equal ``keys``.

    No window has more than ``block`` rows: blocks' sums are themselves summed in blocks, in as many levels as it takes.
    Where positions have gaps, whole blocks can be missing, and sums are still right. Without ``own``, a row's own value is left out.
    """
    total = lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    if length <= block:
        one = Window.partitionBy(*(keys or [F.lit(0)]))
        return df.withColumn(name, total(one.orderBy(at)).cast(kind))
    level = f"_block{length}"
    dealt = df.withColumn(level, F.floor(at / F.lit(block)))
    sums = dealt.groupBy(*keys, level).agg(F.sum(value).alias("_sum"))
    above = running_sum(sums, keys, F.col(level), -(-length // block), "_sum", "_up_to", sums.schema["_sum"].dataType.simpleString(), block, own=False)
    offsets = above.select(*keys, level, F.col("_up_to").alias("_before"))
    inside = dealt.withColumn("_own", total(Window.partitionBy(*keys, level).orderBy(at)))
    added = (F.col("_own") if own else F.coalesce(F.col("_own"), F.lit(0))) + F.coalesce(F.col("_before"), F.lit(0))
    return inside.join(offsets, [*keys, level], "left").withColumn(name, added.cast(kind)).drop(level, "_own", "_before")


def ranked(df: DataFrame, order: list[Column], rows: int, name: str, few: int = FEW, part_rows: int = PART_ROWS) -> DataFrame:
    """``df``, of ``rows`` rows, with ``name``: the position, from 0, by ``order``, which should tell all rows apart.

    Rows are dealt and sorted by Spark's range exchange and kept, since another exchange would draw other bounds.
    """
    if rows <= few:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))
    parts = max(-(-rows // part_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // few)))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranked")  # the part in the upper 31 bits, the row in the lower 33
    part = F.shiftright("_place", 33)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a part
    offsets = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    found = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    joined = kept.join(found, part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def ranked_along(df: DataFrame, keys: list[str], order: list[Column], rows: int, length: int, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the position, from 0, by ``order`` among rows of equal ``keys``, each of which has ``length`` of the ``rows``.

    Axes of over ``block`` rows are ranked with all keys together: as each key has as many rows, the rest of the position
    is the one along the axis.
    """
    if length <= block:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    return ranked(df, [*map(F.col, keys), *order], rows, name).withColumn(name, F.col(name) % F.lit(length))


def numbered(df: DataFrame, order: list[str], name: str, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, with dense row numbers by ``order`` (ascending, nulls first).

    Rows that are equal in all of ``order`` are interchangeable.
    """
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    return ranked(told, [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie")], rows, name).drop("_tie")
