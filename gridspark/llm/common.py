"""What the text operators share: storage for intermediate tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@lru_cache
def _of_local_session(application: str) -> str:
    return tempfile.mkdtemp(prefix="gridspark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, since no folder of the
    driver's machine reaches the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _of_local_session(spark.sparkContext.applicationId)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe from lost executors.

    The folder is the run's scratch space and goes with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (a few numbers each), to be broadcast if a count finds at most ``most``; else the join may shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id's decimal text leaves the remainder part; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts) == F.lit(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
