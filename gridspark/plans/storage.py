"""Tables that a plan keeps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _of_local_session(application: str) -> str:
    return tempfile.mkdtemp(prefix="gridspark-kept-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names; where it is unset a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _of_local_session(spark.sparkContext.applicationId)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, so that what depends on its partitions holds."""
    path = f"{shared_folder(df.sparkSession)}/gridspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
