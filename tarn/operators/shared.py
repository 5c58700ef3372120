"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/tarn"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; an error on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED
    return f"{root.rstrip('/')}/tarn/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: lineage is cut and nothing is lost with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
