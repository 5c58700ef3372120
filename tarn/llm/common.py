"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/tarn"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; an error on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED
    return f"{root.rstrip('/')}/tarn/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write df in the shared folder and read it again: its lineage ends there and survives lost executors.

    scratch: gets the path, for who will delete it.
    """
    path = shared_path(df.sparkSession, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of shared_path() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_all(spark: SparkSession, scratch: list[str]) -> None:
    """Delete what stored() has put in scratch, once nothing reads it any more."""
    while scratch:
        drop_path(spark, scratch.pop())


def held_out(doc_id: Column) -> Column:
    """True for the rows whose label no model may learn; a null id is held out too."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
