"""Files of a directory as rows, with executable bits and symbolic links."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, type string, executable boolean, target string"


def listing(root: str) -> list[tuple[str, str, bool | None, str | None]]:
    """(path, type, executable, target) below root, sorted; links are not followed, and name a target relative to themselves."""
    out = []
    for base, dirs, names in os.walk(root):
        for name in [*names, *(d for d in dirs if os.path.islink(f"{base}/{d}"))]:
            full = f"{base}/{name}"
            path = posixpath.relpath(full, root)
            if os.path.islink(full):
                target = os.readlink(full)
                if posixpath.isabs(target):
                    target = posixpath.relpath(target, posixpath.dirname(full))
                out.append((path, "Symlink", None, target))
            else:
                out.append((path, "Blob", bool(os.stat(full).st_mode & 0o100), None))
    return sorted(out)


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """path, type, executable, target, content, size of a local directory. Content comes through `binaryFile`."""
    root = os.path.realpath(root)
    listed = spark.createDataFrame(listing(root), FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    content = files.select(F.expr(f"substring(path, {len(f'file:{root}/') + 1})").alias("_path"), "content", F.col("length").alias("size"))
    return listed.join(content, (F.col("path") == F.col("_path")) & (F.col("type") == "Blob"), "left").drop("_path")
