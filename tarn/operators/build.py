"""Packages from files, and install manifests from packages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.canonical import package_json
from tarn.functions.hashing import ZERO, blob_id, meta_id
from tarn.functions.scan import binary_references, rewrite, write_at
from tarn.operators import tree


def build_package(files: DataFrame, name: str, system: str, out_dir: str, packages_path: str, allowed: list[str] | None = None, algorithm: str = "blake3") -> dict[str, DataFrame]:
    """A package of files (path, type, executable, target, content).

    Where content names out_dir, the future path with a zero id is written (filled up with /) and
    the offsets are recorded by blob. References are what content refers to, without the zero id; with
    `allowed`, all must be in it. Returns blobs, trees and package (one row).
    """
    placeholder = f"{packages_path}/{name}-{ZERO}"
    rows = files.where("type = 'Blob'").withColumn("r", rewrite(F.col("content"), out_dir, placeholder))
    blobs = rows.select("path", F.col("executable").alias("is_executable"), F.col("r.content").alias("content"), F.col("r.offsets").alias("offsets"))
    blobs = blobs.withColumn("id", blob_id(F.col("content"), F.col("is_executable"), algorithm)).withColumn("refs", binary_references(F.col("content")))
    leaves = blobs.select(F.lit(1).alias("root"), "path", F.lit("Blob").alias("type"), "id", F.lit(None).cast("string").alias("target"))
    links = files.where("type = 'Symlink'").select(F.lit(1).alias("root"), "path", "type", F.lit(None).cast("string").alias("id"), "target")
    trees, roots = tree.build(leaves.unionByName(links), algorithm)
    refs = blobs.select(F.explode("refs").alias("r")).where(F.col("r") != ZERO).distinct()
    if allowed is not None:
        more = [r[0] for r in refs.where(~F.col("r").isin(allowed)).orderBy("r").limit(5).collect()]
        if more:
            raise ValueError(f"references that are not dependencies: {', '.join(more)}")
    own = blobs.where(F.size("offsets") > 0).select("id", "offsets").dropDuplicates(["id"])
    one = roots.select("tree_id")
    one = one.crossJoin(refs.agg(F.array_sort(F.collect_set("r")).alias("references")))  # one row each
    one = one.crossJoin(own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "offsets")))).alias("self_references")))
    package = one.select(F.lit(name).alias("name"), F.lit(system).alias("system"), "references", "self_references", F.col("tree_id").alias("tree"))
    json = package_json({c: F.col(c) for c in package.columns})
    package = package.withColumn("json", json).withColumn("id", meta_id("pkg", json, algorithm))
    return {"blobs": blobs.dropDuplicates(["id"]).select("id", "is_executable", "content"), "trees": trees, "package": package}


def install_manifest(packages: DataFrame, tree_entries: DataFrame, blobs: DataFrame, packages_path: str = "", self_references: DataFrame | None = None) -> DataFrame:
    """What installing packages (id, name, self_references, tree) puts where.

    (package_id, path, action, blob_id, target, offsets): a link to a stored blob, a copy with the
    package's path written at offsets, or a symbolic link. A blob that is missing is an error.
    Self-references are joined as rows, so no file carries those of its whole package; given as rows
    (package_id, blob_id, offsets), the packages need no such column.
    """
    if self_references is None:
        self_references = packages.select(F.col("id").alias("package_id"), F.explode("self_references").alias("blob_id", "offsets"))
    own = self_references.select(F.col("package_id").alias("own_pkg"), F.col("blob_id").alias("own_blob"), "offsets").dropDuplicates(["own_pkg", "own_blob"])
    flat = tree.flatten(packages.select(F.col("tree").alias("id")).distinct(), tree_entries).where("type <> 'Tree'")
    prefix = F.concat(F.lit(f"{packages_path}/" if packages_path else ""), F.concat_ws("-", "name", "pkg_id"))
    pkgs = packages.select(F.col("id").alias("pkg_id"), "name", F.col("tree").alias("root_id"))
    rows = pkgs.join(flat, "root_id").withColumn("path", F.concat(prefix, F.lit("/"), F.col("path")))
    rows = rows.join(blobs.select(F.col("id").alias("have")).distinct(), (F.col("id") == F.col("have")) & (F.col("type") == "Blob"), "left")
    rows = rows.join(own, (F.col("pkg_id") == F.col("own_pkg")) & (F.col("id") == F.col("own_blob")), "left")
    lost = F.raise_error(F.concat(F.lit("no such blob: "), F.col("id"))).cast("string")
    offsets = F.col("offsets")
    action = F.when(F.col("type") == "Symlink", "symlink").when(F.col("have").isNull(), lost).when(offsets.isNotNull(), "rewrite").otherwise("link")
    return rows.select(F.col("pkg_id").alias("package_id"), "path", action.alias("action"), F.when(F.col("type") == "Blob", F.col("id")).alias("blob_id"), "target", F.when(F.col("type") == "Blob", offsets).alias("offsets"))


def installed_content(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, content, is_executable, target): the manifest with what each file holds."""
    rows = manifest.join(blobs.select(F.col("id").alias("blob_id"), "content", "is_executable"), "blob_id", "left")
    base = F.regexp_extract("path", r"(?s)^(.*?-[0-9a-f]{64})/", 1)
    content = F.when(F.col("action") == "rewrite", write_at(F.col("content"), F.col("offsets"), base)).otherwise(F.col("content"))
    return rows.select("path", content.alias("content"), "is_executable", "target")


def materialise(rows: DataFrame, root: str) -> int:
    """Writes installed_content() below a local directory, file by file; returns how many. Times are the epoch, modes 0444 or 0544."""
    n = 0
    for r in rows.toLocalIterator():
        full = os.path.join(root, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if r["target"] is not None:
            os.symlink(r["target"], full)
        else:
            with open(full, "wb") as f:
                f.write(bytes(r["content"]))
            os.chmod(full, 0o544 if r["is_executable"] else 0o444)
            os.utime(full, (0, 0))
        n += 1
    return n
