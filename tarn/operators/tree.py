"""Trees: flattening into paths, and Merkle ids from the leaves up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.canonical import entry_json, tree_json
from tarn.functions.hashing import meta_id
from tarn.operators.graph import MissingObjects
from tarn.operators.shared import stored


def entries(trees: DataFrame) -> DataFrame:
    """(tree_id, name, type, child_id, target) of trees (id, entries)."""
    one = trees.select(F.col("id").alias("tree_id"), F.explode(F.col("entries")).alias("name", "e"))
    return one.select("tree_id", "name", F.col("e.type").alias("type"), F.col("e.id").alias("child_id"), F.col("e.target").alias("target"))


def streamed_ids(rows: DataFrame) -> DataFrame:
    """(tree, id) of trees given as rows (tree, name, type, id, target), in sha256 mode; tree: any string that tells them apart.

    A tree's entries pass through its hash in order, so its JSON is never held.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, name, h = None, None, None
        for batch in batches:
            out = []
            for tree, own, json in batch.itertuples(index=False):
                if own is None or h is not None and (tree, own) == (last, name):
                    raise ValueError(f"a tree has an entry without a name, or two of one name: {own}")
                if h is None or tree != last:
                    if h is not None:
                        h.update(b"}}")
                        out.append((last, h.hexdigest()))
                    last, h = tree, hashlib.sha256(b'tree:{"entries":{')
                else:
                    h.update(b",")
                h.update(json.encode())
                name = own
            yield pd.DataFrame(out, columns=["tree", "id"], dtype=object)
        if h is not None:
            h.update(b"}}")
            yield pd.DataFrame([(last, h.hexdigest())], columns=["tree", "id"], dtype=object)

    one = rows.select("tree", "name", entry_json(F.col("name"), F.struct("type", "id", "target")).alias("json"))
    return one.repartition("tree").sortWithinPartitions("tree", "name").mapInPandas(hashed, "tree string, id string")


def unsafe_names(tree_entries: DataFrame) -> DataFrame:
    """Entries whose names would leave their directory."""
    return tree_entries.where(F.col("name").isin("", ".", "..") | F.col("name").contains("/") | F.col("name").contains("\0"))


def flatten(roots: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(root_id, path, type, id, target) of everything below roots (id), one level of directories a round."""
    if not unsafe_names(tree_entries).isEmpty():
        raise ValueError("a tree has an entry whose name is not a plain file name")
    now = roots.select(F.col("id").alias("root_id"), F.lit("").alias("base"), F.col("id").alias("tree_id"))
    found: list[DataFrame] = []
    known = tree_entries.select("tree_id").distinct()
    while True:
        lost = now.join(known, "tree_id", "left_anti").select("tree_id").limit(1).collect()
        if lost and found:
            raise MissingObjects(f"no such tree: {lost[0][0]}")
        step = now.join(tree_entries, "tree_id").select("root_id", F.concat("base", "name").alias("path"), "type", F.col("child_id").alias("id"), "target")
        step = stored(step, "flatten")
        found.append(step)
        now = step.where("type = 'Tree'").select("root_id", F.concat("path", F.lit("/")).alias("base"), F.col("id").alias("tree_id"))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, found)


def build(files: DataFrame, algorithm: str = "blake3") -> tuple[DataFrame, DataFrame]:
    """Trees of files: (root, path, type, id, target) -> ((id, json, entries) of every tree, (root, tree_id)).

    A directory's id needs those of its directories, so the deepest are built first, a round a level.
    """
    depth = F.size(F.split("path", "/"))
    rows = stored(files.select("root", F.col("path"), depth.alias("depth"), "type", "id", "target"), "files")
    deepest = rows.agg(F.max("depth")).first()[0] or 1
    built: list[DataFrame] = []
    above = None
    for level in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == level).drop("depth")
        if above is not None:
            here = here.unionByName(above)
        name, parent = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
        pair = F.struct(name.alias("name"), F.struct("type", "id", "target").alias("entry"))
        trees = here.groupBy("root", parent.alias("path")).agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("entries"))
        json = tree_json(F.col("entries"))
        trees = stored(trees.withColumn("json", json).withColumn("id", meta_id("tree", json, algorithm)), "trees")
        built.append(trees.select("id", "json", "entries"))
        above = trees.select("root", "path", F.lit("Tree").alias("type"), "id", F.lit(None).cast("string").alias("target"))
    return reduce(DataFrame.unionByName, built).dropDuplicates(["id"]), above.select("root", F.col("id").alias("tree_id"))
