"""A corpus pipeline over `documents`: drop toxic and poor documents, near-duplicates, mix the sources, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return rows with the columns of docs; the last returns a row per packed piece. Labels come
from the table of that name. Null and empty texts, repeated rows, empty tables and extra columns
are handled as each operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import mixing, near_dedup, packing, quality, toxicity
from tarn.llm.common import stored, table


#: Near-duplicates are judged on shingles of this many words, at this percentage of likeness or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the toxicity model, trained on labels of docs, does not reject; null and empty texts stay."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the quality model, trained on labels of docs, does not reject; a text without words gets the bias alone."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates of docs: the one with the least id; texts without words are in no group.

    Rows that repeat an id and a text are one document: the row whose columns come first as JSON stays.
    """
    found = near_dedup.near_duplicates(docs, SHINGLE, PERCENT).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = stored(found.where("kept").select(F.col("doc_id").alias("_id"), "n"), "kept")
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    row = F.struct(*safe.columns)
    once = safe.join(found.where("n = 1"), F.col(id_).eqNullSafe(F.col("_id")), "left_semi")
    again = safe.join(found.where("n > 1"), F.col(id_).eqNullSafe(F.col("_id")), "left_semi")
    again = again.groupBy(id_, text).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(again).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each as often as its source's repetition rate and its id's hash say; a text without words has no tokens."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of docs, placed in sequences; a repeated document is packed as often as it occurs."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
