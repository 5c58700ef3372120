"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` documents of each class (0 and 1), the same ones each time.

    Only rows that are not held out and whose label is 0 or 1 take part. Of several labels of one
    document the least counts, of several rows of one document the least text. The ids are chosen
    from the labels alone, so what is broadcast has at most 2 * most rows.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))


def filtered(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns whatever their names and types, for whose texts keep() is true."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(text).to_pylist()), pa.bool_()))

    return safe.mapInArrow(some, safe.schema).toDF(*docs.columns)
