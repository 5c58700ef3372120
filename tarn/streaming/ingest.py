"""Continuous ingest: every micro-batch goes through the store's idempotent insert.

Ids never expire, so a streaming dropDuplicates would keep state without end; the anti-join
against the store needs none, and a batch that is repeated after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.store import Store, blobs


def ingest(stream: DataFrame, store: Store, checkpoint: str, column: str = "content", once: bool = True):
    """Starts a query that stores a binary column of a stream as blobs; with once, what is there now."""

    def put(batch: DataFrame, _: int) -> None:
        store.insert(blobs(batch, column, algorithm=store.algorithm), check_references=False)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_totals(events: DataFrame) -> DataFrame:
    """(received_bytes, num_objects) of progress events, batch or streaming."""
    read = F.sum(F.when(F.col("event") == "read", F.col("bytes")))
    return events.agg(F.coalesce(read, F.lit(0)).alias("received_bytes"), F.count_if(F.col("event") == "begin").alias("num_objects"))
