"""Rows in a total order, dealt out in ranges.

An operator that needs each row's successor in a global order would otherwise need a window over
one partition. Here the order's keys are sampled by a hash (how many the driver sees depends on the
number of ranges, not on the rows), ranges are cut at sampled keys, and a row whose key begins a
range is sent to the range before it as well. Which keys are sampled decides how even the ranges
are and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import partitions

#: Sampled keys for each range, on average; ranges for each partition.
PER_RANGE, PER_PARTITION = 20, 4


def cuts(keys: DataFrame, key: str) -> list:
    """Keys, in order, at which a range begins (the first range has none)."""
    ranges = partitions(keys.sparkSession) * PER_PARTITION
    keys = keys.select(key).where(F.col(key).isNotNull())
    keep = max(1, keys.count() // (ranges * PER_RANGE))
    found = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(key), F.lit(keep)) == 0).distinct().collect())
    step = max(1, len(found) // ranges)
    return found[step::step]


def range_of(key: Column, at: list) -> Column:
    """The number of the range that a key lies in, by binary search; null keys lie in the last."""
    if not at:
        return F.lit(0)
    steps = [1 << k for k in range(len(at).bit_length() - 1, -1, -1)]
    table = F.array(*map(F.lit, at))

    def jump(low: Column, step: Column) -> Column:
        there = low + step
        return F.when((there <= len(at)) & (F.get(table, there - 1) <= key), there).otherwise(low)

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), jump)
    return F.when(key.isNull(), F.lit(len(at))).otherwise(found)


def with_successors(df: DataFrame, key: str, least, at: list) -> DataFrame:
    """df with _range and _after: a row per range that needs it, dealt and sorted.

    Within a partition, rows come in ranges; a range's own rows (_after 0) are in order of the key
    (null last), then the other columns, and behind them stand the rows that begin the next range
    (_after 1; the rows of the least key, for the last range).
    """
    own = range_of(F.col(key), at)
    starts = F.col(key).isin(at) if len(at) < 200 else F.array_contains(F.array(*map(F.lit, at)), F.col(key))
    copies = F.array(
        F.struct(own.alias("range"), F.lit(0).alias("after")),
        F.when(starts, F.struct((own - 1).alias("range"), F.lit(1).alias("after"))),
        F.when(F.col(key) == F.lit(least), F.struct(F.lit(len(at)).alias("range"), F.lit(1).alias("after"))) if least is not None else F.lit(None),
    )
    dealt = df.withColumn("_to", F.explode(F.array_compact(copies))).select(F.col("_to.range").alias("_range"), F.col("_to.after").alias("_after"), *df.columns)
    order = ["_range", "_after", F.col(key).asc_nulls_last(), *[c for c in df.columns if c != key]]
    return dealt.repartition(partitions(df.sparkSession), "_range").sortWithinPartitions(*order)
