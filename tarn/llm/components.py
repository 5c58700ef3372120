"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stored


def _stars(sides: DataFrame, large: bool) -> DataFrame:
    """sides: (u, v). Links v to the least of u's neighbourhood, for v above u (large) or not above (small)."""
    least = sides.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    joined = sides.join(least.hint("merge"), "u")  # a hub's rows can be split: the other side has one
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """edges: (u, v) of longs -> (vertex, component), component the least vertex; only vertices with an edge.

    Each round is written to the shared folder, so lineage does not grow. The rounds needed grow
    with the logarithm of the longest path; scratch gets the paths of their tables. Loops and repeated edges do no harm.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", scratch)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).where("u <> v")
        # every edge now points to a smaller vertex
        small = _stars(large, False).where("u <> v").distinct()
        now = stored(small, "edges", scratch)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("vertex"), F.col("v").alias("component"))
