"""Mixing sources to target weights, in DataFrame functions only.

Each source's tokens are added up, a target is set for each source, and the ratio of the two is the
source's repetition rate. A document is emitted floor(rate) times, and once more where a hash of
its id falls below the rate's fraction (a Bernoulli copy with that probability; reruns agree).

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating. They share 150% of all
tokens, but none gets over twice its own; what is over is shared again by weight until none is
above. That fixed point is min(cap, level * weight): a source is at its cap when its cap per weight
is at or below the level that the remaining tokens and weights give, so one pass over the sources
in order of cap per weight finds it. Only one row per source goes through that ordering.

Defined cases: a null or blank text has size 0; a null source is a source of its own; a null id
hashes as the word null; rows with the same id get the same number of copies; a source without
words has target 0; an empty table gives an empty result. Other columns pass through, whatever
their names: mix() picks names of its own that none begins with, plan() takes the caller's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import WORD

#: The weights of the sources, in turn.
WEIGHTS = (3, 1, 2)
#: The share of all tokens to take, and the most a source is repeated.
SHARE, MOST = 1.5, 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, size) per document. Returns source, source_size, target: a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.select("source", "source_size", rank.alias("rank"), weight.cast("long").alias("weight"))
    # everything doubled, so that shares and caps are whole numbers
    cap = F.col("source_size") * (2 * MOST)
    every = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        cap.alias("cap"),
        (F.sum("source_size").over(every) * int(2 * SHARE)).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    capped = F.col("cap").cast("double") * (F.col("weights") - F.col("weight_before")) <= F.col("weight").cast("double") * (F.col("total") - F.col("cap_before"))
    per = per.withColumn("capped", capped)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_weights = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(0))
    per = per.withColumns({"rest": rest, "open_weights": open_weights})
    target = F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / (F.lit(2.0) * F.col("open_weights"))
    )
    return per.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone: 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: str = SEED, prefix: str = "_mix_") -> DataFrame:
    """Every row of docs with the operator's columns added: size, source_size, target and copies, prefixed."""
    p = prefix
    sized = docs.withColumn(f"{p}size", word_count(F.col("text")))
    per = targets(docs.select("source", word_count(F.col("text")).alias("size")))
    per = per.select(F.col("source").alias(f"{p}source"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target"))
    joined = sized.join(per, sized["source"].eqNullSafe(per[f"{p}source"]), "left").drop(f"{p}source")
    rate = F.when(F.col(f"{p}source_size") > 0, F.col(f"{p}target") / F.col(f"{p}source_size")).otherwise(0.0)
    copies = F.floor(rate) + (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(f"{p}copies", copies)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed rows: those of docs with its columns, each as often as its copies say."""
    p = "_mix_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    planned = plan(docs, seed, p).where(F.col(f"{p}copies") > 0)
    times = F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies"))
    return planned.withColumn(f"{p}copy", F.explode(times)).select(*[planned[f"`{c}`"] for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    planned = plan(docs)
    return planned.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM per
), weighed AS (
  SELECT *, ([3, 1, 2])[((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM ranked
), ordered AS (
  SELECT *, source_size * 4 AS cap,
    (sum(source_size) OVER () * 3)::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(sum(source_size * 4) OVER o, 0)::BIGINT AS cap_before,
    coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before
  FROM weighed
  WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap::DOUBLE * (weights - weight_before) <= weight::DOUBLE * (total - cap_before) AS capped FROM ordered
), open AS (
  SELECT *,
    total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)::BIGINT AS rest,
    coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0)::BIGINT AS open_weights
  FROM marked
), targets AS (
  SELECT source, source_size,
    CASE WHEN capped THEN (source_size * 2)::DOUBLE ELSE (weight * rest)::DOUBLE / (2.0::DOUBLE * open_weights) END AS target
  FROM open
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
