"""Mixing sources to target weights by weighted fair queueing.

Sources by code point (null last) get the weights 5, 2, 1, repeating, and share `share` times all words;
a target stops at `repeats` times its source's words, and the excess is shared again by weight.

Each source is a queue of its shuffled documents, repeated pass by pass. A document's virtual finish time
is the words its queue has sent by its end, divided by the source's target. Serving all queues fairly, the
mix reaches its budget, the sum of all targets, at one virtual time. The mix is range-sorted by finish
time and cut there; a document that is in service at the cut is taken as far as it was served, so each
source's words differ from its target by rounding only.

No queue is held by one task: words are summed by (source, hash bucket), the small bucket table gives
each bucket its offset, and the order within a bucket is a window over the bucket.

Null text counts 0 words. Null sources are one source. Rows with equal doc_id and size are
interchangeable. An empty table gives no rows; sources without words have the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import table
from wakeline.sources.scratch import materialize

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Buckets by 3 hex digits of the shuffle hash; a bucket holds 1/4096 of a source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size): exact water filling over the sources.

    Sorted by source_size / weight, the sources that stop at their limit are a prefix; the first source
    whose level holds for all after it gives the level. One row per source is all that this handles.
    """
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    fills_first = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fills_first.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    one = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(repeats))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("left_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(repeats))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("rank"), F.col("level")))).over(whole)["level"])
    )
    limit = F.col("source_size") * F.lit(float(repeats))
    return one.select(
        "source", "source_size", F.round(F.least(F.coalesce(F.col("final") * F.col("weight"), limit), limit), 6).alias("target")
    )


def _served(time: float, start: Column, size: Column, target: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, F.floor(F.lit(time) * target + F.lit(0.5)) - start))


def fair_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, virtual_finish, taken), range-sorted by finish time.

    `start` is the number of words that the source's queue sends before the document in its first pass.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"),
    ).withColumn("bucket", F.substring("shuffle", 1, BUCKET_DIGITS))
    # Sums, offsets and rows must agree although executors may be lost: the rows are written first.
    rows = materialize(rows, "mix-sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets.select("source", "size"), weights, share, repeats)
    offsets = buckets.select(
        F.col("source").alias("_source"),
        F.col("bucket").alias("_bucket"),
        (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("_before"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    named = targets.withColumnRenamed("source", "_source")
    plan = (
        rows.withColumn("_end", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
        .drop("_source", "_bucket")
        .join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("start", F.col("_before") + F.col("_end") - F.col("size"))
    )
    taken = sum(
        _served(1.0, F.col("start") + F.col("source_size") * p, F.col("size"), F.col("target")) for p in range(repeats)
    )
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    return plan.select(
        "doc_id", "source", "size", "source_size", "target", "start", finish.alias("virtual_finish"), taken.cast("long").alias("taken")
    ).repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def op6_fair_mix(spark, sf_dir):
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (
             ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (
             ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), l AS (SELECT min(level) AS level FROM (SELECT level FROM f WHERE level * weight <= 2 * source_size
         ORDER BY source_size / weight, source NULLS LAST LIMIT 1)
), t AS (
  SELECT source, source_size,
         round(CAST(least(coalesce(l.level * weight, 2.0 * source_size), 2.0 * source_size) AS DOUBLE), 6) AS target
  FROM f, l
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(
         greatest(0, least(size, floor(target + 0.5) - a))
       + greatest(0, least(size, floor(target + 0.5) - a - source_size)) AS BIGINT) AS taken
FROM q
"""
