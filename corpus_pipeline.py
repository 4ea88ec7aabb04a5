"""From documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of their input. Ids may be null or repeated, so the stages that drop rows number them once, write them
with their numbers, and decide by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontamination, line_dedup, mixing, near_dedup, quality_model
from wakeline.llm.common import table
from wakeline.sources.scratch import materialize


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number in `_pipeline_row`; written, so that all passes see the same numbers."""
    return materialize(docs.withColumn("_pipeline_row", F.monotonically_increasing_id()), "numbered-rows")


def _as_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the number of the row as its id."""
    return rows.select(F.col("_pipeline_row").alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    numbers = gone.select(F.col("doc_id").alias("_pipeline_row"))
    return rows.join(numbers, "_pipeline_row", "left_anti").drop("_pipeline_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    scored = quality_model.score_quality(docs, table(spark, sf_dir, "labels"), "_quality_score")
    return scored.where("_quality_score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; text and n_chars change where lines were dropped."""
    found = line_dedup.drop_lines(docs, into="_line_result")
    changed = F.col("_line_result.n_dropped") > 0
    new = {"text": F.col("_line_result.text"), "n_chars": F.length("_line_result.text").cast("long")}
    return found.select(*(F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, one with the smallest doc_id. Rows without words are classes of their own."""
    rows = _numbered(docs)
    found = near_dedup.near_duplicates(_as_documents(rows)).select(F.col("doc_id").alias("_pipeline_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_pipeline_row"))["_pipeline_row"]
    stay = found.join(rows.select("_pipeline_row", "doc_id"), "_pipeline_row").groupBy("class_id").agg(first.alias("_pipeline_row"))
    gone = found.join(stay, "_pipeline_row", "left_anti")
    return _without(rows, gone.select(F.col("_pipeline_row").alias("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    rows = _numbered(docs)
    found = decontamination.find_contamination(_as_documents(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in the order of the mix; taken is 0 for what it leaves out."""
    return mixing.fair_mix(docs).select("doc_id", "source", "size", "source_size", "target", "virtual_finish", "taken")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: The classifier and Order MinHash have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
