"""Day-by-day ingest: each day is cleaned once, and days already done are skipped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def days_between(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


def dataset_label(region: str, tag: str | None) -> str:
    return f"{region}_{tag}" if tag else region


def _state(days_dir: str) -> str:
    return f"{days_dir.rstrip('/')}_processed"


def processed_days(spark: SparkSession, days_dir: str) -> set[dt.date]:
    """Days recorded as done; one short text per run of the ingest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_state(days_dir))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    rows = spark.read.schema("day date").csv(_state(days_dir)).distinct().collect()
    return {r["day"] for r in rows}


def ingest_days(spark: SparkSession, days_dir: str, start: dt.date, end: dt.date, points_of_days) -> list[dt.date]:
    """Write the points of all days of a range that are not done, in one job; returns those days.

    points_of_days(days) gives the clean points of the files of the listed days, with a
    column `file_day`: the day of the FILE that a report came in. Folders are by file
    day, the unit in which days are recorded as done, so a report of another day in a
    file never replaces that day's folder. Folders are replaced as a whole and days are
    recorded after the write, so a run that failed half-way is simply repeated. File
    sizes within a day are left to adaptive execution, which splits busy days.
    """
    done = processed_days(spark, days_dir)
    wanted = [d for d in days_between(start, end) if d not in done]
    if not wanted:
        return []
    points = points_of_days(wanted)
    if "file_day" not in points.columns:
        raise ValueError("points_of_days must return a file_day column")
    (
        points.hint("rebalance", F.col("file_day"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_day")
        .parquet(days_dir)
    )
    spark.createDataFrame([(d,) for d in wanted], "day date").coalesce(1).write.mode("append").csv(_state(days_dir))
    return wanted


def points_of_file_days(spark: SparkSession, days_dir: str, days: list[dt.date]) -> DataFrame:
    """The points of the files of some days, copies included; other folders are not read."""
    return spark.read.parquet(days_dir).filter(F.col("file_day").isin(days)).drop("file_day")


def read_days(spark: SparkSession, days_dir: str) -> DataFrame:
    """All cleaned days as one table of points; a report that several files hold is one row."""
    from wakeline.operators.clean import deduplicate

    return deduplicate(spark.read.parquet(days_dir).drop("file_day"))
