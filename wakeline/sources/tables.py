"""Parquet, CSV, JSON and summary readers and writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.operators.clean import flag_in_frame


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the wanted columns that the file has; the scan reads nothing else."""
    files = spark.read.parquet(path)
    return files.select(*[c for c in columns if c in files.columns])


def read_keys(spark: SparkSession, path: str, column: str, keys: Sequence) -> DataFrame:
    """Rows whose key is in a short list, pushed to the scan."""
    return spark.read.parquet(path).filter(F.col(column).isin(*keys))


def read_matching(spark: SparkSession, path: str, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in a table of keys of any size; Spark chooses the join."""
    return spark.read.parquet(path).join(keys.select(column).distinct(), column, "left_semi")


def write_table(df: DataFrame, path: str, *, compression: str = "snappy", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet with the schema of the frame, whichever batch comes first."""
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def write_by_key(df: DataFrame, path: str, key: str, *then: str, keys_per_group: int = 10_000, mode: str = "error") -> None:
    """Parquet laid out for reads by key: in ranges of (key, then), sorted, with a Bloom filter of the keys of each
    row group. A key with many rows is spread over ranges by the columns of `then`."""
    (
        df.repartitionByRange(key, *then)
        .sortWithinPartitions(key, *then)
        .write.mode(mode)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_group))
        .parquet(path)
    )


def read_by_keys(spark: SparkSession, path: str, key: str, keys: DataFrame, listed: int = 500) -> DataFrame:
    """Rows whose key is in a table of keys; row groups that cannot hold one are not read.

    Up to `listed` keys become a filter of the scan, which asks statistics, dictionary and Bloom filter of each row
    group for each key. A longer table, of which a row group is likely to hold a key, is joined; rows are the same.
    """
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in wanted.limit(listed + 1).collect()]
    if len(some) > listed:
        return read_matching(spark, path, key, wanted)
    # short lists: the scan turns a list of more than ten into a range
    lists = [F.col(key).isin(*some[i : i + 10]) for i in range(0, len(some), 10)]
    return spark.read.parquet(path).filter(reduce(Column.__or__, lists, F.lit(False)))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """A report of one or few rows as JSON."""
    df.write.mode(mode).json(path)


def tall_metrics(df: DataFrame, section: str = "") -> DataFrame:
    """One-row aggregates as (section, metric, value) text rows."""
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
        for c in df.columns
    ]
    return df.select(F.inline(F.array(*entries)))


def write_summary(parts: Sequence[DataFrame], path: str, mode: str = "error") -> DataFrame:
    """Summary of a run: several tall metric tables written as one small CSV."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return out


EXPORT_COLUMNS = (
    "coast", "region", "dataset_label", "mmsi", "traj_id", "timestamp", "lat", "lon", "sog", "vessel_type", "in_frame",
)


def export_points(segments: DataFrame, coast: str, region: str, label: str, bounds, *, strict: bool = False) -> DataFrame:
    """Points of a coast with labels and the frame flag, ready to write."""
    labelled = (
        flag_in_frame(segments, bounds, strict=strict)
        .withColumn("coast", F.lit(coast))
        .withColumn("region", F.lit(region))
        .withColumn("dataset_label", F.lit(label))
    )
    return labelled.select(*[c for c in EXPORT_COLUMNS if c in labelled.columns])
