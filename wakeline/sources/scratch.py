"""Shared folder for tables that several passes read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only for a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"Set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wakeline-{name}-{uuid.uuid4().hex}"


#: For tables of windows: a window repeats the steps of the one before it, which compress to a fraction of their size
#: as they are, and hardly at all as indexes of a dictionary.
OVERLAPPING = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, name: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """Write a table once and read it back, so later passes do not recompute its plan.

    Multi-pass operators also need this to see the same rows in each pass when an
    executor is lost. Only slim tables (keys, flags, metrics) are written this way.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
