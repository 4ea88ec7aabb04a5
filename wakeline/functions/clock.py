"""Epoch arithmetic on naive UTC timestamps.

TIMESTAMP_NTZ is read through the session zone here, so sessions run in UTC
(`prepare_session` is called by every job).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def prepare_session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros_of(later) - micros_of(earlier)) / F.lit(1e6)
