"""Vessel reports derived from the `events` table, for checks on the given data.

Each user becomes a vessel on a circular course whose size depends on the user:
one in five stays within a kilometre, one in five makes small loops, the others
travel. Some rows get the defects that raw files have: unreadable or missing
values, out-of-range speed and course, absent heading, repeated reports and
jumps. The result has the string columns of a raw file.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.functions.clock import prepare_session
from wakeline.operators.clean import clean
from wakeline.operators.resample import resample
from wakeline.operators.segment import SegmentConfig, build_segments
from wakeline.operators.windows import build_windows
from wakeline.sources.scratch import OVERLAPPING, materialize

BOX = (33.0, 48.0, -76.0, -68.0)
SEGMENTS = SegmentConfig(max_gap_hours=24.0, max_speed_kmh=92.6, min_points=5, min_hours=36.0, min_distance_km=1.0)
STEP_MINUTES = 180
HISTORY_HOURS = 24.0
FUTURE_HOURS = 12.0
H, N = 8, 4  # steps of history and future


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/events.parquet")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String columns of a raw file, in which each 61st report is repeated with another position."""
    e = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    i, u = F.col("event_id"), F.col("user_id")
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    phase = F.lit(2 * math.pi) * F.unix_seconds(t) / F.lit(864000.0) + u
    size = F.when(u % 5 == 0, F.lit(0.009)).when(u % 5 == 1, F.lit(0.05)).otherwise(F.lit(3.0))
    lat = F.lit(37.0) + size * F.sin(phase) + F.when(i % 211 == 0, F.lit(10.0)).otherwise(F.lit(0.0))
    lon = F.lit(-72.0) + size * F.cos(phase)
    knots = F.when(u % 5 == 0, F.col("value") % 1).otherwise(F.col("value") % 40) * (F.lit(0.99) + F.lit(0.01) * F.sin(phase))
    course = F.when(u % 5 == 2, F.lit(45.0) + i % 4).otherwise(((i * 7) % 360).cast("double"))
    text = lambda c: c.cast("string")

    def report(latitude):
        return F.struct(
            F.when(i % 97 == 0, F.lit("n/a")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
            F.when(i % 83 == 0, F.lit("0")).otherwise(text(u)).alias("mmsi"),
            F.when(i % 89 == 0, F.lit("abc")).otherwise(text(latitude)).alias("lat"),
            text(lon).alias("lon"),
            F.when(i % 79 == 0, F.lit("")).when(i % 73 == 0, F.lit("103.5")).otherwise(text(knots)).alias("sog"),
            F.when(i % 71 == 0, F.lit("")).when(i % 67 == 0, F.lit("360.5")).otherwise(text(course)).alias("cog"),
            F.when(F.col("event_type") == "error", F.lit("511")).otherwise(text(course)).alias("heading"),
            F.when(i % 59 == 0, F.lit("")).otherwise(text(F.lit(30) + i % 60)).alias("vessel_type"),
        )

    copies = F.when(i % 61 == 0, F.array(report(lat), report(lat + F.lit(0.001)))).otherwise(F.array(report(lat)))
    return e.select(F.inline_outer(copies))


def points(spark: SparkSession, sf_dir: str, commercial_only: bool = False) -> DataFrame:
    return clean(raw_reports(spark, sf_dir), BOX, source="noaa", commercial_only=commercial_only)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_segments(points(spark, sf_dir), SEGMENTS)


def grid(spark: SparkSession, sf_dir: str, limit: int = 6) -> DataFrame:
    return resample(segments(spark, sf_dir), STEP_MINUTES, limit)


def windows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    limit = options.pop("limit", 6)
    return build_windows(
        grid(spark, sf_dir, limit),
        history_hours=HISTORY_HOURS,
        future_hours=FUTURE_HOURS,
        resample_minutes=STEP_MINUTES,
        **options,
    )


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build, options: dict[str, str] | None = None) -> DataFrame:
    """A table written once per application and input folder, as the jobs write theirs."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name, options)
    return _STORED[key]


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    return _stored(spark, sf_dir, "segments", lambda: segments(spark, sf_dir))


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    return _stored(
        spark,
        sf_dir,
        "windows",
        lambda: build_windows(
            resample(stored_segments(spark, sf_dir), STEP_MINUTES),
            history_hours=HISTORY_HOURS,
            future_hours=FUTURE_HOURS,
            resample_minutes=STEP_MINUTES,
        ),
        OVERLAPPING,
    )
