"""Trajectories on a regular time grid.

Only non-empty bins are stored. A gap is filled by expanding the bin before it, so
the complete grid with its empty bins never exists. After binning, a trajectory
has at most one row per bin of its time span, whatever its raw row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wakeline.constants import FEATURES, MAX_GAP_STEPS
from wakeline.functions.clock import micros_of

KEYS = ("mmsi", "traj_id")


def check_minutes(every_minutes: int) -> None:
    if every_minutes <= 0 or 1440 % every_minutes:
        raise ValueError("The grid step must divide a day (1440 minutes)")


def dedupe_timestamps(segments: DataFrame) -> DataFrame:
    """One row per trajectory and timestamp, the smallest in column order."""
    keys = ("traj_id", "timestamp")
    rest = [c for c in segments.columns if c not in keys]
    return segments.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}") for c in segments.columns]
    )


def bin_means(segments: DataFrame, every_minutes: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean of every feature per grid bin, with what is needed to label metadata.

    Averages combine on the map side before the shuffle.
    """
    check_minutes(every_minutes)
    step_us = every_minutes * 60_000_000
    micros = micros_of(F.col("timestamp"))
    binned = segments.withColumn("bin", F.floor(micros / F.lit(step_us)).cast("bigint"))
    at_label = F.pmod(micros, F.lit(step_us)) == 0
    meta = []
    if "vessel_type" in segments.columns:
        meta = [
            F.max_by("vessel_type", "timestamp").alias("_last_type"),
            F.max(F.when(at_label, F.col("vessel_type"))).alias("_label_type"),
        ]
    return binned.groupBy(*KEYS, "bin").agg(*[F.avg(f).alias(f) for f in features], *meta)


def fill_gaps(bins: DataFrame, every_minutes: int, limit: int = MAX_GAP_STEPS, features: Sequence[str] = FEATURES) -> DataFrame:
    """Linear fill of empty bins at most `limit` away from a non-empty one, on either side.

    Bins farther from both neighbours stay out of the result. Metadata take the
    value of the last raw row at or before the bin label, then of the next label.
    """
    ordered = Window.partitionBy(*KEYS).orderBy("bin")
    cells = F.struct("bin", *features)
    have_type = "_last_type" in bins.columns
    out = bins.withColumn("_next", F.lead(cells).over(ordered))
    if have_type:
        out = out.withColumn(
            "_type", F.coalesce(F.col("_label_type"), F.lag("_last_type").over(ordered))
        )
        # Read backwards: a frame that ends at the last row would be re-read for every row.
        backwards = Window.partitionBy(*KEYS).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_later_type", F.last("_type", ignorenulls=True).over(backwards))
        next_label = F.col("_later_type")
        close = F.when(
            F.col("_next.bin") == F.col("bin") + 1, F.coalesce(F.lead("_type").over(ordered), F.col("_last_type"))
        ).otherwise(F.col("_last_type"))
        out = out.withColumn("_fill_type", F.coalesce(F.col("_last_type"), next_label)).withColumn(
            "_type",
            F.coalesce(F.col("_type"), F.when(F.col("_next").isNotNull(), F.coalesce(close, next_label))),
        )
    gap = F.coalesce(F.col("_next.bin") - F.col("bin"), F.lit(1))
    near_left = F.least(gap - 1, F.lit(limit))
    right_from = F.greatest(near_left + 1, gap - F.lit(limit))
    steps = F.concat(
        F.sequence(F.lit(0).cast("bigint"), near_left.cast("bigint")),
        F.when(right_from <= gap - 1, F.sequence(right_from.cast("bigint"), (gap - 1).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    out = out.withColumn("_gap", gap).withColumn("_k", F.explode(steps))
    frac = F.col("_k") / F.col("_gap")
    filled = [
        F.when(F.col("_k") == 0, F.col(f))
        .otherwise(F.col(f) + (F.col(f"_next.{f}") - F.col(f)) * frac)
        .alias(f)
        for f in features
    ]
    meta = [F.when(F.col("_k") == 0, F.col("_type")).otherwise(F.col("_fill_type")).alias("vessel_type")] if have_type else []
    step_us = every_minutes * 60_000_000
    label = F.timestamp_micros((F.col("bin") + F.col("_k")) * F.lit(step_us))
    return out.select(*KEYS, (F.col("bin") + F.col("_k")).alias("bin"), label.cast("timestamp_ntz").alias("timestamp"), *filled, *meta)


def drop_without_position(grid: DataFrame) -> DataFrame:
    return grid.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def resample(
    segments: DataFrame,
    every_minutes: int = 10,
    limit: int = MAX_GAP_STEPS,
    *,
    dedupe: bool = False,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Segments to grid rows. De-duplication is needed only for foreign segment files."""
    rows = dedupe_timestamps(segments) if dedupe else segments
    return drop_without_position(fill_gaps(bin_means(rows, every_minutes, features), every_minutes, limit, features))
