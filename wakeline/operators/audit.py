"""Coverage audits of segments and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.constants import AUDIT_QUANTILES
from wakeline.functions.clock import micros_of, seconds_between
from wakeline.functions.ranking import exact_percentiles, percentile_columns
from wakeline.functions.vessel import vessel_label
from wakeline.operators.clean import clip, flag_in_frame
from wakeline.operators.evaluate import histogram
from wakeline.operators.motion import SmartMotionConfig, fails_smart_motion
from wakeline.operators.windows import possible_windows
from wakeline.sources.scratch import materialize


def group_column(df: DataFrame) -> str:
    return "traj_id" if "traj_id" in df.columns else "mmsi"


def _hours(later: str, earlier: str) -> Column:
    return seconds_between(F.col(later), F.col(earlier)) / F.lit(3600.0)


def trajectory_audit(segments: DataFrame, history_hours: float, future_hours: float, resample_minutes: int) -> DataFrame:
    """Per trajectory (or vessel, without ids): coverage, step lengths, distance, windows it could give.

    Step lengths are whole seconds bounded by the span, so the exact percentile
    keeps few distinct counters per group.
    """
    g = group_column(segments)
    out = segments.groupBy(g).agg(
        *([F.first("mmsi").alias("mmsi")] if g != "mmsi" else []),
        F.count(F.lit(1)).alias("n_points"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.percentile("dt_sec", F.array(F.lit(0.5), F.lit(0.95))).alias("_dt"),
        F.avg("dt_sec").alias("mean_dt_sec"),
        F.sum("dist_km").alias("total_distance_km"),
        F.avg("sog").alias("mean_sog_kmh"),
    )
    if g == "mmsi":
        out = out.withColumn("traj_id", F.col("mmsi").cast("string"))
    return (
        out.withColumn("median_dt_sec", F.col("_dt")[0])
        .withColumn("p95_dt_sec", F.col("_dt")[1])
        .withColumn("duration_hours", _hours("end_time", "start_time"))
        .withColumn("duration_days", F.col("duration_hours") / 24.0)
        .withColumn("points_per_hour", F.try_divide("n_points", "duration_hours"))
        .withColumn("possible_windows", possible_windows(F.col("duration_hours"), history_hours, future_hours, resample_minutes))
        .drop("_dt")
    )


def vessel_audit(trajectories: DataFrame) -> DataFrame:
    return (
        trajectories.groupBy("mmsi")
        .agg(
            F.count(F.lit(1)).alias("n_segments"),
            F.sum("n_points").alias("total_points"),
            F.sum("duration_hours").alias("total_observed_hours"),
            F.max("duration_hours").alias("longest_segment_hours"),
            F.min("start_time").alias("first_seen"),
            F.max("end_time").alias("last_seen"),
            F.sum("possible_windows").alias("total_possible_windows"),
            F.sum("total_distance_km").alias("total_distance_km"),
        )
        .withColumn("calendar_span_hours", _hours("last_seen", "first_seen"))
    )


def windows_by_trajectory(windows: DataFrame) -> DataFrame:
    return windows.groupBy("traj_id").agg(
        F.first("mmsi").alias("mmsi"),
        F.count(F.lit(1)).alias("n_windows"),
        F.min("start_time").alias("first_window_start"),
        F.max("target_end_time").alias("last_window_end"),
    )


def windows_by_vessel(by_trajectory: DataFrame) -> DataFrame:
    return by_trajectory.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_traj_with_windows"), F.sum("n_windows").alias("n_windows")
    )


def quantile_summary(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = AUDIT_QUANTILES) -> DataFrame:
    return exact_percentiles(df, columns, probs)


def coverage_totals(trajectories: DataFrame) -> DataFrame:
    return trajectories.agg(
        F.sum("n_points").alias("rows"),
        F.countDistinct("mmsi").alias("vessels"),
        F.count(F.lit(1)).alias("trajectories"),
        F.min("start_time").alias("first_time"),
        F.max("end_time").alias("last_time"),
        F.sum("possible_windows").alias("possible_windows"),
        F.sum((F.col("possible_windows") > 0).cast("int")).alias("trajectories_with_windows"),
    )


def top_rows(df: DataFrame, value: str, tie: Sequence[str], n: int = 20) -> DataFrame:
    """The n largest; Spark keeps n rows per task and merges them."""
    return df.orderBy(F.col(value).desc(), *tie).limit(n)


def frame_stats(segments: DataFrame, bounds: tuple[float, float, float, float], *, strict: bool = False, chunk_hours: int = 24) -> DataFrame:
    """Per trajectory: points and hours inside a box against its whole duration.

    The step before each row is found within (trajectory, time chunk); the first
    row of a chunk takes the last time of the chunk before from a chained summary.
    """
    flagged = flag_in_frame(segments, bounds, strict=strict)
    chunk = F.floor(micros_of(F.col("timestamp")) / F.lit(chunk_hours * 3_600_000_000))
    spread = flagged.withColumn("_chunk", chunk).repartition("traj_id", "_chunk")
    inside = Window.partitionBy("traj_id", "_chunk").orderBy("timestamp")
    local = spread.withColumn("_prev", F.lag("timestamp").over(inside))
    step = seconds_between(F.col("timestamp"), F.col("_prev"))
    hours_in = F.sum(F.when(F.col("in_frame") & (step > 0), step).otherwise(0.0))
    chunks = local.groupBy("traj_id", "_chunk").agg(
        F.first("mmsi").alias("mmsi"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("in_frame").cast("int")).alias("n_in"),
        F.min("timestamp").alias("t0"),
        F.max("timestamp").alias("t1"),
        hours_in.alias("sec_in"),
        F.min_by("in_frame", "timestamp").alias("first_in"),
        F.sum("dist_km").alias("dist"),
        F.sum("sog").alias("sog_sum"),
    )
    order = Window.partitionBy("traj_id").orderBy("_chunk")
    bridge = seconds_between(F.col("t0"), F.lag("t1").over(order))
    chained = chunks.withColumn("_bridge", F.when(F.col("first_in") & (bridge > 0), bridge).otherwise(0.0))
    return (
        chained.groupBy("traj_id")
        .agg(
            F.first("mmsi").alias("mmsi"),
            F.sum("n").alias("n_points"),
            F.sum("n_in").alias("n_in_frame"),
            F.min("t0").alias("start_time"),
            F.max("t1").alias("end_time"),
            (F.sum(F.col("sec_in") + F.col("_bridge")) / 3600.0).alias("in_frame_hours"),
            F.sum("dist").alias("total_distance_km"),
            (F.sum("sog_sum") / F.sum("n")).alias("mean_sog_kmh"),
        )
        .withColumn("duration_hours", _hours("end_time", "start_time"))
        .withColumn("pct_points_in_frame", F.try_divide("n_in_frame", "n_points"))
        .withColumn("pct_time_in_frame", F.try_divide("in_frame_hours", "duration_hours"))
        .withColumn("n_out_of_frame", F.col("n_points") - F.col("n_in_frame"))
    )


def vessel_frame_hours(stats: DataFrame, by: Sequence[str] = ("mmsi",)) -> DataFrame:
    return (
        stats.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_segments"),
            F.max("in_frame_hours").alias("longest_in_frame_hours"),
            F.max("duration_hours").alias("longest_duration_hours"),
            F.sum("in_frame_hours").alias("total_in_frame_hours"),
            F.sum("duration_hours").alias("total_duration_hours"),
            F.min("pct_points_in_frame").alias("min_pct_points_in_frame"),
            F.avg("pct_points_in_frame").alias("mean_pct_points_in_frame"),
            F.sum("n_out_of_frame").alias("n_out_of_frame_points"),
        )
        .withColumn("fully_in_frame", F.col("min_pct_points_in_frame") >= 1.0)
    )


def coast_export(coasts: dict[str, tuple[DataFrame, str, str, tuple[float, float, float, float]]], *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trajectory and vessel tables of several coasts, labelled and united.

    coasts: name -> (segments, region, dataset label, box).
    """
    trajectories = None
    for name, (segments, region, label, box) in coasts.items():
        stats = frame_stats(segments, box, strict=strict).select(
            F.lit(name).alias("coast"), F.lit(region).alias("region"), F.lit(label).alias("dataset_label"), "*"
        )
        trajectories = stats if trajectories is None else trajectories.unionByName(stats)
    return trajectories, vessel_frame_hours(trajectories, ("coast", "region", "dataset_label", "mmsi"))


def coast_counts(trajectories: DataFrame, vessels: DataFrame) -> DataFrame:
    """Per coast: trajectories, points outside the frame, and vessels with any such point."""
    t = trajectories.groupBy("coast").agg(
        F.count(F.lit(1)).alias("trajectories"), F.sum("n_out_of_frame").alias("out_of_frame_points")
    )
    v = vessels.groupBy("coast").agg(
        F.count(F.lit(1)).alias("vessels"),
        F.sum((~F.col("fully_in_frame")).cast("int")).alias("vessels_with_out_of_frame"),
    )
    return t.join(F.broadcast(v), "coast")


def mask_audit(flagged: DataFrame, columns: Sequence[str], mask: str = "removed") -> DataFrame:
    """Size, share and medians of removed against kept windows."""
    slim = materialize(flagged.select(mask, *columns), "mask")
    counts = slim.groupBy(mask).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
    return counts.join(F.broadcast(percentile_columns(slim, columns, {"median": 0.5}, (mask,), stored=True)), mask)


def smart_filter_audit(measured: DataFrame, cfg: SmartMotionConfig = SmartMotionConfig()) -> DataFrame:
    """Kept share of the pool, and future motion of what is kept."""
    flagged = materialize(
        measured.select(
            fails_smart_motion(cfg).alias("removed"), "future_8h_net_km", "future_12h_net_km", "arrived_then_stopped"
        ),
        "smart",
    )
    kept = flagged.filter(~F.col("removed"))
    share = flagged.agg(F.count(F.lit(1)).alias("n_pool"), F.avg((~F.col("removed")).cast("int")).alias("keep_fraction"))
    motion = kept.agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.avg((F.col("future_8h_net_km") >= cfg.audit_future_8h_km).cast("int")).alias("future_8h_moves"),
        F.avg((F.col("future_12h_net_km") >= cfg.audit_future_12h_km).cast("int")).alias("future_12h_moves"),
        F.avg(F.col("arrived_then_stopped").cast("int")).alias("arrived_then_stopped"),
    )
    med = percentile_columns(kept, ["future_8h_net_km", "future_12h_net_km"], {"median": 0.5}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(share).join(F.broadcast(one(motion)), "_k").join(F.broadcast(one(med)), "_k").drop("_k")


def smart_audit_rows(measured: DataFrame, n: int, keys: Sequence[str], cfg: SmartMotionConfig = SmartMotionConfig(), seed: int = 42) -> DataFrame:
    """Kept windows in seeded order up to n, filled with rejected ones, with future-motion checks."""
    from wakeline.functions.ranking import hash_cut, seeded_hash

    flagged = measured.withColumn("smart_keep", ~fails_smart_motion(cfg))
    hashes = materialize(flagged.select(seeded_hash(seed, *keys).alias("_h"), "smart_keep"), "smartrows")
    kept = hashes.filter("smart_keep").select("_h")
    n_kept = kept.agg(F.count(F.lit(1))).scalar()
    h = seeded_hash(seed, *keys)
    fill = hash_cut(hashes.filter("NOT smart_keep").select("_h"), F.lit(n) - n_kept)
    rows = flagged.filter(
        (F.col("smart_keep") & (h <= hash_cut(kept, n))) | (~F.col("smart_keep") & (h <= fill))
    )
    return rows.withColumn("future_8h_moves", F.col("future_8h_net_km") >= cfg.audit_future_8h_km).withColumn(
        "future_12h_moves", F.col("future_12h_net_km") >= cfg.audit_future_12h_km
    )


def span_and_days(points: DataFrame) -> DataFrame:
    return points.agg(
        _hours_between_extremes().alias("span_hours"), F.countDistinct(F.to_date("timestamp")).alias("n_days")
    )


def _hours_between_extremes() -> Column:
    return seconds_between(F.max("timestamp"), F.min("timestamp")) / F.lit(3600.0)


def tracking_hours(vessels: DataFrame, span_hours: float | None = None) -> DataFrame:
    """Longest in-frame hours per vessel, limited to the data span."""
    v = clip(F.col("longest_in_frame_hours"), 0.0, span_hours)
    return vessels.filter(F.col("longest_in_frame_hours").isNotNull()).select("mmsi", v.alias("hours"))


def tracking_summary(hours: DataFrame) -> DataFrame:
    slim = materialize(hours.select("hours"), "hours")
    base = slim.agg(F.count(F.lit(1)).alias("vessels"), F.avg("hours").alias("mean_hours"), F.max("hours").alias("max_hours"))
    q = percentile_columns(slim, ["hours"], {"median": 0.5, "p90": 0.9, "p99_5": 0.995}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(base).join(F.broadcast(one(q)), "_k").drop("_k")


def speed_distribution(points: DataFrame, stationary_below: float = 0.5 * 1.852, cruising_from: float = 5.0 * 1.852, cap: float = 30.0 * 1.852) -> DataFrame:
    """Mean, median and shares of stationary and cruising reports (speeds stored in km/h)."""
    slim = materialize(points.select(clip(F.col("sog"), 0.0, cap).alias("sog")), "speed")
    base = slim.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("sog").alias("mean_sog"),
        F.avg((F.col("sog") < stationary_below).cast("int")).alias("stationary_share"),
        F.avg((F.col("sog") >= cruising_from).cast("int")).alias("cruising_share"),
    )
    q = percentile_columns(slim, ["sog"], {"median": 0.5}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(base).join(F.broadcast(one(q)), "_k").drop("_k")


def vessel_type_counts(points: DataFrame, n: int = 10) -> DataFrame:
    labelled = points.select(vessel_label(F.col("vessel_type").cast("string")).alias("label"))
    return top_rows(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "n", ["label"], n)


def dataset_summary(segments: DataFrame) -> DataFrame:
    g = group_column(segments)
    return segments.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(g).alias("routes"),
        F.countDistinct("mmsi").alias("vessels"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def stage_report(flagged: DataFrame, keep: str, metrics: Sequence[str], stage: str) -> DataFrame:
    """Rows in and out of a filter stage, with median and p90 of metrics over the kept rows."""
    slim = materialize(flagged.select(keep, *metrics), "stage")
    counts = slim.agg(
        F.count(F.lit(1)).alias("rows_in"), F.coalesce(F.sum(F.col(keep).cast("int")), F.lit(0)).alias("rows_out")
    )
    q = percentile_columns(slim.filter(F.col(keep)), metrics, {"median": 0.5, "p90": 0.9}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return (
        one(counts)
        .join(F.broadcast(one(q)), "_k")
        .drop("_k")
        .withColumn("stage", F.lit(stage))
        .withColumn("kept_fraction", F.col("rows_out") / F.greatest("rows_in", F.lit(1)))
    )


def fixed_histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Histogram over a given range, or the range of the finite values."""
    v = F.col(value).cast("double")
    finite = df.select(v.alias(value)).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    if low is None or high is None:
        ext = finite.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        low = ext["lo"] if low is None else low
        high = ext["hi"] if high is None else high
    return histogram(finite, value, float(low), float(high), bins)
