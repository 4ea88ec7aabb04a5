"""Motion features between consecutive reports, and segmentation into trajectories.

Ordered work on a vessel is split by (mmsi, time chunk). Each chunk is summarised
in one row (first report, last report, breaks inside), the summaries of a vessel
are chained in time order, and each chunk receives the report before it and the
number of breaks before it. A vessel with any share of all rows is thus spread
over many tasks; after de-duplication one chunk of a day has at most 86 400
one-second reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.constants import (
    MAX_GAP_HOURS,
    MAX_SPEED_KMH,
    MIN_DISTANCE_KM,
    MIN_POINTS,
    MIN_SEGMENT_HOURS,
)
from wakeline.functions.clock import micros_of, seconds_between
from wakeline.functions.geo import haversine_km, turn_deg

ORDER = ("timestamp", "lat", "lon", "sog", "cog")
KEY = ("mmsi", "_chunk")


@dataclass(frozen=True)
class SegmentConfig:
    max_gap_hours: float = MAX_GAP_HOURS
    max_speed_kmh: float = MAX_SPEED_KMH
    min_points: int = MIN_POINTS
    min_hours: float = MIN_SEGMENT_HOURS
    min_distance_km: float = MIN_DISTANCE_KM
    chunk_hours: int = 24


def _step(cur: str, prev: str) -> Column:
    """Time, distance and implied speed from one report (a struct column) to the next."""
    c, p = F.col(cur), F.col(prev)
    dt = seconds_between(c["timestamp"], p["timestamp"])
    return F.struct(dt.alias("dt"), haversine_km(p["lat"], p["lon"], c["lat"], c["lon"]).alias("dist"))


def _speed(step: str) -> Column:
    return F.try_divide(F.col(step)["dist"], F.col(step)["dt"] / F.lit(3600.0))


def _usable(step: str, cfg: SegmentConfig) -> Column:
    """Whether a step has positive time and a possible speed; missing counts as unusable."""
    return F.coalesce((F.col(step)["dt"] > 0) & (_speed(step) <= cfg.max_speed_kmh), F.lit(False))


def _starts_segment(step: str, usable: Column, cfg: SegmentConfig) -> Column:
    fine = usable & (F.col(step)["dt"] / F.lit(3600.0) <= cfg.max_gap_hours)
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(0)).otherwise(F.lit(1))


def _chunk_rows(points: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Reports with the step inside their chunk and the number of breaks so far in it.

    The explicit filter makes every reader of this frame ask for the same shuffle.
    """
    report = F.struct(*ORDER)
    in_chunk = Window.partitionBy(*KEY).orderBy(*ORDER)
    return (
        points.withColumn("_chunk", chunk_of(cfg))
        .filter(F.col("mmsi").isNotNull() & F.col("_chunk").isNotNull())
        .repartition(*KEY)
        .withColumn("_cur", report)
        .withColumn("_prev", F.lag("_cur").over(in_chunk))
        .withColumn("_in", F.when(F.col("_prev").isNotNull(), _step("_cur", "_prev")))
        .withColumn("_ok", _usable("_in", cfg))
        .withColumn(
            "_new",
            F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(_starts_segment("_in", F.col("_ok"), cfg)),
        )
        .withColumn("_local", F.sum("_new").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _summarise_chunks(rows: DataFrame, points: DataFrame) -> DataFrame:
    """One row per chunk: its first and last report, its breaks, and the usable rows per local segment in `_parts`.

    The last report is kept whole so that this branch reads the same shuffle as the rows themselves.
    """
    whole = F.struct(*ORDER, *[c for c in points.columns if c not in ORDER])
    usable = lambda c: F.when(F.col("_ok"), c)
    per_segment = rows.groupBy(*KEY, "_local").agg(
        F.min("_cur").alias("_head"),
        F.max(whole).alias("_tail"),
        F.struct(
            F.sum(F.col("_ok").cast("int")).alias("n"),
            F.sum(usable(F.col("_in.dist"))).alias("dist"),
            F.min(usable(F.col("timestamp"))).alias("t0"),
            F.max(usable(F.col("timestamp"))).alias("t1"),
        ).alias("_sum"),
    )
    return per_segment.groupBy(*KEY).agg(
        F.min("_head").alias("_head"),
        F.max("_tail").alias("_tail"),
        F.max("_local").alias("_inside"),
        F.collect_list(F.struct("_local", "_sum")).alias("_parts"),
    )


def _chain_chunks(chunks: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Adds the report before each chunk, the step across the border and the breaks before it."""
    over_time = Window.partitionBy("mmsi").orderBy("_chunk")
    upto = over_time.rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunks.withColumn("_before", F.lag("_tail").over(over_time))
        .withColumn("_before", F.when(F.col("_before").isNotNull(), F.struct(*[F.col("_before")[c].alias(c) for c in ORDER])))
        .withColumn("_hin", F.when(F.col("_before").isNotNull(), _step("_head", "_before")))
        .withColumn("_hok", _usable("_hin", cfg))
        .withColumn("_hnew", _starts_segment("_hin", F.col("_hok"), cfg))
        .withColumn("_base", F.sum(F.col("_inside") + F.col("_hnew")).over(upto) - F.col("_inside"))
    )


def _long_segments_by_chunk(chunks: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Chunks with `_keep`: their local segments whose whole trajectory is long enough."""
    parts = chunks.select(
        *KEY, "_head", "_before", "_hin", "_hok", "_hnew", "_base", F.inline("_parts")
    ).withColumn("_is_head", (F.col("_local") == 0) & F.col("_hok"))
    head = lambda c: F.when(F.col("_is_head"), c)
    seg = Window.partitionBy("mmsi", "_segment")
    first = F.min(F.least("_sum.t0", head(F.col("_head.timestamp")))).over(seg)
    last = F.max(F.greatest("_sum.t1", head(F.col("_head.timestamp")))).over(seg)
    sized = (
        parts.withColumn("_segment", F.col("_base") + F.col("_local"))
        .withColumn("n_points", F.sum(F.col("_sum.n") + F.col("_is_head").cast("int")).over(seg))
        .withColumn(
            "total_distance_km",
            F.sum(F.coalesce("_sum.dist", F.lit(0.0)) + F.coalesce(head(F.col("_hin.dist")), F.lit(0.0))).over(seg),
        )
        .withColumn("duration_hours", seconds_between(last, first) / F.lit(3600.0))
    )
    border = ("_before", "_hin", "_hok", "_hnew", "_base")
    return (
        sized.groupBy(*KEY)
        .agg(*[F.first(c).alias(c) for c in border], F.collect_list(F.when(long_enough(cfg), F.col("_local"))).alias("_keep"))
        .filter(F.size("_keep") > 0)
    )


def _resolve(joined: DataFrame, points: DataFrame) -> DataFrame:
    """Previous report, step, break flag and segment number of rows joined with their chunk."""
    border = F.col("_prev").isNull()
    step = F.coalesce("_in", "_hin")
    prev = F.coalesce("_prev", "_before")
    return joined.withColumn("_p", prev).withColumn("_s", step).select(
        *points.columns,
        *[F.col("_p")[c].alias(f"prev_{c}") for c in ORDER],
        F.col("_s.dt").alias("dt_sec"),
        F.col("_s.dist").alias("dist_km"),
        F.when(border, F.col("_hnew")).otherwise(F.col("_new")).alias("new_segment"),
        (F.col("_base") + F.col("_local")).cast("bigint").alias("segment_id"),
    )


def _with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "traj_id", F.concat_ws("_", F.col("mmsi").cast("string"), F.col("segment_id").cast("string"))
    )


def segment_points(points: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """All motion features, break flags, segment numbers and trajectory ids, no row dropped."""
    rows = _chunk_rows(points, cfg)
    chunks = _chain_chunks(_summarise_chunks(rows, points), cfg).select(*KEY, "_before", "_hin", "_hnew", "_base")
    return _with_ids(add_motion_features(_resolve(rows.join(chunks, list(KEY)), points)))


def build_segments(points: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Points to the usable rows of trajectories worth keeping, in one wide shuffle.

    Which trajectories are long enough is decided on the chunk table, so the rows
    are joined once, with the few rows of that table. The result equals
    keep_long_segments(drop_invalid_steps(segment_points(points))).
    """
    rows = _chunk_rows(points, cfg)
    chunks = _long_segments_by_chunk(_chain_chunks(_summarise_chunks(rows, points), cfg), cfg)
    return _kept_rows(rows, chunks, points)


def chunk_of(cfg: SegmentConfig) -> Column:
    """Number of the time chunk of a report."""
    return F.floor(micros_of(F.col("timestamp")) / F.lit(cfg.chunk_hours * 3_600_000_000))


def chunk_summaries(points: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """One row per vessel and chunk that later chunks can be chained to without reading its reports again."""
    return _summarise_chunks(_chunk_rows(points, cfg), points)


def chain_summaries(summaries: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """What each chunk with a long trajectory needs from the chunks around it; all chunks of a vessel at once."""
    return _long_segments_by_chunk(_chain_chunks(summaries, cfg), cfg).withColumn("_keep", F.array_sort("_keep"))


def segments_of_chunks(points: DataFrame, chain: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """The rows of build_segments that lie in the chunks of `points`, given their rows of the chain."""
    return _kept_rows(_chunk_rows(points, cfg), chain, points)


def _kept_rows(rows: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    border = F.col("_prev").isNull()
    wanted = rows.join(chunks, list(KEY)).filter(
        F.when(border, F.col("_hok")).otherwise(F.col("_ok")) & F.array_contains("_keep", F.col("_local"))
    )
    return _with_ids(add_motion_features(_resolve(wanted, points)))


def add_motion_features(df: DataFrame) -> DataFrame:
    """Per-row features from a report, the one before it (prev_*) and the step between (dt_sec, dist_km)."""
    course = F.radians(F.col("cog"))
    out = df.withColumns(
        {
            "dt_hours": F.col("dt_sec") / F.lit(3600.0),
            "speed_between_kmh": F.try_divide(F.col("dist_km"), F.col("dt_sec") / F.lit(3600.0)),
            "dlat": F.col("lat") - F.col("prev_lat"),
            "dlon": F.col("lon") - F.col("prev_lon"),
            "dsog": F.col("sog") - F.col("prev_sog"),
            "dcog": turn_deg(F.col("cog"), F.col("prev_cog")),
            "cog_sin": F.sin(course),
            "cog_cos": F.cos(course),
            "v_north_kmh": F.col("sog") * F.cos(course),
            "v_east_kmh": F.col("sog") * F.sin(course),
            "heading_missing": F.col("heading").isNull().cast("int"),
            "heading": F.coalesce("heading", "cog"),
        }
    )
    return out.withColumns(
        {"heading_sin": F.sin(F.radians("heading")), "heading_cos": F.cos(F.radians("heading"))}
    )


def drop_invalid_steps(segmented: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Remove rows without a usable step; a step after a time gap is kept."""
    return segmented.filter(
        (F.col("dt_sec") > 0) & F.col("speed_between_kmh").isNotNull() & (F.col("speed_between_kmh") <= cfg.max_speed_kmh)
    )


def trajectory_stats(segments: DataFrame) -> DataFrame:
    """One row per trajectory.

    The exact median needs one counter per distinct step length; inside a
    trajectory a step is a whole number of seconds no longer than the span, so
    the buffer stays small however many rows the trajectory has.
    """
    return (
        segments.groupBy("traj_id", "mmsi")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.avg("sog").alias("mean_sog"),
            F.percentile("dt_sec", 0.5).alias("median_dt_sec"),
            F.sum("dist_km").alias("total_distance_km"),
        )
        .withColumn("duration_hours", seconds_between(F.col("end_time"), F.col("start_time")) / F.lit(3600.0))
    )


def long_enough(cfg: SegmentConfig) -> Column:
    return (
        (F.col("n_points") >= cfg.min_points)
        & (F.col("duration_hours") >= cfg.min_hours)
        & (F.col("total_distance_km") >= cfg.min_distance_km)
    )


def keep_long_segments(segments: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> tuple[DataFrame, DataFrame]:
    """Rows of trajectories that are long enough, and the statistics of those trajectories."""
    brief = (
        segments.groupBy("traj_id", "mmsi")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.sum("dist_km").alias("total_distance_km"),
            (seconds_between(F.max("timestamp"), F.min("timestamp")) / F.lit(3600.0)).alias("duration_hours"),
        )
        .filter(long_enough(cfg))
        .select("traj_id", "mmsi")
    )
    kept = segments.join(brief, ["traj_id", "mmsi"], "left_semi")
    return kept, trajectory_stats(kept)
