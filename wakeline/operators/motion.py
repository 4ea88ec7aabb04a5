"""Motion metrics, masks, buckets and shape of windows, one projection each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.constants import CHORD_KM_PER_DEG
from wakeline.functions.geo import haversine_km, initial_bearing_deg, turn_deg
from wakeline.functions.ranking import percentile_columns
from wakeline.functions.series import consecutive, largest, mean, path_km, std_pop, total
from wakeline.operators.windows import anchor, as_points, steps_for
from wakeline.sources.scratch import materialize


@dataclass(frozen=True)
class StationaryConfig:
    """A window is stationary when it stays in a small cell and hardly moves.

    The slow-speed clause of the published rule only repeats the two main clauses,
    so it changes nothing and is left out.
    """

    history_only: bool = True
    max_radius_km: float = 0.5
    min_displacement_km: float = 1.0
    require_displacement_km: float = 0.0
    require_path_km: float = 0.0
    max_loop_ratio: float | None = None
    min_loop_path_km: float = 10.0


@dataclass(frozen=True)
class SmartMotionConfig:
    """A window must still be moving near its anchor and not circle in a small area."""

    min_16h_net_km: float = 8.0
    min_last_8h_net_km: float = 2.0
    max_loop_ratio: float = 0.35
    min_loop_path_km: float = 10.0
    big_loop_path_km: float = 50.0
    big_loop_radius_km: float = 20.0
    audit_future_8h_km: float = 5.0
    audit_future_12h_km: float = 5.0


def _distance(a: Column, b: Column) -> Column:
    return haversine_km(a.lat, a.lon, b.lat, b.lon)


def with_track(windows: DataFrame) -> DataFrame:
    """Adds the anchor and double-precision tracks that the metrics read."""
    return windows.withColumn("_a", anchor()).withColumn("_hp", as_points("hist")).withColumn("_fp", as_points("fut"))


def _radius(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: _distance(F.col("_a"), p)))


def history_metrics(windows: DataFrame) -> DataFrame:
    hp = F.col("_hp")
    return (
        with_track(windows)
        .withColumn("history_max_radius_km", _radius(hp))
        .withColumn("history_displacement_km", _distance(hp[0], F.col("_a")))
        .withColumn("history_path_length_km", path_km(hp))
        .withColumn("history_mean_sog_kn", mean(F.col("hist"), lambda p: p.sog))
        .drop("_a", "_hp", "_fp")
    )


def window_metrics(windows: DataFrame) -> DataFrame:
    """Metrics over history and future together; the future carries no speed, so none is averaged."""
    whole = F.concat(F.col("_hp"), F.col("_fp"))
    return (
        with_track(windows)
        .withColumn("max_radius_km", _radius(whole))
        .withColumn("future_displacement_km", _distance(F.col("_a"), F.element_at("_fp", -1)))
        .withColumn("history_displacement_km", _distance(F.col("_hp")[0], F.col("_a")))
        .withColumn("path_length_km", path_km(whole))
        .drop("_a", "_hp", "_fp")
    )


def smart_metrics(windows: DataFrame, step_minutes: int = 10) -> DataFrame:
    """Net motion over parts of the history, loop ratio, and future motion for audits."""
    n = F.size("_hp")
    back = lambda hours: F.element_at("_hp", -F.least(n, F.lit(max(1, steps_for(hours, step_minutes)))))
    ahead = lambda hours: F.element_at(
        "_fp", F.greatest(F.lit(1), F.least(F.lit(steps_for(hours, step_minutes)), F.size("_fp")))
    )
    a = F.col("_a")
    return (
        with_track(windows)
        .withColumn("history_full_net_km", _distance(F.col("_hp")[0], a))
        .withColumn("history_16h_net_km", _distance(back(16.0), a))
        .withColumn("history_last_8h_net_km", _distance(back(8.0), a))
        .withColumn("history_path_km", path_km(F.col("_hp")))
        .withColumn("history_max_radius_km", _radius(F.col("_hp")))
        .withColumn("history_loop_ratio", loop_ratio(F.col("history_path_km"), F.col("history_full_net_km"), 10.0))
        .withColumn("arrived_then_stopped", (F.col("history_full_net_km") >= 20.0) & (F.col("history_last_8h_net_km") < 3.0))
        .withColumn("future_8h_net_km", _distance(a, ahead(8.0)))
        .withColumn("future_12h_net_km", _distance(a, ahead(12.0)))
        .drop("_a", "_hp", "_fp")
    )


def measured_once(measured: DataFrame, columns: list[str]) -> DataFrame:
    """The added columns of a frame behind a one-element generator, below which no filter is pushed.

    A filter on metrics then reads their values; pushed below the projection it would repeat
    each metric wherever it is named.
    """
    added = [c for c in measured.columns if c not in columns]
    packed = measured.select(*columns, F.struct(*added).alias("_m"))
    return packed.select(*columns, F.inline(F.array("_m")))


def loop_ratio(path: Column, net: Column, min_path: float) -> Column:
    """Net over path; short paths count as 1 (no loop)."""
    return F.when(path > min_path, net / F.greatest(path, F.lit(1e-6))).otherwise(F.lit(1.0))


def is_stationary(cfg: StationaryConfig = StationaryConfig()) -> Column:
    """Removal mask over history_metrics (or window_metrics for the older form)."""
    prefix = "history_" if cfg.history_only else ""
    radius = F.col(f"{prefix}max_radius_km")
    disp = F.col("history_displacement_km" if cfg.history_only else "future_displacement_km")
    path = F.col(f"{prefix}path_length_km")
    mask = (radius <= cfg.max_radius_km) & (disp < cfg.min_displacement_km)
    if cfg.require_displacement_km > 0:
        mask = mask | (disp < cfg.require_displacement_km)
    if cfg.require_path_km > 0:
        mask = mask | (path < cfg.require_path_km)
    if cfg.max_loop_ratio is not None:
        ratio = loop_ratio(path, disp, cfg.min_loop_path_km)
        mask = mask | ((path > cfg.min_loop_path_km) & (ratio < cfg.max_loop_ratio))
    return mask


def is_local_loop(cfg: SmartMotionConfig) -> Column:
    path, radius = F.col("history_path_km"), F.col("history_max_radius_km")
    big = (path >= cfg.big_loop_path_km) | (radius >= cfg.big_loop_radius_km)
    return (path > cfg.min_loop_path_km) & (F.col("history_loop_ratio") < cfg.max_loop_ratio) & ~big


def fails_smart_motion(cfg: SmartMotionConfig = SmartMotionConfig()) -> Column:
    """Removal mask over smart_metrics."""
    return (
        (F.col("history_16h_net_km") < cfg.min_16h_net_km)
        | (F.col("history_last_8h_net_km") < cfg.min_last_8h_net_km)
        | is_local_loop(cfg)
    )


def reject_reason(cfg: SmartMotionConfig = SmartMotionConfig()) -> Column:
    parts = F.concat_ws(
        "+",
        F.when(F.col("history_16h_net_km") < cfg.min_16h_net_km, F.lit(f"16h<{cfg.min_16h_net_km:g}km")),
        F.when(F.col("history_last_8h_net_km") < cfg.min_last_8h_net_km, F.lit(f"last8h<{cfg.min_last_8h_net_km:g}km")),
        F.when(is_local_loop(cfg), F.lit("local_loop")),
    )
    return F.when(parts == "", F.lit("?")).otherwise(parts)


def filter_stationary(windows: DataFrame, cfg: StationaryConfig = StationaryConfig()) -> tuple[DataFrame, DataFrame]:
    """Kept windows and a one-row report. The filter is one map over the windows."""
    measured = history_metrics(windows) if cfg.history_only else window_metrics(windows)
    measured = measured_once(measured, windows.columns)
    flagged = measured.withColumn("removed", is_stationary(cfg))
    added = [c for c in flagged.columns if c not in windows.columns]
    return flagged.filter(~F.col("removed")).drop(*added), stationary_report(flagged, cfg)


def stationary_report(flagged: DataFrame, cfg: StationaryConfig = StationaryConfig()) -> DataFrame:
    radius = "history_max_radius_km" if cfg.history_only else "max_radius_km"
    flagged = materialize(flagged.select("removed", radius), "stationary")
    counts = flagged.agg(
        F.count(F.lit(1)).alias("windows_total"),
        F.coalesce(F.sum(F.col("removed").cast("int")), F.lit(0)).alias("windows_removed"),
    )
    sides = flagged.select(
        F.when(F.col("removed"), F.col(radius)).alias("max_radius_km_removed"),
        F.when(~F.col("removed"), F.col(radius)).alias("max_radius_km_kept"),
    )
    medians = percentile_columns(sides, ["max_radius_km_removed", "max_radius_km_kept"], {"median": 0.5}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    n = F.greatest(F.col("windows_total"), F.lit(1))
    return (
        one(counts)
        .join(F.broadcast(one(medians)), "_k")
        .select(
            "windows_total",
            "windows_removed",
            (F.col("windows_total") - F.col("windows_removed")).alias("windows_kept"),
            (F.col("windows_removed") / n).alias("removed_fraction"),
            ((F.col("windows_total") - F.col("windows_removed")) / n).alias("kept_fraction"),
            F.lit(cfg.history_only).alias("history_only"),
            F.coalesce("median_max_radius_km_removed", F.lit(0.0)).alias("median_max_radius_km_removed"),
            F.coalesce("median_max_radius_km_kept", F.lit(0.0)).alias("median_max_radius_km_kept"),
        )
    )


def filter_smart_motion(windows: DataFrame, cfg: SmartMotionConfig = SmartMotionConfig(), step_minutes: int = 10) -> DataFrame:
    measured = measured_once(smart_metrics(windows, step_minutes), windows.columns)
    return measured.filter(~fails_smart_motion(cfg)).select(*windows.columns)


def maneuver_score() -> Column:
    return mean(F.col("hist"), lambda p: F.abs(p.dcog)) + mean(F.col("hist"), lambda p: F.abs(p.dsog))


def motion_buckets(windows: DataFrame) -> DataFrame:
    """Four flags; a window can be anchored and a maneuver at once. Thresholds apply to the stored speed."""
    out = windows.withColumn("mean_sog", mean(F.col("hist"), lambda p: p.sog)).withColumn(
        "max_dcog", largest(F.col("hist"), lambda p: F.abs(p.dcog))
    )
    anchored = F.col("mean_sog") < 1.0
    turning = F.col("max_dcog") > 15.0
    straight = (F.col("mean_sog") >= 5.0) & (F.col("max_dcog") < 5.0) & ~anchored
    return (
        out.withColumn("straight", straight)
        .withColumn("maneuver", turning)
        .withColumn("anchored", anchored)
        .withColumn("other", ~(anchored | turning | straight))
    )


def bucket_names() -> Column:
    """Names of the true buckets of a row, for exploding into overlapping groups."""
    names = ("straight", "maneuver", "anchored", "other")
    return F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))


DESCRIPTIVE = (
    "mean_sog",
    "std_sog",
    "maneuver_mean_abs_dcog",
    "max_abs_dcog",
    "accel_mean_abs_dsog",
    "path_km_24h",
    "net_disp_km_24h",
    "straightness",
    "abs_dlat_24h",
    "abs_dlon_24h",
    "anchor_lat",
    "anchor_lon",
)


def descriptive_features(windows: DataFrame) -> DataFrame:
    """Twelve features that describe the history of a window."""
    hist, hp = F.col("hist"), F.col("_hp")
    first, last = hp[0], F.col("_a")
    out = with_track(windows)
    values = {
        "mean_sog": mean(hist, lambda p: p.sog),
        "std_sog": std_pop(hist, lambda p: p.sog),
        "maneuver_mean_abs_dcog": mean(hist, lambda p: F.abs(p.dcog)),
        "max_abs_dcog": largest(hist, lambda p: F.abs(p.dcog)),
        "accel_mean_abs_dsog": mean(hist, lambda p: F.abs(p.dsog)),
        "path_km_24h": path_km(hp),
        "net_disp_km_24h": _distance(first, last),
        "abs_dlat_24h": F.abs(last.lat - first.lat),
        "abs_dlon_24h": F.abs(last.lon - first.lon),
        "anchor_lat": last.lat,
        "anchor_lon": last.lon,
    }
    for name, value in values.items():
        out = out.withColumn(name, value)
    return out.withColumn(
        "straightness",
        F.least(F.col("net_disp_km_24h") / F.greatest("path_km_24h", F.lit(1e-3)), F.lit(1.0)),
    ).drop("_a", "_hp", "_fp")


def track_shape(tracks: DataFrame, hour_steps: int = 6) -> DataFrame:
    """Shape of a future track given columns anchor (struct) and true_track (array of structs).

    directness = net / path from the anchor; cross_track = largest distance to the
    anchor-end chord; turn = sum of hourly bearing changes.
    """
    a, track = F.col("anchor"), F.col("true_track")
    full = F.concat(F.array(a), track)
    end = F.element_at(track, -1)
    ke = F.lit(CHORD_KM_PER_DEG) * F.cos(F.radians(a.lat))
    kn = F.lit(CHORD_KM_PER_DEG)
    chord_e, chord_n = (end.lon - a.lon) * ke, (end.lat - a.lat) * kn
    chord = F.hypot(chord_e, chord_n) + F.lit(1e-9)
    cross = F.array_max(
        F.transform(
            track,
            lambda p: F.abs(chord_e * ((p.lat - a.lat) * kn) - chord_n * ((p.lon - a.lon) * ke)) / chord,
        )
    )
    coarse = F.filter(full, lambda p, i: i % hour_steps == 0)
    bearings = consecutive(coarse, lambda p, q: initial_bearing_deg(p.lat, p.lon, q.lat, q.lon))
    return (
        tracks.withColumn("net_km", _distance(a, end))
        .withColumn("path_km", path_km(full))
        .withColumn("directness", F.col("net_km") / F.greatest("path_km", F.lit(1e-6)))
        .withColumn("cross_track_km", cross)
        .withColumn("_bearings", bearings)
        .withColumn("turn_deg", total(consecutive(F.col("_bearings"), lambda p, q: F.abs(turn_deg(q, p)))))
        .drop("_bearings")
        .withColumn(
            "maneuver_score",
            (1 - F.greatest(F.least("directness", F.lit(1.0)), F.lit(0.0)))
            * F.log1p("cross_track_km")
            * F.log1p("turn_deg"),
        )
    )


def difficulty_weights(windows: DataFrame) -> DataFrame:
    """weight = 1 + score / median(score), stored as float."""
    scored = windows.withColumn("maneuver_score", maneuver_score())
    median = percentile_columns(scored.select("maneuver_score"), ["maneuver_score"], {"median": 0.5})
    centre = median.select("median_maneuver_score").scalar()
    return scored.withColumn("weight", (1 + F.col("maneuver_score") / (centre + F.lit(1e-6))).cast("float"))


def padded_extent(points: DataFrame, fraction: float = 0.02, default: float = 0.1) -> DataFrame:
    """Extent of the points, widened by a share of its size (or a default for a flat extent)."""
    ext = points.agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")
    )
    pad = lambda lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) * fraction).otherwise(F.lit(default))
    return ext.select(
        (F.col("a") - pad("a", "b")).alias("south"),
        (F.col("b") + pad("a", "b")).alias("north"),
        (F.col("c") - pad("c", "d")).alias("west"),
        (F.col("d") + pad("c", "d")).alias("east"),
    )
