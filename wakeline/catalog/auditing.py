"""Audits, routes, lookups, land and incremental ingest."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from wakeline.catalog.base import pct, query
from wakeline.catalog.cleaning import EAST, STATS, _label_sql
from wakeline.catalog.modelling import KEYS, _split_sql, forecasts
from wakeline.catalog.windowing import SHAPE_SQL, SMART, SMART_REMOVED, SMART_SQL, STEP, WHOLE_SQL, _smart, _win, shapes
from wakeline.constants import AUDIT_QUANTILES, PORTS
from wakeline.operators import audit as Q, evaluate as E, land as L, lookup as U, motion as M, routes as V, segment as G
from wakeline.operators.clean import clean
from wakeline.operators.windows import cap_per_trajectory, window_id
from wakeline.plans import adapter as A, jobs
from wakeline.plans.increments import SegmentState
from wakeline.sources import ais_csv, datasets, days, tables
from wakeline.sources.scratch import materialize, new_path
from wakeline.streaming import ingest


def trajectories(spark, sf) -> DataFrame:
    return Q.trajectory_audit(A.stored_segments(spark, sf), 24.0, 12.0, STEP)


AUDIT = "traj_id:s mmsi:i n_points:i start_time:t end_time:t median_dt_sec:d mean_dt_sec:d p95_dt_sec:d total_distance_km:d mean_sog_kmh:d duration_hours:d duration_days:d points_per_hour:d possible_windows:i"
AUDIT_SQL = f"""
    SELECT *, duration_hours / 24.0::DOUBLE AS duration_days, n_points / nullif(duration_hours, 0) AS points_per_hour,
           greatest(CAST(floor((duration_hours - 36.0::DOUBLE) / 3.0::DOUBLE + 1) AS BIGINT), 0) AS possible_windows
    FROM (SELECT traj_id, any_value(mmsi) AS mmsi, count(*) AS n_points, min(timestamp) AS start_time, max(timestamp) AS end_time, {pct('dt_sec', 0.5)} AS median_dt_sec,
                 avg(dt_sec) AS mean_dt_sec, {pct('dt_sec', 0.95)} AS p95_dt_sec, sum(dist_km) AS total_distance_km, avg(sog) AS mean_sog_kmh,
                 (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE / 3600.0::DOUBLE AS duration_hours
          FROM segments GROUP BY traj_id)"""


@query("a01_trajectory_audit", AUDIT, AUDIT_SQL)
def a01(spark, sf):
    return Q.trajectory_audit(A.segments(spark, sf), 24.0, 12.0, STEP)


@query("a01_audit_by_vessel", "traj_id:s n_points:i median_dt_sec:d p95_dt_sec:d total_distance_km:d", f"""
    SELECT CAST(mmsi AS VARCHAR) AS traj_id, count(*) AS n_points, {pct('dt_sec', 0.5)} AS median_dt_sec, {pct('dt_sec', 0.95)} AS p95_dt_sec, sum(dist_km) AS total_distance_km
    FROM segments GROUP BY mmsi""")
def a01_vessel(spark, sf):
    return Q.trajectory_audit(A.stored_segments(spark, sf).drop("traj_id"), 24.0, 12.0, STEP)


VESSEL = "mmsi:i n_segments:i total_points:i total_observed_hours:d longest_segment_hours:d first_seen:t last_seen:t total_possible_windows:i total_distance_km:d calendar_span_hours:d"
VESSEL_SQL = f"""
    SELECT *, (epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9::DOUBLE AS calendar_span_hours FROM (
        SELECT mmsi, count(*) AS n_segments, sum(n_points) AS total_points, sum(duration_hours) AS total_observed_hours, max(duration_hours) AS longest_segment_hours,
               min(start_time) AS first_seen, max(end_time) AS last_seen, sum(possible_windows) AS total_possible_windows, sum(total_distance_km) AS total_distance_km
        FROM ({AUDIT_SQL}) GROUP BY mmsi)"""


@query("a02_vessel_audit", VESSEL, VESSEL_SQL)
def a02(spark, sf):
    return Q.vessel_audit(trajectories(spark, sf))


@query("a03_windows_by_trajectory", "traj_id:s mmsi:i n_windows:i first_window_start:t last_window_end:t", """
    SELECT traj_id, any_value(mmsi) AS mmsi, count(*) AS n_windows, min(start_time) AS first_window_start, max(target_end_time) AS last_window_end FROM win GROUP BY traj_id""")
def a03(spark, sf):
    return Q.windows_by_trajectory(A.stored_windows(spark, sf))


@query("a03_windows_by_vessel", "mmsi:i n_traj_with_windows:i n_windows:i", "SELECT mmsi, count(DISTINCT traj_id) AS n_traj_with_windows, count(*) AS n_windows FROM win GROUP BY mmsi")
def a03_vessel(spark, sf):
    return Q.windows_by_vessel(Q.windows_by_trajectory(A.stored_windows(spark, sf)))


@query("a04_quantile_summary", "metric:s p:d n:i value:d", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {p} AS p, count(*) AS n, {pct(m, p)} AS value FROM ({AUDIT_SQL})"
    for m in ("duration_hours", "n_points", "possible_windows") for p in AUDIT_QUANTILES))
def a04(spark, sf):
    return Q.quantile_summary(trajectories(spark, sf), ["duration_hours", "n_points", "possible_windows"])


@query("a04_coverage_totals", "rows:i vessels:i trajectories:i first_time:t last_time:t possible_windows:i trajectories_with_windows:i", f"""
    SELECT sum(n_points) AS rows, count(DISTINCT mmsi) AS vessels, count(*) AS trajectories, min(start_time) AS first_time, max(end_time) AS last_time,
           sum(possible_windows) AS possible_windows, sum(CASE WHEN possible_windows > 0 THEN 1 ELSE 0 END) AS trajectories_with_windows FROM ({AUDIT_SQL})""")
def a04_totals(spark, sf):
    return Q.coverage_totals(trajectories(spark, sf))


@query("a05_longest_trajectories", "traj_id:s duration_hours:d n_points:i", f"SELECT * FROM ({AUDIT_SQL}) ORDER BY duration_hours DESC, traj_id LIMIT 20")
def a05(spark, sf):
    return Q.top_rows(trajectories(spark, sf), "duration_hours", ["traj_id"], 20)


@query("a05_busiest_vessels", "mmsi:i total_observed_hours:d", f"SELECT * FROM ({VESSEL_SQL}) ORDER BY total_observed_hours DESC, mmsi LIMIT 20")
def a05_vessels(spark, sf):
    return Q.top_rows(Q.vessel_audit(trajectories(spark, sf)), "total_observed_hours", ["mmsi"], 20)


@query("a06_histogram", "bin:i n:i", f"""
    SELECT least(CAST(floor((n_points - lo) / ((hi - lo) / 50.0::DOUBLE)) AS BIGINT), 49) AS bin, count(*) AS n
    FROM ({AUDIT_SQL}), (SELECT min(n_points)::DOUBLE AS lo, max(n_points)::DOUBLE AS hi FROM ({AUDIT_SQL})) GROUP BY 1""")
def a06(spark, sf):
    return Q.fixed_histogram(trajectories(spark, sf), "n_points", 50)


FRAME = "traj_id:s mmsi:i n_points:i n_in_frame:i start_time:t end_time:t in_frame_hours:d total_distance_km:d mean_sog_kmh:d duration_hours:d pct_points_in_frame:d pct_time_in_frame:d n_out_of_frame:i"


def frame_sql(source: str, box, strict: bool = False) -> str:
    inside = f"lat BETWEEN {box[0]} AND {box[1]} AND lon BETWEEN {box[2]} AND {box[3]}"
    return f"""
        SELECT *, n_in_frame / n_points AS pct_points_in_frame, in_frame_hours / nullif(duration_hours, 0) AS pct_time_in_frame, n_points - n_in_frame AS n_out_of_frame
        FROM (SELECT traj_id, any_value(mmsi) AS mmsi, count(*) AS n_points, sum(CAST(inside AS INTEGER)) AS n_in_frame, min(timestamp) AS start_time, max(timestamp) AS end_time,
                     sum(CASE WHEN inside AND step > 0 THEN step ELSE 0 END) / 3600.0::DOUBLE AS in_frame_hours, sum(dist_km) AS total_distance_km, avg(sog) AS mean_sog_kmh,
                     (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9::DOUBLE AS duration_hours
              FROM (SELECT *, {inside} AS inside, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY traj_id ORDER BY timestamp))) / 1e6::DOUBLE AS step
                    FROM {source} {"WHERE " + inside if strict else ""}) GROUP BY traj_id)"""


@query("a07_frame_stats", FRAME, frame_sql("segments", EAST))
def a07(spark, sf):
    return Q.frame_stats(A.stored_segments(spark, sf), EAST)


@query("a07_frame_stats_strict", FRAME, frame_sql("segments", EAST, True))
def a07_strict(spark, sf):
    return Q.frame_stats(A.stored_segments(spark, sf), EAST, strict=True)


def vessel_frame_sql(stats: str, by: str = "mmsi") -> str:
    return f"""
        SELECT *, min_pct_points_in_frame >= 1.0 AS fully_in_frame FROM (
            SELECT {by}, count(*) AS n_segments, max(in_frame_hours) AS longest_in_frame_hours, max(duration_hours) AS longest_duration_hours,
                   sum(in_frame_hours) AS total_in_frame_hours, sum(duration_hours) AS total_duration_hours, min(pct_points_in_frame) AS min_pct_points_in_frame,
                   avg(pct_points_in_frame) AS mean_pct_points_in_frame, sum(n_out_of_frame) AS n_out_of_frame_points FROM ({stats}) GROUP BY {by})"""


HOURS = "mmsi:i n_segments:i longest_in_frame_hours:d longest_duration_hours:d total_in_frame_hours:d total_duration_hours:d min_pct_points_in_frame:d mean_pct_points_in_frame:d n_out_of_frame_points:i fully_in_frame:b"


@query("a08_vessel_frame_hours", HOURS, vessel_frame_sql(frame_sql("segments", EAST)))
def a08(spark, sf):
    return Q.vessel_frame_hours(Q.frame_stats(A.stored_segments(spark, sf), EAST))


WIDE = (33.0, 41.0, -76.0, -68.0)


def _coasts(spark, sf):
    seg = A.stored_segments(spark, sf)
    return Q.coast_export({
        "Eastern coast": (seg.filter("mmsi % 2 = 0"), "east_coast", "30d", EAST),
        "USA Combined": (seg.filter("mmsi % 2 = 1"), "usa_combined", "all", WIDE),
    })


_coast_sql = f"""SELECT 'Eastern coast' AS coast, * FROM ({frame_sql("(SELECT * FROM segments WHERE mmsi % 2 = 0)", EAST)})
    UNION ALL SELECT 'USA Combined' AS coast, * FROM ({frame_sql("(SELECT * FROM segments WHERE mmsi % 2 = 1)", WIDE)})"""


@query("a09_coast_export", "coast:s " + HOURS, vessel_frame_sql(_coast_sql, "coast, mmsi"))
def a09(spark, sf):
    return _coasts(spark, sf)[1]


@query("a09_coast_counts", "coast:s trajectories:i out_of_frame_points:i vessels:i vessels_with_out_of_frame:i", f"""
    WITH s AS ({_coast_sql}), v AS ({vessel_frame_sql("SELECT * FROM s", "coast, mmsi")})
    SELECT coast, trajectories, out_of_frame_points, vessels, vessels_with_out_of_frame
    FROM (SELECT coast, count(*) AS trajectories, sum(n_out_of_frame) AS out_of_frame_points FROM s GROUP BY coast)
    JOIN (SELECT coast, count(*) AS vessels, sum(CAST(NOT fully_in_frame AS INTEGER)) AS vessels_with_out_of_frame FROM v GROUP BY coast) USING (coast)""")
def a09_counts(spark, sf):
    return Q.coast_counts(*_coasts(spark, sf))


@query("a10_stationary_audit", "removed:b n:i share:d median_max_radius_km:d median_future_displacement_km:d median_path_length_km:d", f"""
    SELECT removed, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share, {pct('max_radius_km', 0.5)} AS median_max_radius_km,
           {pct('future_displacement_km', 0.5)} AS median_future_displacement_km, {pct('path_length_km', 0.5)} AS median_path_length_km
    FROM (SELECT *, max_radius_km <= 0.5 AND future_displacement_km < 1.0 AS removed FROM ({WHOLE_SQL})) GROUP BY removed""")
def a10(spark, sf):
    flagged = M.window_metrics(_win(spark, sf)).withColumn("removed", M.is_stationary(M.StationaryConfig(history_only=False)))
    return Q.mask_audit(flagged, ["max_radius_km", "future_displacement_km", "path_length_km"])


_smart_flagged = f"""SELECT s.*, h.traj_id, h.start_time, {SMART_REMOVED} AS removed FROM ({SMART_SQL}) s JOIN hm h USING (window_id)"""


@query("a11_smart_filter_audit", "n_pool:i keep_fraction:d n_kept:i future_8h_moves:d future_12h_moves:d arrived_then_stopped:d median_future_8h_net_km:d median_future_12h_net_km:d", f"""
    SELECT count(*) AS n_pool, avg(CAST(NOT removed AS DOUBLE)) AS keep_fraction, sum(CAST(NOT removed AS INTEGER)) AS n_kept,
           avg(CAST(future_8h_net_km >= 5 AS DOUBLE)) FILTER (WHERE NOT removed) AS future_8h_moves, avg(CAST(future_12h_net_km >= 5 AS DOUBLE)) FILTER (WHERE NOT removed) AS future_12h_moves,
           avg(CAST(arrived_then_stopped AS DOUBLE)) FILTER (WHERE NOT removed) AS arrived_then_stopped, {pct('future_8h_net_km', 0.5, 'NOT removed')} AS median_future_8h_net_km,
           {pct('future_12h_net_km', 0.5, 'NOT removed')} AS median_future_12h_net_km FROM ({_smart_flagged})""")
def a11(spark, sf):
    return Q.smart_filter_audit(_smart(spark, sf), SMART)


@query("a11_smart_audit_rows", KEYS + "smart_keep:b future_8h_moves:b future_12h_moves:b", f"""
    SELECT window_id, NOT removed AS smart_keep, future_8h_net_km >= 5 AS future_8h_moves, future_12h_net_km >= 5 AS future_12h_moves FROM ({_smart_flagged})
    ORDER BY removed, md5('42|' || traj_id || '|' || CAST(start_time AS VARCHAR)) LIMIT 40""")
def a11_rows(spark, sf):
    return Q.smart_audit_rows(_smart(spark, sf), 40, ("traj_id", "start_time"), SMART)


@query("a12_span_and_days", "span_hours:d n_days:i", "SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9::DOUBLE AS span_hours, count(DISTINCT CAST(timestamp AS DATE)) AS n_days FROM points")
def a12(spark, sf):
    return Q.span_and_days(A.points(spark, sf))


_hours_sql = f"SELECT mmsi, least(greatest(longest_in_frame_hours, 0.0::DOUBLE), 400.0::DOUBLE) AS hours FROM ({vessel_frame_sql(frame_sql('segments', EAST))})"


@query("a13_tracking_summary", "vessels:i mean_hours:d max_hours:d median_hours:d p90_hours:d p99_5_hours:d", f"""
    SELECT count(*) AS vessels, avg(hours) AS mean_hours, max(hours) AS max_hours, {pct('hours', 0.5)} AS median_hours, {pct('hours', 0.9)} AS p90_hours, {pct('hours', 0.995)} AS p99_5_hours FROM ({_hours_sql})""")
def a13(spark, sf):
    return Q.tracking_summary(Q.tracking_hours(a08(spark, sf), 400.0))


@query("a13_tracking_histogram", "bin:i n:i", f"SELECT least(CAST(floor(hours / 10.0::DOUBLE) AS BIGINT), 39) AS bin, count(*) AS n FROM ({_hours_sql}) GROUP BY 1")
def a13_histogram(spark, sf):
    return Q.fixed_histogram(Q.tracking_hours(a08(spark, sf), 400.0), "hours", 40, 0.0, 400.0)


@query("a14_speed_distribution", "n:i mean_sog:d median_sog:d stationary_share:d cruising_share:d", f"""
    SELECT count(*) AS n, avg(s) AS mean_sog, {pct('s', 0.5)} AS median_sog, avg(CASE WHEN s < 0.926::DOUBLE THEN 1.0 ELSE 0.0 END) AS stationary_share,
           avg(CASE WHEN s >= 9.26::DOUBLE THEN 1.0 ELSE 0.0 END) AS cruising_share FROM (SELECT least(greatest(sog, 0.0::DOUBLE), 55.56::DOUBLE) AS s FROM points)""")
def a14(spark, sf):
    return Q.speed_distribution(A.points(spark, sf))


@query("a15_vessel_type_counts", "label:s n:i", f"SELECT {_label_sql} AS label, count(*) AS n FROM points GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def a15(spark, sf):
    return Q.vessel_type_counts(A.points(spark, sf))


@query("a16_dataset_summary", "rows:i routes:i vessels:i first_time:t last_time:t", """
    SELECT count(*) AS rows, count(DISTINCT traj_id) AS routes, count(DISTINCT mmsi) AS vessels, min(timestamp) AS first_time, max(timestamp) AS last_time FROM segments""")
def a16(spark, sf):
    return Q.dataset_summary(A.stored_segments(spark, sf))


STAGE = "stage:s rows_in:i rows_out:i kept_fraction:d median_history_max_radius_km:d median_maneuver_score:d p90_maneuver_score:d"
STAGE_SQL = f"""
    SELECT 'stationary' AS stage, count(*) AS rows_in, sum(CAST(keep AS INTEGER)) AS rows_out, avg(CAST(keep AS DOUBLE)) AS kept_fraction,
           {pct('radius', 0.5, 'keep')} AS median_history_max_radius_km, {pct('score', 0.5, 'keep')} AS median_maneuver_score, {pct('score', 0.9, 'keep')} AS p90_maneuver_score
    FROM (SELECT *, NOT (radius <= 0.5 AND net < 1.0) AS keep FROM buckets)"""


def _stage(spark, sf) -> DataFrame:
    w = M.history_metrics(_win(spark, sf)).withColumn("maneuver_score", M.maneuver_score()).withColumn("keep", ~M.is_stationary())
    return Q.stage_report(w, "keep", ["history_max_radius_km", "maneuver_score"], "stationary")


@query("a17_stage_report", STAGE, STAGE_SQL)
def a17(spark, sf):
    return _stage(spark, sf)


@query("s11_json_report", STAGE, STAGE_SQL)
def s11(spark, sf):
    path = new_path(spark, "report")
    tables.write_report(_stage(spark, sf), path)
    return spark.read.json(path)


@query("s12_text_summary", "section:s metric:s number:d", f"""
    SELECT 'coverage' AS section, metric, value AS number FROM (
        SELECT sum(n_points)::DOUBLE AS rows, count(DISTINCT mmsi)::DOUBLE AS vessels, count(*)::DOUBLE AS trajectories FROM ({AUDIT_SQL})
    ) UNPIVOT (value FOR metric IN (rows, vessels, trajectories))
    UNION ALL SELECT 'parameters', 'resample_minutes', 180""")
def s12(spark, sf):
    path = new_path(spark, "summary")
    totals = Q.coverage_totals(trajectories(spark, sf)).select("rows", "vessels", "trajectories")
    parameters = totals.select(F.lit(STEP).alias("resample_minutes"))
    tables.write_summary([tables.tall_metrics(totals, "coverage"), tables.tall_metrics(parameters, "parameters")], path)
    return spark.read.option("header", True).csv(path).withColumn("number", F.col("value").try_cast("double"))


# --- routes and lookups ----------------------------------------------------------------


@query("v01_top_by_points", "traj_id:s n_points:i", "SELECT traj_id, count(*) AS n_points FROM segments GROUP BY traj_id ORDER BY n_points DESC, traj_id LIMIT 10")
def v01(spark, sf):
    return V.top_by_points(A.stored_segments(spark, sf), 10)


@query("v02_top_by_distance", "traj_id:s total_distance_km:d label:s", """
    SELECT traj_id, total_distance_km, printf('%.1f km, %.1f h', total_distance_km, duration_hours) AS label FROM long_stats ORDER BY total_distance_km DESC, traj_id LIMIT 5""")
def v02(spark, sf):
    return V.top_by_distance(G.trajectory_stats(A.stored_segments(spark, sf)), 5)


_top = "traj_id IN (SELECT traj_id FROM segments GROUP BY traj_id ORDER BY count(*) DESC, traj_id LIMIT 10)"


@query("v03_route_points", "traj_id:s timestamp:t lat:d lon:d", f"SELECT traj_id, timestamp, lat, lon FROM segments WHERE {_top}")
def v03(spark, sf):
    seg = A.stored_segments(spark, sf)
    return V.route_points(seg, V.top_by_points(seg, 10))


@query("v04_polylines", "traj_id:s mmsi:i n_points:i start_time:t end_time:t start_lat:d end_lon:d label:s wkt:s", f"""
    SELECT traj_id, any_value(mmsi) AS mmsi, count(*) AS n_points, min(timestamp) AS start_time, max(timestamp) AS end_time, arg_min(lat, timestamp) AS start_lat, arg_max(lon, timestamp) AS end_lon,
           'traj_id ' || traj_id || ' (' || arg_min(label, timestamp) || ') | MMSI ' || CAST(any_value(mmsi) AS VARCHAR) AS label,
           'LINESTRING (' || string_agg(printf('%.5f %.5f', lon, lat), ', ' ORDER BY timestamp) || ')' AS wkt
    FROM (SELECT *, {_label_sql} AS label FROM segments WHERE {_top}) GROUP BY traj_id""")
def v04(spark, sf):
    seg = A.stored_segments(spark, sf)
    return V.polylines(seg, V.top_by_points(seg, 10))


@query("v04_polyline_parts", "traj_id:s part:i n_points:i start_time:t end_time:t wkt:s", """
    WITH n AS (SELECT traj_id, timestamp, lat, lon, row_number() OVER (PARTITION BY traj_id ORDER BY timestamp) - 1 AS pos FROM segments),
    e AS (SELECT *, pos // 10 AS part FROM n UNION ALL SELECT *, pos // 10 - 1 FROM n WHERE pos % 10 = 0 AND pos > 0)
    SELECT traj_id, part, count(*) AS n_points, min(timestamp) AS start_time, max(timestamp) AS end_time,
           'LINESTRING (' || string_agg(printf('%.5f %.5f', lon, lat), ', ' ORDER BY pos) || ')' AS wkt
    FROM e GROUP BY traj_id, part HAVING count(*) >= 2""")
def v04_parts(spark, sf):
    return V.polyline_parts(A.segments(spark, sf), 10)


def examples(spark, sf) -> DataFrame:
    """Naive forecast error, true displacement and true path of each window."""
    one = E.with_errors(forecasts(spark, sf).filter("model = 'naive'"), floor_km=0.0)
    from wakeline.functions.series import path_km

    return one.select("window_id", F.col("fde_km").alias("err_km"), F.col("displacement_km").alias("net_km"),
                      path_km(F.concat(F.array("anchor"), "true_track")).alias("path_km"))


_examples = "(SELECT window_id, fde_km AS err_km, net_km, full_path_km AS path_km FROM ferr WHERE model = 'naive')"


@query("v05_picks_by_error_band", "band:s pick:i window_id:s", f"""
    SELECT band, rn AS pick, window_id FROM (
        SELECT *, row_number() OVER (PARTITION BY band ORDER BY net_km DESC, window_id) AS rn FROM (
            SELECT *, CASE WHEN err_km < 15 THEN 'low' WHEN err_km < 40 THEN 'medium' ELSE 'high' END AS band FROM {_examples} WHERE net_km > 5)) WHERE rn <= 2""")
def v05(spark, sf):
    return V.picks_by_error_band(examples(spark, sf))


@query("v05_longest_tracks", "window_id:s net_km:d", f"SELECT window_id, net_km FROM {_examples} WHERE net_km >= 40 ORDER BY net_km DESC, window_id LIMIT 6")
def v05_longest(spark, sf):
    return V.longest_tracks(examples(spark, sf))


_rules = [
    (1, "is_straight AND err_km < 20", 3, "net_km"), (2, "is_straight AND err_km >= 20 AND err_km < 50", 2, "net_km"), (3, "is_long AND err_km >= 50", 2, "net_km"),
    (4, "is_turning AND err_km < 25", 2, "maneuver_score"), (5, "is_turning AND err_km >= 25 AND err_km < 55", 3, "maneuver_score"), (6, "is_turning AND err_km >= 55", 3, "maneuver_score"),
]


def _shape_picks_sql() -> str:
    """Rules 1 to 6 exclude each other except through `used`; the fill takes travelling tracks by net."""
    ctes = [f"""s0 AS MATERIALIZED (SELECT s.*, e.err_km, s.net_km >= 80 AND directness >= 0.9 AND cross_track_km < 15 AS is_straight, s.net_km >= 80 AS is_long,
                s.net_km >= 45 AND (directness < 0.75 OR cross_track_km > 20) AND turn_deg > 80 AS is_turning, s.net_km >= 45 AS is_mid
                FROM ({SHAPE_SQL}) s JOIN {_examples} e USING (window_id))"""]
    used = ""
    for i, cond, k, order in _rules:
        ctes.append(f"r{i} AS MATERIALIZED (SELECT window_id, {i} AS rule_no FROM s0 WHERE {cond} {used} ORDER BY {order} DESC, window_id LIMIT {k})")
        used += f" AND window_id NOT IN (SELECT window_id FROM r{i})"
    six = " UNION ALL ".join(f"SELECT * FROM r{i}" for i, *_ in _rules)
    ctes.append(f"picked AS MATERIALIZED ({six})")
    ctes.append("r7 AS MATERIALIZED (SELECT * FROM (SELECT window_id, 7 AS rule_no, row_number() OVER (ORDER BY maneuver_score DESC, window_id) AS rn FROM s0 WHERE is_turning AND window_id NOT IN (SELECT window_id FROM picked)) WHERE rn <= 15 - (SELECT count(*) FROM picked))")
    ctes.append("r8 AS MATERIALIZED (SELECT * FROM (SELECT window_id, 8 AS rule_no, row_number() OVER (ORDER BY net_km DESC, window_id) AS rn FROM s0 WHERE is_mid AND window_id NOT IN (SELECT window_id FROM picked UNION ALL SELECT window_id FROM r7)) WHERE rn <= 15 - (SELECT count(*) FROM picked) - (SELECT count(*) FROM r7))")
    return f"WITH {', '.join(ctes)} SELECT window_id FROM picked UNION ALL SELECT window_id FROM r7 UNION ALL SELECT window_id FROM r8"


@query("v06_picks_by_shape", "window_id:s", _shape_picks_sql())
def v06(spark, sf):
    s = shapes(spark, sf).drop("anchor", "true_track").join(examples(spark, sf).select("window_id", "err_km"), "window_id")
    return V.picks_by_shape(s)


@query("v07_spread_picks", "window_id:s net_km:d", f"""
    SELECT DISTINCT window_id, net_km FROM (
        SELECT *, row_number() OVER (ORDER BY net_km, md5('42|' || window_id)) AS rn, count(*) OVER () AS n FROM {_examples} WHERE net_km >= 10 AND path_km >= 10)
    JOIN range(0, 9) t(j) ON rn = CAST(round_even(j * (n - 1) / 8.0::DOUBLE, 0) AS BIGINT) + 1""")
def v07(spark, sf):
    return V.spread_picks(examples(spark, sf), 9, 10.0, 10.0)


_ports = ", ".join(f"('{n}', {lat}, {lon})" for n, lon, lat in PORTS["east_coast"])


@query("v08_nearest_windows", "target:s distance2:d traj_id:s start_time:t", f"""
    SELECT target, d AS distance2, traj_id, start_time FROM (
        SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, traj_id, start_time) AS rn FROM (
            SELECT p.target, l.traj_id, l.start_time, pow(l.lat - p.lat::DOUBLE, 2) + pow(l.lon - p.lon::DOUBLE, 2) AS d FROM last l, (VALUES {_ports}) p(target, lat, lon))) WHERE rn = 1""")
def v08(spark, sf):
    return V.nearest_windows(A.stored_windows(spark, sf), [(n, lat, lon) for n, lon, lat in PORTS["east_coast"]])


@query("v08_nearest_of_many", "target:s distance2:d traj_id:s start_time:t", """
    WITH p AS (SELECT traj_id AS target, arg_min(lat, timestamp)::DOUBLE AS lat, arg_min(lon, timestamp)::DOUBLE AS lon FROM segments GROUP BY traj_id)
    SELECT target, d AS distance2, traj_id, start_time FROM (
        SELECT p.target, pow(l.lat - p.lat, 2) + pow(l.lon - p.lon, 2) AS d, l.traj_id, l.start_time FROM last l, p)
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY d, traj_id, start_time) = 1""")
def v08_many(spark, sf):
    """The window that ends nearest to where each trajectory starts."""
    starts = A.segments(spark, sf).groupBy(F.col("traj_id").alias("target")).agg(
        F.min_by("lat", "timestamp").alias("lat"), F.min_by("lon", "timestamp").alias("lon")
    )
    return V.nearest_windows_of(A.stored_windows(spark, sf), starts).drop("anchor_lat", "anchor_lon")


@query("v09_thin_track", "traj_id:s timestamp:t lat:d", """
    SELECT traj_id, timestamp, lat FROM (
        SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY timestamp) - 1 AS pos, count(*) OVER (PARTITION BY traj_id) AS n FROM segments)
    WHERE pos % greatest(1, n // 10) = 0""")
def v09(spark, sf):
    return V.thin(A.stored_segments(spark, sf), 10)


@query("u01_vessel_type_lookup", "mmsi:i vessel_type_code:i vessel_class:i", "SELECT * FROM lookup")
def u01(spark, sf):
    return U.vessel_type_lookup(A.stored_segments(spark, sf))


@query("u02_attach_class", KEYS + "vessel_class:i", "SELECT window_id, coalesce(vessel_class, 0) AS vessel_class FROM win LEFT JOIN (SELECT * FROM lookup WHERE mmsi % 7 <> 0) USING (mmsi)")
def u02(spark, sf):
    return U.attach_class(_win(spark, sf), U.vessel_type_lookup(A.stored_segments(spark, sf)).filter("mmsi % 7 <> 0"))


# --- land: cells that no vessel with an even number visits count as land -----------------

RES = 0.05
LAT0, LON0 = 33.0, -76.0


def land_grid(spark, sf) -> L.LandGrid:
    box = (LAT0, 48.0, LON0, -68.0)
    n_rows, n_cols = L.grid_shape(*box, RES)
    shell = L.LandGrid(None, LAT0, LON0, RES, n_rows, n_cols)
    visited = A.points(spark, sf).filter("mmsi % 2 = 0").select(shell.row_of(F.col("lat")).alias("row"), shell.col_of(F.col("lon")).alias("col")).distinct()
    cells = L.cell_nodes(spark, *box, RES).select("row", "col").join(visited.withColumn("seen", F.lit(True)), ["row", "col"], "left")
    return L.LandGrid(cells.select("row", "col", F.col("seen").isNull().cast("tinyint").alias("land")), LAT0, LON0, RES, n_rows, n_cols)


_visited = "SELECT DISTINCT CAST(floor((lat - 33.0::DOUBLE) / 0.05::DOUBLE) AS INTEGER) AS r, CAST(floor((lon + 76.0::DOUBLE) / 0.05::DOUBLE) AS INTEGER) AS c FROM points WHERE mmsi % 2 = 0"


def land_sql(source: str, lat: str, lon: str) -> str:
    """Rows of a source with `land`: inside the raster and in no visited cell."""
    r, c = f"CAST(floor(({lat} - 33.0::DOUBLE) / 0.05::DOUBLE) AS INTEGER)", f"CAST(floor(({lon} + 76.0::DOUBLE) / 0.05::DOUBLE) AS INTEGER)"
    return f"""SELECT s.*, {r} BETWEEN 0 AND 300 AND {c} BETWEEN 0 AND 160 AND v.r IS NULL AS land
        FROM {source} s LEFT JOIN ({_visited}) v ON v.r = {r} AND v.c = {c}"""


@query("l01_land_flag", "mmsi:i timestamp:t land:b", f"SELECT mmsi, timestamp, land FROM ({land_sql('points', 's.lat', 's.lon')})")
def l01(spark, sf):
    return L.flag_land(A.points(spark, sf), land_grid(spark, sf))


_near = """(SELECT p.*, p.lat + a.d * (10.0::DOUBLE / 111.0::DOUBLE) AS nlat, p.lon + b.d * (10.0::DOUBLE / (111.0::DOUBLE * cos(radians(least(greatest(p.lat, -60.0::DOUBLE), 60.0::DOUBLE))))) AS nlon
    FROM {source} p, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d))"""
WATER_SQL = f"SELECT mmsi, timestamp, bool_or(NOT land) AS open_water FROM ({land_sql(_near.format(source='points'), 's.nlat', 's.nlon')}) GROUP BY mmsi, timestamp"


@query("l02_open_water_by_join", "mmsi:i timestamp:t open_water:b", WATER_SQL)
def l02(spark, sf):
    pts = A.points(spark, sf).select("mmsi", "timestamp", "lat", "lon")
    return L.flag_open_water(pts, land_grid(spark, sf))


@query("l02_open_water_inline", "mmsi:i timestamp:t open_water:b", WATER_SQL)
def l02_inline(spark, sf):
    grid = land_grid(spark, sf)
    lookup = L.land_lookup(grid)
    return A.points(spark, sf).withColumn("open_water", L.open_water(F.col("lat"), F.col("lon"), grid, lookup))


@query("l03_inland_points", "mmsi:i n:i inland:i", f"SELECT mmsi, count(*) AS n, sum(CAST(NOT open_water AS INTEGER)) AS inland FROM ({WATER_SQL}) GROUP BY mmsi")
def l03(spark, sf):
    return l02_inline(spark, sf).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("open_water")).cast("int")).alias("inland"))


INLAND_SQL = f"""SELECT window_id, avg(CAST(NOT water AS DOUBLE)) AS inland_fraction FROM (
    SELECT window_id, i, bool_or(NOT land) AS water FROM ({land_sql(_near.format(source='(SELECT * FROM hs WHERE i % 2 = 0)'), 's.nlat', 's.nlon')}) GROUP BY window_id, i) GROUP BY window_id"""


@query("l04_inland_fraction", KEYS + "inland_fraction:d", INLAND_SQL)
def l04(spark, sf):
    return L.inland_fraction(_win(spark, sf), land_grid(spark, sf), every=2)


@query("l01_land_flag_by_tiles", "mmsi:i timestamp:t land:b", f"SELECT mmsi, timestamp, land FROM ({land_sql('points', 's.lat', 's.lon')})")
def l01_tiles(spark, sf):
    grid = land_grid(spark, sf)
    return L.flag_land_by_tiles(A.points(spark, sf), grid, L.land_tiles(grid))


@query("l04_inland_fraction_by_tiles", KEYS + "inland_fraction:d", INLAND_SQL)
def l04_tiles(spark, sf):
    """By tiles of a raster that would be too large for a constant."""
    grid = replace(land_grid(spark, sf), n_cols=100_000)
    return L.inland_fraction_by_tiles(_win(spark, sf), grid, L.land_tiles(grid), every=2)


@query("l04_two_regions", "region:s " + KEYS + "inland_fraction:d", f"""
    SELECT region, window_id, inland_fraction FROM ({INLAND_SQL}), (VALUES ('a'), ('b')) r(region)""")
def l04_regions(spark, sf):
    """Two regions hold windows of equal trajectory and time; the raster has over 4 million cells, most of them water."""
    win, grid = _win(spark, sf), land_grid(spark, sf)
    both = win.withColumn("region", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return L.inland_fraction(both, replace(grid, n_rows=2500, n_cols=2500), every=2)


@query("l04_filter_inland", KEYS, f"SELECT window_id FROM ({INLAND_SQL}) WHERE inland_fraction <= 0.5")
def l04_filter(spark, sf):
    return L.filter_inland(_win(spark, sf), land_grid(spark, sf), every=2)


@query("l05_build_grid", "row:i col:i land:b", f"""
    SELECT row, col, land FROM ({land_sql("(SELECT a.row, b.col, 34.0::DOUBLE + a.row * 0.25::DOUBLE AS lat, -75.0::DOUBLE + b.col * 0.25::DOUBLE AS lon FROM range(0, 25) a(row), range(0, 25) b(col))", "s.lat", "s.lon")})""")
def l05(spark, sf):
    return L.build_grid(land_grid(spark, sf), 34.0, 40.0, -75.0, -69.0, 0.25).cells


def _corner(dr: int, dc: int) -> str:
    weight = ("y - r" if dr else "1 - (y - r)", "x - c" if dc else "1 - (x - c)")
    return f"(CASE WHEN v{dr}{dc}.r IS NULL AND g.r + {dr} BETWEEN 0 AND 300 AND g.c + {dc} BETWEEN 0 AND 160 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * ({weight[0].replace('r', 'g.r').replace('y', 'g.y')}) * ({weight[1].replace('c', 'g.c').replace('x', 'g.x')})"


OCCUPANCY_SQL = f"""
    SELECT g.model, avg(CASE WHEN g.y >= 0 AND g.y <= 300 AND g.x >= 0 AND g.x <= 160 THEN {" + ".join(_corner(a, b) for a in (0, 1) for b in (0, 1))} ELSE 0 END) * 0.1::DOUBLE AS land_penalty
    FROM (SELECT *, CAST(floor(y) AS INTEGER) AS r, CAST(floor(x) AS INTEGER) AS c FROM (
            SELECT model, (pred_lat - 33.0::DOUBLE) / 0.05::DOUBLE AS y, (pred_lon + 76.0::DOUBLE) / 0.05::DOUBLE AS x FROM pred)) g
    {" ".join(f"LEFT JOIN ({_visited}) v{a}{b} ON v{a}{b}.r = g.r + {a} AND v{a}{b}.c = g.c + {b}" for a in (0, 1) for b in (0, 1))}
    GROUP BY g.model"""


@query("l06_land_penalty", "model:s land_penalty:d", OCCUPANCY_SQL)
def l06(spark, sf):
    return L.land_penalty(E.to_predictions(forecasts(spark, sf)), land_grid(spark, sf), ["model"])


_kept = f"""(SELECT w.* FROM win w JOIN hm USING (window_id) JOIN ({INLAND_SQL.replace('WHERE i % 2', 'WHERE i % 6')}) g USING (window_id)
    WHERE NOT (radius <= 0.5 AND net < 1.0) AND NOT {SMART_REMOVED} AND inland_fraction <= 0.5)"""


@query("p02_training_table", KEYS + "split:s", f"WITH kept AS MATERIALIZED {_kept} {_split_sql('traj_id', 0.2, 0.1, 'kept')}")
def p02_training(spark, sf):
    cfg = jobs.TrainingConfig(smart=SMART)
    return jobs.training_table(_win(spark, sf), land_grid(spark, sf), cfg, STEP)


def _overlapping_coasts(spark, sf) -> dict[str, DataFrame]:
    """Two coasts that hold some of the same trajectories."""
    w = A.stored_windows(spark, sf)
    return {"east_coast": w.filter("mmsi % 2 = 0 OR mmsi % 7 = 0"), "gulf": w.filter("mmsi % 2 = 1")}


_inland6 = INLAND_SQL.replace("WHERE i % 2", "WHERE i % 6")
_united = f"""(SELECT window_id, r.region || ':' || w.traj_id AS traj_id, r.region AS region,
        NOT (radius <= 0.5 AND net < 1.0) AS moves, NOT (radius <= 0.5 AND net < 1.0) AND NOT {SMART_REMOVED} AS smart, inland_fraction <= 0.5 AS at_sea
    FROM win w JOIN hm USING (window_id) JOIN ({_inland6}) g USING (window_id), (VALUES ('east_coast'), ('gulf')) r(region)
    WHERE CASE WHEN r.region = 'gulf' THEN w.mmsi % 2 = 1 ELSE w.mmsi % 2 = 0 OR w.mmsi % 7 = 0 END)"""


def _label_split(table: str) -> str:
    return f"""SELECT t.*, CASE WHEN rn <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' WHEN rn <= greatest(1, floor(n * 0.2::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split
        FROM {table} t JOIN (SELECT traj_id, row_number() OVER (ORDER BY md5('42|' || traj_id)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT traj_id FROM {table})) USING (traj_id)"""


_stages = "SELECT 'combined' AS stage, split FROM labelled UNION ALL SELECT 'stationary', split FROM labelled WHERE moves UNION ALL SELECT 'smart_motion', split FROM labelled WHERE smart"


@query("p02_combine_job", "stage:s split:s windows:i", f"""
    WITH united AS MATERIALIZED {_united}, labelled AS MATERIALIZED ({_label_split('united')})
    SELECT stage, split, count(*) AS windows FROM ({_stages} UNION ALL SELECT 'inland', split FROM labelled WHERE smart AND at_sea) GROUP BY 1, 2""")
def p02_combine(spark, sf):
    cfg = jobs.TrainingConfig(smart=SMART)
    return jobs.combine_job(spark, _overlapping_coasts(spark, sf), new_path(spark, "combined"), land_grid(spark, sf), cfg, STEP, qualify_ids=True)


@query("p02_second_split", "region:s window_id:s split:s", f"""
    WITH united AS MATERIALIZED {_united}, labelled AS MATERIALIZED ({_label_split('united')}),
    train AS MATERIALIZED (SELECT region, window_id, traj_id FROM labelled WHERE split = 'train' AND smart AND at_sea)
    SELECT region, window_id, split FROM ({_label_split('train')})""")
def p02_second(spark, sf):
    """The train part filtered by land and split again, as the job writes it."""
    cfg, path = jobs.TrainingConfig(smart=SMART), new_path(spark, "combined")
    jobs.combine_job(spark, _overlapping_coasts(spark, sf), path, land_grid(spark, sf), cfg, STEP, qualify_ids=True, second_split=True)
    kept = spark.read.parquet(f"{path}/windows")
    plain = kept.withColumn("traj_id", F.regexp_replace("traj_id", "^[a-z_]+:", ""))
    return plain.select("region", "split", window_id().alias("window_id"))


@query("s14_incremental_job", KEYS, "SELECT window_id FROM win")
def s14_job(spark, sf):
    """Days in two runs of the job; the second rebuilds windows over all of them."""
    pts = A.points(spark, sf)
    days_dir, out = new_path(spark, "days"), new_path(spark, "incremental")
    first, last = _day_range(pts)
    of_days = lambda wanted: _files_of_days(pts).filter(F.col("file_day").isin(*wanted)).select(*pts.columns, "file_day")
    cfg = jobs.WindowConfig(history_hours=A.HISTORY_HOURS, future_hours=A.FUTURE_HOURS, resample_minutes=STEP)
    for start, end in ((first + dt.timedelta(days=3), first + dt.timedelta(days=5)), (first, last + dt.timedelta(days=1))):
        paths = jobs.incremental_job(spark, days_dir, out, "gulf", "30d", start, end, of_days, segment_cfg=A.SEGMENTS, window_cfg=cfg)
    return spark.read.parquet(paths["windows"]).select(window_id().alias("window_id"))


@query("w02_cap_existing_windows", KEYS, """
    SELECT window_id FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY md5('42|' || traj_id || '|' || CAST(CAST(epoch(start_time) AS BIGINT) AS VARCHAR))) AS rn FROM win)
    WHERE rn <= 5""")
def w02_existing(spark, sf):
    return cap_per_trajectory(_win(spark, sf), 5)


@query("s06_read_datasets", "region:s tag:s n:i vessels:i", """
    SELECT CASE WHEN mmsi % 3 = 0 THEN 'east_coast' ELSE 'west_coast' END AS region, CASE WHEN mmsi % 3 = 0 THEN '30d' ELSE '' END AS tag, count(*) AS n, count(DISTINCT mmsi) AS vessels
    FROM win WHERE mmsi % 3 < 2 GROUP BY 1, 2""")
def s06_read(spark, sf):
    root = new_path(spark, "datasets")
    places = ["Eastern coast/ais_east_coast_30d_long_horizon", "West Coast/ais_west_coast_long_horizon", "West Coast/ais_gulf_30d_long_horizon"]
    for i, place in enumerate(places):
        A.stored_windows(spark, sf).filter(F.col("mmsi") % 3 == i).drop("hist", "fut").write.parquet(f"{root}/{place}/model_ready_windows")
    return datasets.read_datasets(spark, root).groupBy("region", "tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels"))


# --- incremental and streaming -----------------------------------------------------------



def _day_range(pts: DataFrame) -> tuple[dt.date, dt.date]:
    r = pts.agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b")).first()
    return r["a"], r["b"]


POINTS = "timestamp:t mmsi:i lat:d lon:d sog:d cog:d heading:d vessel_type:s vessel_type_code:i"
POINTS_SQL = "SELECT *, code AS vessel_type_code FROM points"


def _files_of_days(pts: DataFrame) -> DataFrame:
    """Points with the day of the file they come in; some reports come in the next day's file, some in both."""
    h = F.pmod(F.xxhash64("mmsi", "timestamp"), F.lit(13))
    day = F.to_date("timestamp")
    in_files = F.when(h == 0, F.array(F.date_add(day, 1))).when(h == 1, F.array(day, F.date_add(day, 1))).otherwise(F.array(day))
    return pts.withColumn("file_day", F.explode(in_files))


def _ingest(spark, sf) -> DataFrame:
    """A later day is ingested before the days ahead of it, then the whole range."""
    pts = A.points(spark, sf)
    root = new_path(spark, "days")
    first, last = _day_range(pts)
    of_days = lambda wanted: _files_of_days(pts).filter(F.col("file_day").isin(*wanted))
    middle = first + (last - first) / 2
    days.ingest_days(spark, root, middle, middle + dt.timedelta(days=2), of_days)
    days.ingest_days(spark, root, first, last + dt.timedelta(days=1), of_days)
    return days.read_days(spark, root).select(pts.columns)


@query("s14_ingest_days", POINTS, POINTS_SQL)
def s14(spark, sf):
    return _ingest(spark, sf)


@query("s15_segments_of_all_days", STATS, "SELECT * FROM long_stats")
def s15(spark, sf):
    return G.trajectory_stats(G.build_segments(_ingest(spark, sf), A.SEGMENTS))


@query("s15_incremental_segments", STATS, "SELECT * FROM long_stats")
def s15_incremental(spark, sf):
    """Segments kept up to date: the middle days first, then the days ahead of and after them, by file day."""
    pts = A.points(spark, sf)
    first, last = _day_range(pts)
    filed = materialize(_files_of_days(pts), "filed-points")
    middle = first + (last - first) / 2
    state = SegmentState(spark, new_path(spark, "segment-state"), A.SEGMENTS)
    day = F.col("file_day")
    for part in (day.between(middle, middle + dt.timedelta(days=2)), day < middle, day > middle + dt.timedelta(days=2)):
        state.append(filed.filter(part).drop("file_day"))
    return G.trajectory_stats(state.segments())


@query("s02_mixed_headers", POINTS, POINTS_SQL)
def s02_mixed(spark, sf):
    """Points of one folder with old names, new names and another column order."""
    path, raw = new_path(spark, "mixed"), A.raw_reports(spark, sf)
    part = F.pmod(F.xxhash64("mmsi", "timestamp"), F.lit(3))
    shuffled = [*raw.columns[4:], *raw.columns[:4]]
    ais_csv.write_raw_csv(raw.filter(part == 0), f"{path}/old", "noaa_old")
    ais_csv.write_raw_csv(raw.filter(part == 1), f"{path}/new")
    ais_csv.write_raw_csv(raw.filter(part == 2), f"{path}/shuffled", in_order=shuffled)
    mixed, found, fmt = ais_csv.read_raw(spark, path)
    return clean(mixed, A.BOX, source=found, timestamp_format=fmt, commercial_only=False)


def _stream(spark, sf) -> DataFrame:
    """Valid points of the raw CSV files as a stream, in batches of any order of time."""
    path = new_path(spark, "landing")
    ais_csv.write_raw_csv(A.raw_reports(spark, sf).repartition(4, "timestamp"), path)
    columns = spark.read.option("header", True).csv(path).columns
    return ingest.clean_stream(spark, path, columns, A.BOX, commercial_only=False, files_per_batch=2)


@query("st1_stream_to_points", POINTS, POINTS_SQL)
def st1(spark, sf):
    out = new_path(spark, "stream-points")
    ingest.write_points(_stream(spark, sf), out, new_path(spark, "stream-ckpt")).awaitTermination()
    return ingest.read_points(spark, out)


@query("st2_stream_to_segments", STATS, "SELECT * FROM long_stats")
def st2(spark, sf):
    points_path, out = new_path(spark, "stream-points"), new_path(spark, "stream-segments")
    q = ingest.write_segments(_stream(spark, sf), points_path, out, new_path(spark, "stream-ckpt"), A.SEGMENTS)
    q.awaitTermination()
    return G.trajectory_stats(spark.read.parquet(out))


@query("st2_stream_followed_by_state", STATS, "SELECT * FROM long_stats")
def st2_state(spark, sf):
    """Segments kept by chunk of time while files of any order of time land."""
    root = new_path(spark, "stream-state")
    ingest.follow_segments(_stream(spark, sf), root, new_path(spark, "stream-ckpt"), A.SEGMENTS).awaitTermination()
    return G.trajectory_stats(SegmentState(spark, root, A.SEGMENTS).segments())
