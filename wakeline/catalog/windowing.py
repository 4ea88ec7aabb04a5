"""Resampling, windows, targets and motion, checked step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.catalog.base import hav, pct, query, turn
from wakeline.constants import FEATURES
from wakeline.functions.geo import degree_span, haversine_km, haversine_nm, mercator_x, mercator_y, planar_km
from wakeline.operators import motion as M, resample as R, windows as W
from wakeline.plans import adapter as A
from wakeline.sources import datasets
from wakeline.sources.scratch import new_path

STEP = A.STEP_MINUTES
GRID = "traj_id:s bin:i timestamp:t vessel_type:s " + " ".join(f"{f}:d" for f in FEATURES)


@query("r01_dedupe_timestamps", "traj_id:s n:i lat:d", """
    SELECT traj_id, count(*) AS n, sum(lat) AS lat FROM segments GROUP BY traj_id""")
def r01(spark, sf):
    seg = A.stored_segments(spark, sf)
    again = seg.unionByName(seg.filter("mmsi % 3 = 0").withColumn("lat", F.col("lat") + 1))
    return R.dedupe_timestamps(again).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"))


@query("r02_bin_means", "traj_id:s bin:i lat:d lon:d sog:d heading_missing:d dcog:d", "SELECT traj_id, bin, lat, lon, sog, heading_missing, dcog FROM bins")
def r02(spark, sf):
    return R.bin_means(A.stored_segments(spark, sf), STEP)


@query("r03_complete_grid", "traj_id:s n:i first_bin:i last_bin:i", """
    SELECT traj_id, max(bin) - min(bin) + 1 AS n, min(bin) AS first_bin, max(bin) AS last_bin FROM bins GROUP BY traj_id""")
def r03(spark, sf):
    return A.grid(spark, sf, 1000).groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")
    )


@query("r04_interpolate_full", GRID, "SELECT * FROM grid")
def r04(spark, sf):
    return A.grid(spark, sf)


@query("r04_interpolate_with_holes", GRID, "SELECT * FROM grid2")
def r04_holes(spark, sf):
    return A.grid(spark, sf, 2)


@query("r05_fill_metadata", "traj_id:s bin:i vessel_type:s", "SELECT traj_id, bin, vessel_type FROM grid2")
def r05(spark, sf):
    return R.resample(A.stored_segments(spark, sf), STEP, 2)


@query("r06_drop_without_position", "traj_id:s n:i", "SELECT traj_id, count(*) AS n FROM grid2 GROUP BY traj_id")
def r06(spark, sf):
    full = R.fill_gaps(R.bin_means(A.stored_segments(spark, sf), STEP), STEP, 1000)
    near = R.fill_gaps(R.bin_means(A.stored_segments(spark, sf), STEP), STEP, 2).select("traj_id", "bin", F.lit(True).alias("near"))
    blank = full.join(near, ["traj_id", "bin"], "left").withColumn("lat", F.when(F.col("near"), F.col("lat")))
    return R.drop_without_position(blank).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


KEYS = "window_id:s "


def _win(spark, sf):
    return A.stored_windows(spark, sf).withColumn("window_id", W.window_id())


STEPS = KEYS + "i:i " + " ".join(f"{f}:d" for f in FEATURES)


@query("w01_build_windows", STEPS, f"SELECT window_id, i, {', '.join(FEATURES)} FROM hs")
def w01(spark, sf):
    w = A.windows(spark, sf).select(W.window_id().alias("window_id"), F.posexplode("hist").alias("i", "x"))
    return w.select("window_id", "i", "x.*")


@query("w01_windows_over_holes", KEYS + "split_time:t target_end_time:t", """
    SELECT traj_id || '@' || CAST(CAST(epoch(start_time) AS BIGINT) AS VARCHAR) AS window_id, split_time, target_end_time FROM (
        SELECT traj_id, timestamp AS start_time, lead(timestamp, 7) OVER w AS split_time, lead(timestamp, 11) OVER w AS target_end_time
        FROM grid2 WINDOW w AS (PARTITION BY traj_id ORDER BY bin))
    WHERE target_end_time IS NOT NULL""")
def w01_holes(spark, sf):
    return A.windows(spark, sf, limit=2).withColumn("window_id", W.window_id())


@query("w01_contiguous_windows", KEYS + "target_end_time:t", """
    SELECT traj_id || '@' || CAST(CAST(epoch(start_time) AS BIGINT) AS VARCHAR) AS window_id, target_end_time FROM (
        SELECT traj_id, timestamp AS start_time, lead(timestamp, 11) OVER (PARTITION BY traj_id ORDER BY bin) AS target_end_time FROM grid2)
    WHERE epoch(target_end_time) - epoch(start_time) = 11 * 10800""")
def w01_contiguous(spark, sf):
    return A.windows(spark, sf, limit=2, require_contiguous=True).withColumn("window_id", W.window_id())


@query("w02_cap_per_trajectory", KEYS, """
    SELECT window_id FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY md5('42|' || traj_id || '|' || CAST(pos AS VARCHAR))) AS rn FROM win) WHERE rn <= 10""")
def w02(spark, sf):
    return A.windows(spark, sf, cap=10).withColumn("window_id", W.window_id())


BOXED = (35.0, 39.0, -74.0, -70.0)


@query("w03_future_in_frame", KEYS, f"""
    SELECT window_id FROM fs GROUP BY window_id
    HAVING min(lat) >= {BOXED[0]} AND max(lat) <= {BOXED[1]} AND min(lon) >= {BOXED[2]} AND max(lon) <= {BOXED[3]}""")
def w03(spark, sf):
    return W.future_in_frame(_win(spark, sf), BOXED)


@query("w04_window_metadata", KEYS + "traj_id:s mmsi:i start_time:t split_time:t target_end_time:t history_steps:i future_steps:i resample_minutes:i", """
    SELECT window_id, traj_id, mmsi, start_time, split_time, target_end_time, 8 AS history_steps, 4 AS future_steps, 180 AS resample_minutes FROM win""")
def w04(spark, sf):
    return _win(spark, sf)


@query("w05_wide_columns", KEYS + "first_lat:d last_sog:d end_lon:d", f"""
    SELECT w.window_id, f.lat AS first_lat, a.sog AS last_sog, e.lon AS end_lon FROM win w
    JOIN first_step f USING (window_id) JOIN last a USING (window_id) JOIN fs e ON e.window_id = w.window_id AND e.k = {A.N - 1}""")
def w05(spark, sf):
    wide = W.to_wide(_win(spark, sf), A.H, A.N)
    return wide.select("window_id", F.col("x_t000_lat").alias("first_lat"), F.col("x_t007_sog").alias("last_sog"), F.col("y_t003_lon").alias("end_lon"))


@query("w05_wide_round_trip", STEPS, f"SELECT window_id, i, {', '.join(FEATURES)} FROM hs")
def w05_back(spark, sf):
    path = new_path(spark, "wide")
    W.to_wide(_win(spark, sf), A.H, A.N).write.parquet(path)
    back = W.from_wide(spark.read.parquet(path))
    return back.select("window_id", F.posexplode("hist").alias("i", "x")).select("window_id", "i", "x.*")


@query("w06_window_shape", "history_steps:i future_steps:i n_windows:i", "SELECT 8 AS history_steps, 4 AS future_steps, count(*) AS n_windows FROM win")
def w06(spark, sf):
    return W.window_shape(_win(spark, sf))


@query("w07_select_hours", KEYS + "n:i total_lat:d end_lat:d", """
    SELECT window_id, count(*) AS n, sum(h.lat) AS total_lat, any_value(f.lat) AS end_lat
    FROM hs h JOIN (SELECT window_id, lat FROM fs WHERE k = 1) f USING (window_id) WHERE i >= 4 GROUP BY window_id""")
def w07(spark, sf):
    s = W.select_hours(_win(spark, sf), 12.0, 6.0, STEP)
    return s.select("window_id", F.size("hist").alias("n"), F.aggregate("hist", F.lit(0.0), lambda a, p: a + p.lat).alias("total_lat"), F.element_at("fut", -1)["lat"].alias("end_lat"))


@query("w08_horizon_position", KEYS + "lat6:d lat99:d", """
    SELECT window_id, max(CASE WHEN k = 1 THEN lat END) AS lat6, max(CASE WHEN k = 3 THEN lat END) AS lat99 FROM fs GROUP BY window_id""")
def w08(spark, sf):
    at = lambda h: F.col("fut")[W.horizon_step(h, STEP, A.N)]["lat"]
    return _win(spark, sf).select("window_id", at(6.0).alias("lat6"), at(99.0).alias("lat99"))


@query("w09_anchor", KEYS + "lat:d lon:d", "SELECT window_id, lat, lon FROM last")
def w09(spark, sf):
    return _win(spark, sf).select("window_id", W.anchor().alias("a")).select("window_id", "a.*")


def _targets(spark, sf):
    return _win(spark, sf).select("window_id", W.anchor().alias("a"), W.as_points("fut").alias("f"))


def _long(df: DataFrame, column: str) -> DataFrame:
    return df.select("window_id", F.posexplode_outer(column).alias("k", "p")).select("window_id", "k", "p.lat", "p.lon")


TARGET = KEYS + "k:i lat:d lon:d"


@query("w10_anchor_offsets", TARGET, "SELECT window_id, k, f.lat - a.lat AS lat, f.lon - a.lon AS lon FROM fs f JOIN last a USING (window_id)")
def w10(spark, sf):
    return _long(_targets(spark, sf).withColumn("o", W.anchor_offsets(F.col("f"), F.col("a"))), "o")


@query("w11_step_deltas", TARGET, """
    SELECT window_id, k, lat - coalesce(lag(lat) OVER w, alat) AS lat, lon - coalesce(lag(lon) OVER w, alon) AS lon
    FROM (SELECT f.*, a.lat AS alat, a.lon AS alon FROM fs f JOIN last a USING (window_id)) WINDOW w AS (PARTITION BY window_id ORDER BY k)""")
def w11(spark, sf):
    return _long(_targets(spark, sf).withColumn("o", W.step_deltas(F.col("f"), F.col("a"))), "o")


@query("w11_offsets_to_steps", TARGET, """
    SELECT window_id, k, lat - coalesce(lag(lat) OVER w, alat) AS lat, lon - coalesce(lag(lon) OVER w, alon) AS lon
    FROM (SELECT f.*, a.lat AS alat, a.lon AS alon FROM fs f JOIN last a USING (window_id)) WINDOW w AS (PARTITION BY window_id ORDER BY k)""")
def w11_cumulative(spark, sf):
    offsets = W.anchor_offsets(F.col("f"), F.col("a"))
    return _long(_targets(spark, sf).withColumn("o", W.offsets_to_steps(offsets)), "o")


@query("w12_steps_to_absolute", TARGET, "SELECT window_id, k, lat, lon FROM fs")
def w12(spark, sf):
    t = _targets(spark, sf)
    return _long(t.withColumn("o", W.to_absolute(W.step_deltas(F.col("f"), F.col("a")), F.col("a"), "step_delta")), "o")


@query("w12_offsets_to_absolute", TARGET, "SELECT window_id, k, lat, lon FROM fs")
def w12_offsets(spark, sf):
    t = _targets(spark, sf)
    return _long(t.withColumn("o", W.to_absolute(W.anchor_offsets(F.col("f"), F.col("a")), F.col("a"))), "o")


@query("w13_chunk_displacement", KEYS + "lat:d lon:d", "SELECT window_id, f.lat - a.lat AS lat, f.lon - a.lon AS lon FROM fs f JOIN last a USING (window_id) WHERE k = 1")
def w13(spark, sf):
    return _targets(spark, sf).select("window_id", W.displacement_at(F.col("f"), F.col("a"), 1).alias("d")).select("window_id", "d.*")


@query("w14_possible_windows", "traj_id:s windows:i", """
    SELECT traj_id, greatest(CAST(floor((duration_hours - 36.0::DOUBLE) / 3.0::DOUBLE + 1) AS BIGINT), 0) AS windows FROM long_stats""")
def w14(spark, sf):
    stats = A.stored_segments(spark, sf).groupBy("traj_id").agg(
        ((F.unix_seconds(F.max("timestamp").cast("timestamp")) - F.unix_seconds(F.min("timestamp").cast("timestamp"))) / 3600.0).alias("h")
    )
    return stats.select("traj_id", W.possible_windows(F.col("h"), 24.0, 12.0, STEP).alias("windows"))


@query("w15_rebuild_missing", "dataset:s n:i", """
    SELECT CASE WHEN mmsi % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS n FROM win GROUP BY 1""")
def w15(spark, sf):
    root = new_path(spark, "rebuild")
    w = A.stored_windows(spark, sf)
    builders = {"even": lambda: w.filter("mmsi % 2 = 0"), "odd": lambda: w.filter("mmsi % 2 = 1")}
    datasets.rebuild(spark, {"even": builders["even"]}, root)
    datasets.rebuild(spark, {"even": lambda: w.limit(0), "odd": builders["odd"]}, root)
    parts = [spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("dataset")) for n in builders]
    return parts[0].unionByName(parts[1]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("m01_haversine", KEYS + "km:d nm:d", "SELECT window_id, net AS km, net / 1.852::DOUBLE AS nm FROM hm")
def m01(spark, sf):
    w = _win(spark, sf).select("window_id", W.as_points("hist").alias("h"), W.anchor().alias("a"))
    args = (F.col("h")[0]["lat"], F.col("h")[0]["lon"], F.col("a.lat"), F.col("a.lon"))
    return w.select("window_id", haversine_km(*args).alias("km"), haversine_nm(*args).alias("nm"))


@query("m02_path_length", KEYS + "hist_km:d with_anchor_km:d", f"""
    SELECT h.window_id, h.path AS hist_km, e.full_path_km AS with_anchor_km FROM hm h JOIN ferr e ON e.window_id = h.window_id AND e.model = 'naive'""")
def m02(spark, sf):
    from wakeline.functions.series import path_km

    w = _win(spark, sf).select("window_id", W.as_points("hist").alias("h"), W.as_points("fut").alias("f"), W.anchor().alias("a"))
    return w.select("window_id", path_km(F.col("h")).alias("hist_km"), path_km(F.concat(F.array("a"), "f")).alias("with_anchor_km"))


@query("m03_history_metrics", KEYS + "history_max_radius_km:d history_displacement_km:d history_path_length_km:d history_mean_sog_kn:d", """
    SELECT window_id, radius AS history_max_radius_km, net AS history_displacement_km, path AS history_path_length_km, mean_sog AS history_mean_sog_kn FROM hm""")
def m03(spark, sf):
    return M.history_metrics(_win(spark, sf))


WHOLE_SQL = f"""
    SELECT h.window_id, greatest(h.radius, f.radius) AS max_radius_km, e.true_disp AS future_displacement_km, h.net AS history_displacement_km,
           h.path + e.full_path AS path_length_km
    FROM hm h JOIN (SELECT window_id, net_km AS true_disp, full_path_km AS full_path FROM ferr WHERE model = 'naive') e USING (window_id)
    JOIN (SELECT x.window_id, max({hav('a.lat', 'a.lon', 'x.lat', 'x.lon')}) AS radius FROM fs x JOIN last a USING (window_id) GROUP BY x.window_id) f USING (window_id)"""


@query("m04_window_metrics", KEYS + "max_radius_km:d future_displacement_km:d history_displacement_km:d path_length_km:d", WHOLE_SQL)
def m04(spark, sf):
    return M.window_metrics(_win(spark, sf))


LOOP = "CASE WHEN path > 10.0 THEN net / greatest(path, 1e-6::DOUBLE) ELSE 1.0::DOUBLE END"
SMART_SQL = f"""
    SELECT h.window_id, net AS history_full_net_km, net_i3 AS history_16h_net_km, net_i5 AS history_last_8h_net_km, path AS history_path_km,
           radius AS history_max_radius_km, {LOOP} AS history_loop_ratio, net >= 20.0 AND net_i5 < 3.0 AS arrived_then_stopped,
           f8 AS future_8h_net_km, f12 AS future_12h_net_km
    FROM hm h JOIN (
        SELECT x.window_id, max(CASE WHEN k = 2 THEN {hav('a.lat', 'a.lon', 'x.lat', 'x.lon')} END) AS f8, max(CASE WHEN k = 3 THEN {hav('a.lat', 'a.lon', 'x.lat', 'x.lon')} END) AS f12
        FROM fs x JOIN last a USING (window_id) GROUP BY x.window_id) f USING (window_id)"""


def _smart(spark, sf):
    return M.smart_metrics(_win(spark, sf), STEP)


@query("m05_smart_motion_metrics", KEYS + "history_full_net_km:d history_16h_net_km:d history_last_8h_net_km:d history_path_km:d history_max_radius_km:d history_loop_ratio:d future_8h_net_km:d future_12h_net_km:d", SMART_SQL)
def m05(spark, sf):
    return _smart(spark, sf)


@query("m06_arrived_then_stopped", KEYS + "arrived_then_stopped:b", SMART_SQL)
def m06(spark, sf):
    return _smart(spark, sf)


@query("m07_stationary_mask", KEYS + "removed:b", "SELECT window_id, radius <= 0.5 AND net < 1.0 AS removed FROM hm")
def m07(spark, sf):
    return M.history_metrics(_win(spark, sf)).withColumn("removed", M.is_stationary())


STRICT = M.StationaryConfig(require_displacement_km=2.0, require_path_km=1.5, max_loop_ratio=0.5, min_loop_path_km=1.0)


@query("m07_stationary_mask_strict", KEYS + "removed:b", """
    SELECT window_id, (radius <= 0.5 AND net < 1.0) OR net < 2.0 OR path < 1.5 OR (path > 1.0 AND net / greatest(path, 1e-6::DOUBLE) < 0.5) AS removed FROM hm""")
def m07_strict(spark, sf):
    return M.history_metrics(_win(spark, sf)).withColumn("removed", M.is_stationary(STRICT))


@query("m07_stationary_mask_with_future", KEYS + "removed:b", f"SELECT window_id, max_radius_km <= 0.5 AND future_displacement_km < 1.0 AS removed FROM ({WHOLE_SQL})")
def m07_future(spark, sf):
    cfg = M.StationaryConfig(history_only=False)
    return M.window_metrics(_win(spark, sf)).withColumn("removed", M.is_stationary(cfg))


# Thresholds that split the small loops of the check data; the defaults belong to 10-minute grids.
SMART = M.SmartMotionConfig(min_16h_net_km=4.0, min_last_8h_net_km=1.5, max_loop_ratio=0.98, min_loop_path_km=2.0)
SMART_REMOVED = "(net_i3 < 4.0 OR net_i5 < 1.5 OR (path > 2.0 AND {loop} < 0.98 AND NOT (path >= 50.0 OR radius >= 20.0)))".format(loop=LOOP)


@query("m08_smart_motion_mask", KEYS + "removed:b", f"SELECT window_id, {SMART_REMOVED} AS removed FROM hm")
def m08(spark, sf):
    return _smart(spark, sf).withColumn("removed", M.fails_smart_motion(SMART))


@query("m09_filter_stationary", KEYS, "SELECT window_id FROM hm WHERE NOT (radius <= 0.5 AND net < 1.0)")
def m09(spark, sf):
    return M.filter_stationary(_win(spark, sf))[0]


@query("m09_filter_smart_motion", KEYS, f"SELECT window_id FROM hm WHERE NOT {SMART_REMOVED}")
def m09_smart(spark, sf):
    return M.filter_smart_motion(_win(spark, sf), SMART, STEP)


@query("m09_filter_report", "windows_total:i windows_removed:i windows_kept:i removed_fraction:d kept_fraction:d median_max_radius_km_removed:d median_max_radius_km_kept:d", f"""
    SELECT count(*) AS windows_total, sum(CAST(r AS INTEGER)) AS windows_removed, sum(CAST(NOT r AS INTEGER)) AS windows_kept,
           avg(CAST(r AS DOUBLE)) AS removed_fraction, avg(CAST(NOT r AS DOUBLE)) AS kept_fraction,
           coalesce({pct('radius', 0.5, 'r')}, 0) AS median_max_radius_km_removed, coalesce({pct('radius', 0.5, 'NOT r')}, 0) AS median_max_radius_km_kept
    FROM (SELECT radius, radius <= 0.5 AND net < 1.0 AS r FROM hm)""")
def m09_report(spark, sf):
    return M.filter_stationary(_win(spark, sf))[1]


@query("m10_reject_reason", "reason:s n:i", f"""
    SELECT CASE WHEN r = '' THEN '?' ELSE r END AS reason, count(*) AS n FROM (
        SELECT concat_ws('+', CASE WHEN net_i3 < 4.0 THEN '16h<4km' END, CASE WHEN net_i5 < 1.5 THEN 'last8h<1.5km' END,
               CASE WHEN path > 2.0 AND {LOOP} < 0.98 AND NOT (path >= 50.0 OR radius >= 20.0) THEN 'local_loop' END) AS r FROM hm) GROUP BY 1""")
def m10(spark, sf):
    return _smart(spark, sf).groupBy(M.reject_reason(SMART).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("m11_maneuver_score", KEYS + "score:d", "SELECT window_id, score FROM buckets")
def m11(spark, sf):
    return _win(spark, sf).withColumn("score", M.maneuver_score())


@query("m12_motion_buckets", KEYS + "straight:b maneuver:b anchored:b other:b mean_sog:d max_dcog:d", "SELECT * FROM buckets")
def m12(spark, sf):
    return M.motion_buckets(_win(spark, sf))


FEAT_SQL = """
    SELECT window_id, mean_sog, std_sog, mean_dcog AS maneuver_mean_abs_dcog, max_dcog AS max_abs_dcog, mean_dsog AS accel_mean_abs_dsog,
           path AS path_km_24h, net AS net_disp_km_24h, least(net / greatest(path, 1e-3::DOUBLE), 1.0::DOUBLE) AS straightness,
           abs(alat - flat) AS abs_dlat_24h, abs(alon - flon) AS abs_dlon_24h, alat AS anchor_lat, alon AS anchor_lon FROM hm"""


@query("m13_descriptive_features", KEYS + " ".join(f"{f}:d" for f in M.DESCRIPTIVE), FEAT_SQL)
def m13(spark, sf):
    return M.descriptive_features(_win(spark, sf))


BEARING = "degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
SHAPE_SQL = f"""
    SELECT window_id, net_km, path_km, directness, cross_track_km, turn_deg,
           (1 - greatest(least(directness, 1.0::DOUBLE), 0.0::DOUBLE)) * ln(1 + cross_track_km) * ln(1 + turn_deg) AS maneuver_score
    FROM (
        SELECT e.window_id, net_km, full_path_km AS path_km, net_km / greatest(full_path_km, 1e-6::DOUBLE) AS directness, c.cross_track_km, t.turn_deg
        FROM (SELECT * FROM ferr WHERE model = 'naive') e
        JOIN (
            SELECT window_id, max(abs(ee * pn - en * pe) / (sqrt(ee * ee + en * en) + 1e-9::DOUBLE)) AS cross_track_km FROM (
                SELECT f.window_id, (z.lon - a.lon) * 111.32::DOUBLE * cos(radians(a.lat)) AS ee, (z.lat - a.lat) * 111.32::DOUBLE AS en,
                       (f.lon - a.lon) * 111.32::DOUBLE * cos(radians(a.lat)) AS pe, (f.lat - a.lat) * 111.32::DOUBLE AS pn
                FROM fs f JOIN last a USING (window_id) JOIN fs z ON z.window_id = f.window_id AND z.k = {A.N - 1}
            ) GROUP BY window_id) c USING (window_id)
        JOIN (
            SELECT window_id, coalesce(sum(abs({turn('br', 'pbr')})), 0) AS turn_deg FROM (
                SELECT *, lag(br) OVER (PARTITION BY window_id ORDER BY q) AS pbr FROM (
                    SELECT window_id, q, {BEARING.format(a='plat', b='plon', c='lat', d='lon')} AS br FROM (
                        SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM (
                            SELECT window_id, k + 1 AS q, lat, lon FROM fs UNION ALL SELECT window_id, 0 AS q, lat, lon FROM last)
                        WINDOW w AS (PARTITION BY window_id ORDER BY q)
                    ) WHERE plat IS NOT NULL
                )
            ) GROUP BY window_id) t USING (window_id)
    )"""


def shapes(spark, sf) -> DataFrame:
    w = _win(spark, sf).select("window_id", W.anchor().alias("anchor"), W.as_points("fut").alias("true_track"))
    return M.track_shape(w, 1)


@query("m14_track_shape", KEYS + "net_km:d path_km:d directness:d cross_track_km:d turn_deg:d maneuver_score:d", SHAPE_SQL)
def m14(spark, sf):
    return shapes(spark, sf)


@query("m15_planar_distance", "traj_id:s km:d", """
    SELECT traj_id, sum(sqrt(pow(dlat * 111.322::DOUBLE, 2) + pow(dlon * 111.322::DOUBLE * cos(radians(lat)), 2))) AS km FROM segments GROUP BY traj_id""")
def m15(spark, sf):
    return A.stored_segments(spark, sf).groupBy("traj_id").agg(F.sum(planar_km(F.col("dlat"), F.col("dlon"), F.col("lat"))).alias("km"))


@query("m16_difficulty_weight", KEYS + "weight:d", """
    SELECT window_id, CAST(1 + score / ((SELECT quantile_cont(score, 0.5) FROM buckets) + 1e-6::DOUBLE) AS FLOAT) AS weight FROM buckets""")
def m16(spark, sf):
    return M.difficulty_weights(_win(spark, sf))


@query("m17_padded_extent", "south:d north:d west:d east:d dlat:d dlon:d", """
    SELECT a - (b - a) * 0.02::DOUBLE AS south, b + (b - a) * 0.02::DOUBLE AS north, c - (d - c) * 0.02::DOUBLE AS west, d + (d - c) * 0.02::DOUBLE AS east,
           25.0::DOUBLE / 111.0::DOUBLE AS dlat, 25.0::DOUBLE / greatest(111.0::DOUBLE * cos(radians((a + b) / 2)), 1e-6::DOUBLE) AS dlon
    FROM (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM points)""")
def m17(spark, sf):
    ext = M.padded_extent(A.points(spark, sf))
    dlat, dlon = degree_span(F.lit(25.0), (F.col("south") + F.col("north")) / 2)
    return ext.withColumn("dlat", dlat).withColumn("dlon", dlon)


@query("m18_web_mercator", "traj_id:s x:d y:d", """
    SELECT traj_id, avg(6378137.0::DOUBLE * radians(lon)) / 1000 AS x, avg(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2))) / 1000 AS y FROM segments GROUP BY traj_id""")
def m18(spark, sf):
    return A.stored_segments(spark, sf).groupBy("traj_id").agg(
        (F.avg(mercator_x(F.col("lon"))) / 1000).alias("x"), (F.avg(mercator_y(F.col("lat"))) / 1000).alias("y")
    )




@query("s06_discover_datasets", "coast:s region:s tag:s n_rows:i keep:b", """
    SELECT * FROM (
        SELECT 'Eastern coast' AS coast, 'east_coast' AS region, '30d' AS tag, count(*) AS n_rows, TRUE AS keep FROM win WHERE mmsi % 4 = 0
        UNION ALL SELECT 'Eastern coast', 'west_coast', '30d', count(*), FALSE FROM win WHERE mmsi % 4 = 1
        UNION ALL SELECT 'West Coast', 'west_coast', '1d', count(*), FALSE FROM win WHERE mmsi % 4 = 2
        UNION ALL SELECT 'West Coast', 'west_coast', '', count(*), TRUE FROM win WHERE mmsi % 4 = 3)""")
def s06(spark, sf):
    root = new_path(spark, "datasets")
    places = ["Eastern coast/ais_east_coast_30d_long_horizon", "Eastern coast/ais_west_coast_30d_long_horizon",
              "West Coast/ais_west_coast_1d_long_horizon", "West Coast/ais_west_coast_long_horizon"]
    for i, place in enumerate(places):
        A.stored_windows(spark, sf).filter(F.col("mmsi") % 4 == i).drop("hist", "fut").write.parquet(f"{root}/{place}/model_ready_windows")
    return datasets.list_datasets(spark, root)


@query("s16_check_parameters", "source_file:s n_windows:i min_history_steps:i max_history_steps:i min_future_steps:i max_future_steps:i mismatch:b", """
    SELECT 'group' || CAST(mmsi % 3 AS VARCHAR) AS source_file, count(*) AS n_windows, min(h) AS min_history_steps, max(h) AS max_history_steps,
           4 AS min_future_steps, 4 AS max_future_steps, NOT (min(h) = 8 AND max(h) = 8) AS mismatch
    FROM (SELECT *, CASE WHEN mmsi % 3 = 1 AND mmsi % 2 = 0 THEN 6 ELSE 8 END AS h FROM win) GROUP BY 1""")
def s16(spark, sf):
    w = A.stored_windows(spark, sf).withColumn("source_file", F.concat(F.lit("group"), F.col("mmsi") % 3)).withColumn(
        "history_steps", F.when((F.col("mmsi") % 3 == 1) & (F.col("mmsi") % 2 == 0), 6).otherwise(F.col("history_steps"))
    )
    return W.check_parameters(w, A.H, A.N)
