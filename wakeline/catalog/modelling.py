"""Splits, samples, baselines and evaluation over the stored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.catalog.base import hav, pct, query
from wakeline.catalog.windowing import _win
from wakeline.constants import FEATURES
from wakeline.functions.geo import haversine_km
from wakeline.functions.ranking import percentile_columns
from wakeline.operators import baselines as B, evaluate as E, motion as M, split as P, windows as W
from wakeline.plans import adapter as A
from wakeline.sources import datasets, reports
from wakeline.sources.scratch import new_path

STEP = A.STEP_MINUTES
KEYS = "window_id:s "
HASH = "md5('42|' || traj_id || '|' || CAST(start_time AS VARCHAR))"
IDS = ("traj_id", "start_time")
MODELS = {"naive": B.predictor("naive"), "kinematic": B.predictor("kinematic", STEP)}


def _split_sql(group: str, test: float, val: float, source: str = "win") -> str:
    return f"""
        SELECT w.window_id, w.traj_id, w.start_time, w.mmsi, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
        FROM {source} w JOIN (
            SELECT {group} AS g, row_number() OVER (ORDER BY md5('42|' || CAST({group} AS VARCHAR))) AS rn,
                   greatest(1, CAST(floor(count(*) OVER () * {test}::DOUBLE) AS BIGINT)) AS n_test,
                   greatest(1, CAST(floor(count(*) OVER () * {val}::DOUBLE) AS BIGINT)) AS n_val
            FROM (SELECT DISTINCT {group} FROM {source})) s ON s.g = w.{group}"""


@query("p01_split_by_trajectory", KEYS + "split:s", _split_sql("traj_id", 0.2, 0.1))
def p01(spark, sf):
    return P.split_groups(_win(spark, sf))


@query("p01_split_by_vessel", KEYS + "split:s", _split_sql("mmsi", 0.25, 0.15))
def p01_vessel(spark, sf):
    return P.split_groups(_win(spark, sf), by="mmsi", test_fraction=0.25, val_fraction=0.15)


@query("p02_unite_coasts", "region:s source_file:s split:s n:i", f"""
    SELECT CASE WHEN mmsi % 2 = 0 THEN 'east_coast' ELSE 'gulf' END AS region, CASE WHEN mmsi % 2 = 0 THEN 'a' ELSE 'b' END AS source_file, split, count(*) AS n
    FROM ({_split_sql("traj_id", 0.1, 0.1)}) GROUP BY ALL""")
def p02(spark, sf):
    w = A.stored_windows(spark, sf)
    both = datasets.unite_coasts({
        "east_coast": w.filter("mmsi % 2 = 0").withColumn("source_file", F.lit("a")),
        "gulf": w.filter("mmsi % 2 = 1").withColumn("source_file", F.lit("b")),
    })
    path = new_path(spark, "combined")
    P.split_groups(both, test_fraction=0.1, val_fraction=0.1, always_val=True).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("region", "source_file", "split").agg(F.count(F.lit(1)).alias("n"))


@query("p03_sample_exact", KEYS, f"SELECT window_id FROM win ORDER BY {HASH} LIMIT 500")
def p03(spark, sf):
    return P.sample_exact(_win(spark, sf), 500, IDS)


@query("p03_sample_fraction", KEYS, f"SELECT window_id FROM win WHERE substr({HASH}, 1, 12) <= '{int(0.05 * 16**12):012x}'")
def p03_fraction(spark, sf):
    return P.sample_fraction(_win(spark, sf), 0.05, IDS)


@query("p04_sample_blocks", KEYS, """
    SELECT window_id FROM win WHERE CAST(CAST(start_time AS DATE) AS VARCHAR) IN (
        SELECT b FROM (
            SELECT b, row_number() OVER (ORDER BY md5('42|' || b)) AS rn, greatest(1, ceil(count(*) OVER () * least(1.0::DOUBLE, 2000 / (sum(c) OVER ())::DOUBLE))) AS k
            FROM (SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS b, count(*) AS c FROM win GROUP BY 1)) WHERE rn <= k)""")
def p04(spark, sf):
    return P.sample_blocks(_win(spark, sf).withColumn("day", F.to_date("start_time").cast("string")), "day", 2000)


BIASED_SQL = f"""
    SELECT window_id FROM (
        SELECT *, row_number() OVER (ORDER BY NOT chosen, h) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h) <= CASE WHEN pool THEN 150 ELSE 350 END AS chosen FROM (
                SELECT window_id, {HASH} AS h, row_number() OVER (ORDER BY -score, {HASH}) <= 600 AS pool FROM buckets))) WHERE place <= 500"""


@query("p05_sample_maneuver_biased", KEYS, BIASED_SQL)
def p05(spark, sf):
    return P.sample_maneuver_biased(_win(spark, sf), 500)


STRATIFIED = """
    SELECT window_id FROM (
        SELECT *, row_number() OVER (ORDER BY NOT chosen, h) AS place FROM (
            SELECT *, (straight OR other) AND row_number() OVER (PARTITION BY straight, other ORDER BY h) <= {quota} AS chosen FROM (
                SELECT *, {hash} AS h FROM {source}))) WHERE place <= {n}"""


@query("p06_sample_motion_stratified", KEYS, STRATIFIED.format(quota=300, n=2000, hash=HASH, source="buckets"))
def p06(spark, sf):
    return P.sample_motion_stratified(_win(spark, sf), 2000)


@query("p07_split_then_sample", KEYS + "split:s", f"""
    WITH sp AS ({_split_sql("traj_id", 0.2, 0.1)})
    SELECT window_id, split FROM sp WHERE split <> 'train'
    UNION ALL SELECT window_id, split FROM (SELECT * FROM sp WHERE split = 'train' ORDER BY {HASH} LIMIT 700)""")
def p07(spark, sf):
    return P.split_then_sample(_win(spark, sf), 700)


@query("p08_draw_report", "sample_size:i n_straight:i n_maneuver:i n_anchored:i n_other:i median_maneuver_score:d p90_maneuver_score:d", f"""
    SELECT count(*) AS sample_size, sum(CAST(straight AS INTEGER)) AS n_straight, sum(CAST(maneuver AS INTEGER)) AS n_maneuver,
           sum(CAST(anchored AS INTEGER)) AS n_anchored, sum(CAST(other AS INTEGER)) AS n_other,
           {pct('score', 0.5)} AS median_maneuver_score, {pct('score', 0.9)} AS p90_maneuver_score
    FROM buckets WHERE window_id IN ({BIASED_SQL})""")
def p08(spark, sf):
    return P.draw_report(P.sample_maneuver_biased(_win(spark, sf), 500), percentile_columns)


_scaled = ", ".join(
    f"CAST((h.{f} - m.mean_{f}) / (CASE WHEN m.scale_{f} = 0 THEN 1 ELSE m.scale_{f} END) AS FLOAT) AS {f}" for f in FEATURES
)
_scaler = ", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS scale_{f}" for f in FEATURES)
# The split follows vessel parity here so that the check needs no hash order.


@query("p09_scaler", " ".join(f"mean_{f}:d scale_{f}:d" for f in FEATURES), f"SELECT {_scaler} FROM hs WHERE mmsi % 2 = 0")
def p09(spark, sf):
    return P.fit_scaler(_win(spark, sf).filter("mmsi % 2 = 0"))


@query("p09_apply_scaler", KEYS + "i:i " + " ".join(f"{f}:d" for f in ("lat", "sog", "dcog", "v_east_kmh")), f"""
    SELECT window_id, i, round(lat, 4) AS lat, round(sog, 4) AS sog, round(dcog, 4) AS dcog, round(v_east_kmh, 4) AS v_east_kmh
    FROM (SELECT h.window_id, h.mmsi, h.i, {_scaled} FROM hs h, (SELECT {_scaler} FROM hs WHERE mmsi % 2 = 0) m) WHERE mmsi % 2 = 1""")
def p09_apply(spark, sf):
    w = _win(spark, sf)
    scaled = P.apply_scaler(w.filter("mmsi % 2 = 1"), P.fit_scaler(w.filter("mmsi % 2 = 0")))
    steps = scaled.select("window_id", F.posexplode("hist").alias("i", "x"))
    return steps.select("window_id", "i", *[F.round(F.col(f"x.{f}").cast("double"), 4).alias(f) for f in ("lat", "sog", "dcog", "v_east_kmh")])


@query("p10_audit_draw", KEYS + "removed:b", f"""
    SELECT window_id, removed FROM (
        SELECT *, row_number() OVER (PARTITION BY removed ORDER BY {HASH}) AS rn FROM (SELECT *, radius <= 0.5 AND net < 1.0 AS removed FROM hm))
    WHERE rn <= CASE WHEN removed THEN 11 ELSE 10 END""")
def p10(spark, sf):
    return P.audit_draw(M.history_metrics(_win(spark, sf)).withColumn("removed", M.is_stationary()), "removed", 21, IDS)


# --- baselines -------------------------------------------------------------------------


def forecasts(spark, sf, **kw) -> DataFrame:
    return B.forecasts(A.stored_windows(spark, sf), MODELS, A.N, **kw)


STEPWISE = KEYS + "step:i pred_lat:d pred_lon:d"


def _model_steps(spark, sf, model: str) -> DataFrame:
    one = B.forecasts(A.stored_windows(spark, sf), {model: MODELS[model]}, A.N)
    return E.to_predictions(one)


@query("b01_naive", STEPWISE, "SELECT * FROM pred WHERE model = 'naive'")
def b01(spark, sf):
    return _model_steps(spark, sf, "naive")


@query("b02_kinematic", STEPWISE, "SELECT * FROM pred WHERE model = 'kinematic'")
def b02(spark, sf):
    return _model_steps(spark, sf, "kinematic")


KIN_REF = """SELECT f.window_id, f.k AS step, f.lat AS true_lat, f.lon AS true_lon,
           a.lat + a.sog * 1.852::DOUBLE * a.cog_cos * 3.0::DOUBLE / 111.322::DOUBLE * (f.k + 1) AS pred_lat,
           a.lon + a.sog * 1.852::DOUBLE * a.cog_sin * 3.0::DOUBLE / (111.322::DOUBLE * greatest(cos(radians(a.lat)), 1e-3::DOUBLE)) * (f.k + 1) AS pred_lon
    FROM fs f JOIN last a USING (window_id)"""


@query("b02_kinematic_as_published", STEPWISE, KIN_REF)
def b02_published(spark, sf):
    model = {"kinematic": B.predictor("kinematic", STEP, "as_reference")}
    return E.to_predictions(B.forecasts(A.stored_windows(spark, sf), model, A.N))


@query("b03_position_at_horizon", KEYS + "naive_lat:d naive_lon:d kin_lat:d kin_lon:d", """
    SELECT window_id, max(CASE WHEN model = 'naive' THEN pred_lat END) AS naive_lat, max(CASE WHEN model = 'naive' THEN pred_lon END) AS naive_lon,
           max(CASE WHEN model = 'kinematic' THEN pred_lat END) AS kin_lat, max(CASE WHEN model = 'kinematic' THEN pred_lon END) AS kin_lon
    FROM pred WHERE step = 1 GROUP BY window_id""")
def b03(spark, sf):
    step = W.horizon_step(6.0, STEP, A.N)
    w = _win(spark, sf).withColumn("a", W.anchor())
    at = lambda m: B.baseline_at(F.col("hist"), F.col("a"), step, MODELS[m])
    return w.select("window_id", at("naive").alias("n"), at("kinematic").alias("k")).select(
        "window_id", F.col("n.lat").alias("naive_lat"), F.col("n.lon").alias("naive_lon"), F.col("k.lat").alias("kin_lat"), F.col("k.lon").alias("kin_lon")
    )


@query("b04_step_and_chunk_displacement", KEYS + "k:i step_lat:d step_lon:d chunk_lat:d chunk_lon:d", """
    SELECT window_id, k, a.dlat AS step_lat, a.dlon AS step_lon, a.dlat * 2 AS chunk_lat, a.dlon * 2 AS chunk_lon FROM fs JOIN last a USING (window_id)""")
def b04(spark, sf):
    steps = B.baseline_step_deltas(F.col("hist"), A.N, MODELS["naive"])
    chunk = B.baseline_displacement(F.col("hist"), 1, MODELS["naive"])
    w = _win(spark, sf).select("window_id", F.posexplode_outer(steps).alias("k", "s"), chunk.alias("c"))
    return w.select("window_id", "k", F.col("s.lat").alias("step_lat"), F.col("s.lon").alias("step_lon"), F.col("c.lat").alias("chunk_lat"), F.col("c.lon").alias("chunk_lon"))


@query("b07_residual_forecast", STEPWISE, """
    SELECT window_id, step, pred_lat + (true_lat - pred_lat) / 2 AS pred_lat, pred_lon + (true_lon - pred_lon) / 2 AS pred_lon FROM pred WHERE model = 'naive'""")
def b07(spark, sf):
    half = F.zip_with("true_track", "pred_track", lambda t, p: F.struct(((t.lat - p.lat) / 2).alias("lat"), ((t.lon - p.lon) / 2).alias("lon")))
    corrections = forecasts(spark, sf).filter("model = 'naive'").select("window_id", half.alias("correction"))
    out = B.apply_correction(A.stored_windows(spark, sf), corrections, A.N, MODELS["naive"])
    steps = out.select("window_id", F.posexplode_outer("pred_track").alias("step", "p"))
    return steps.select("window_id", "step", F.col("p.lat").alias("pred_lat"), F.col("p.lon").alias("pred_lon"))


def _rolled(spark, sf, model: str) -> DataFrame:
    out = B.roll_forward(_win(spark, sf), n_chunks=2, steps_per_chunk=2, step_minutes=STEP, step_of=MODELS[model])
    steps = out.select("window_id", F.posexplode_outer("pred_track").alias("step", "p"))
    return steps.select("window_id", "step", F.round("p.lat", 4).alias("pred_lat"), F.round("p.lon", 4).alias("pred_lon"))


@query("b05_roll_forward_naive", STEPWISE, """
    WITH c1 AS (SELECT window_id, lat, lon, dlat * 2 AS mlat, dlon * 2 AS mlon FROM last),
    c2 AS (SELECT *, CAST(CAST((lat + mlat) - (lat + mlat * 0.5::DOUBLE) AS FLOAT) AS DOUBLE) * 2 AS nlat,
                  CAST(CAST((lon + mlon) - (lon + mlon * 0.5::DOUBLE) AS FLOAT) AS DOUBLE) * 2 AS nlon FROM c1)
    SELECT window_id, k AS step,
           round(CASE WHEN k < 2 THEN lat + mlat * ((k + 1) / 2.0::DOUBLE) ELSE lat + mlat + nlat * ((k - 1) / 2.0::DOUBLE) END, 4) AS pred_lat,
           round(CASE WHEN k < 2 THEN lon + mlon * ((k + 1) / 2.0::DOUBLE) ELSE lon + mlon + nlon * ((k - 1) / 2.0::DOUBLE) END, 4) AS pred_lon
    FROM c2, (VALUES (0), (1), (2), (3)) v(k)""")
def b05(spark, sf):
    return _rolled(spark, sf, "naive")


_unit = "sqrt(pow({dlat} * 111.322::DOUBLE, 2) + pow({dlon} * 111.322::DOUBLE * cos(radians({lat})), 2)) / 3.0::DOUBLE"


@query("b05_roll_forward_kinematic", STEPWISE, f"""
    WITH c1 AS (
        SELECT window_id, lat, lon, sog * cog_cos * 3.0::DOUBLE / 111.322::DOUBLE * 2 AS mlat,
               sog * cog_sin * 3.0::DOUBLE / (111.322::DOUBLE * greatest(cos(radians(lat)), 1e-3::DOUBLE)) * 2 AS mlon FROM last),
    c2 AS (
        SELECT *, CAST(CAST({_unit.format(dlat='d1', dlon='d2', lat='elat')} AS FLOAT) AS DOUBLE) AS sog2,
               CAST(CAST(cos(atan2(d2 * cos(radians(elat)), d1)) AS FLOAT) AS DOUBLE) AS cos2, CAST(CAST(sin(atan2(d2 * cos(radians(elat)), d1)) AS FLOAT) AS DOUBLE) AS sin2,
               CAST(CAST(elat AS FLOAT) AS DOUBLE) AS flat2
        FROM (SELECT *, lat + mlat AS elat, (lat + mlat) - (lat + mlat * 0.5::DOUBLE) AS d1, (lon + mlon) - (lon + mlon * 0.5::DOUBLE) AS d2 FROM c1)),
    c3 AS (
        SELECT *, sog2 * cos2 * 3.0::DOUBLE / 111.322::DOUBLE * 2 AS nlat,
               sog2 * sin2 * 3.0::DOUBLE / (111.322::DOUBLE * greatest(cos(radians(flat2)), 1e-3::DOUBLE)) * 2 AS nlon FROM c2)
    SELECT window_id, k AS step,
           round(CASE WHEN k < 2 THEN lat + mlat * ((k + 1) / 2.0::DOUBLE) ELSE lat + mlat + nlat * ((k - 1) / 2.0::DOUBLE) END, 4) AS pred_lat,
           round(CASE WHEN k < 2 THEN lon + mlon * ((k + 1) / 2.0::DOUBLE) ELSE lon + mlon + nlon * ((k - 1) / 2.0::DOUBLE) END, 4) AS pred_lon
    FROM c3, (VALUES (0), (1), (2), (3)) v(k)""")
def b05_kinematic(spark, sf):
    return _rolled(spark, sf, "kinematic")


def _regression(spark, sf, keep: tuple[str, ...] = ()) -> DataFrame:
    return B.fit_horizon_regression(A.stored_windows(spark, sf), 12.0, STEP, A.N, F.col("mmsi") % 5 != 4, keep)


@query("b06_horizon_regression", "window_id:s is_train:b true_lat:d true_lon:d pred_lat:d pred_lon:d error_km:d")
def b06(spark, sf):
    """Every window's forecast at the horizon and its error; the fit reads training windows only."""
    return _regression(spark, sf).withColumn("error_km", haversine_km(*map(F.col, ("true_lat", "true_lon", "pred_lat", "pred_lon"))))


@query("b06_regression_invariants", "target:s n_train:i n_rest:i train_mean_residual:d largest_moment:d", """
    SELECT target, count(*) FILTER (WHERE mmsi % 5 <> 4) AS n_train, count(*) FILTER (WHERE mmsi % 5 = 4) AS n_rest,
           0.0::DOUBLE AS train_mean_residual, 0.0::DOUBLE AS largest_moment
    FROM win, (VALUES ('lat'), ('lon')) t(target) GROUP BY target""")
def b06_invariants(spark, sf):
    """The fit solves its normal equations: on training rows the residual, and its product with each feature, average to 0."""
    return _fit_invariants(_regression(spark, sf, ("hist",)))


def _fit_invariants(out: DataFrame) -> DataFrame:
    """Per target of a fit with its histories: rows, mean residual and the largest moment, in one pass over the steps."""
    targets = ("lat", "lon")
    both = out.withColumns({f"_{t}": F.col(f"true_{t}") - F.col(f"pred_{t}") for t in targets})
    steps = both.filter("is_train").select(F.posexplode("hist").alias("k", "s"), *[f"_{t}" for t in targets])
    values = [F.col(f"s.{f}").cast("double") for f in FEATURES]
    moment = lambda t, v: F.abs(F.avg(F.col(f"_{t}") * v)) / (F.lit(1.0) + F.avg(F.abs(v)))
    largest = steps.groupBy("k").agg(*[F.greatest(*[moment(t, v) for v in values]).alias(t) for t in targets])
    largest = largest.agg(*[F.round(F.max(t), 2).alias(f"moment_{t}") for t in targets])
    found = both.agg(
        F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_rest"),
        *[F.abs(F.round(F.avg(F.when(F.col("is_train"), F.col(f"_{t}"))), 5)).alias(f"mean_{t}") for t in targets],
    ).crossJoin(F.broadcast(largest))
    row = lambda t: F.struct(F.lit(t).alias("target"), F.col(f"mean_{t}").alias("train_mean_residual"), F.col(f"moment_{t}").alias("largest_moment"))
    return found.select("n_train", "n_rest", F.inline(F.array(*[row(t) for t in targets])))


# --- evaluation ------------------------------------------------------------------------


def errors(spark, sf) -> DataFrame:
    return E.with_errors(forecasts(spark, sf))


def final_sql(by: str, source: str) -> str:
    q = lambda c, p: pct(c, p)
    return f"""
        SELECT *, mean_error_km / 1.852::DOUBLE AS mean_error_nm, median_error_km / 1.852::DOUBLE AS median_error_nm,
               p90_error_km / 1.852::DOUBLE AS p90_error_nm, p95_error_km / 1.852::DOUBLE AS p95_error_nm
        FROM (
            SELECT {by}, count(*) AS n, avg(abs(true_lat - pred_lat)) AS mae_lat, avg(abs(true_lon - pred_lon)) AS mae_lon,
                   sqrt(avg(pow(true_lat - pred_lat, 2))) AS rmse_lat, sqrt(avg(pow(true_lon - pred_lon, 2))) AS rmse_lon,
                   1 - sum(pow(true_lat - pred_lat, 2)) / nullif(var_pop(true_lat) * count(*), 0) AS r2_lat,
                   1 - sum(pow(true_lon - pred_lon, 2)) / nullif(var_pop(true_lon) * count(*), 0) AS r2_lon,
                   avg(fde_km) AS mean_error_km, {q('fde_km', 0.5)} AS median_error_km, {q('fde_km', 0.9)} AS p90_error_km, {q('fde_km', 0.95)} AS p95_error_km,
                   avg(nfde) AS mean_nfde, {q('nfde', 0.5)} AS median_nfde, {q('nfde', 0.9)} AS p90_nfde, avg(displacement_km) AS mean_future_displacement_km
            FROM {source} GROUP BY {by})"""


FINAL = "n:i mae_lat:d mae_lon:d rmse_lat:d rmse_lon:d r2_lat:d r2_lon:d mean_error_km:d median_error_km:d p90_error_km:d p95_error_km:d mean_error_nm:d median_error_nm:d p90_error_nm:d p95_error_nm:d"


@query("e01_final_position", "model:s " + FINAL, final_sql("model", "ferr"))
def e01(spark, sf):
    return E.final_position_metrics(errors(spark, sf))


@query("e02_normalised_fde", "model:s mean_nfde:d median_nfde:d p90_nfde:d mean_future_displacement_km:d", final_sql("model", "ferr"))
def e02(spark, sf):
    return E.final_position_metrics(errors(spark, sf))


TRACK = "model:s n:i mean_ade_km:d median_step_error_km:d median_window_ade_km:d final_step_mean_error_km:d mean_nade:d median_nade:d p90_nade:d mean_true_path_km:d mean_ade_nm:d median_step_error_nm:d"
TRACK_SQL = f"""
    SELECT *, mean_ade_km / 1.852::DOUBLE AS mean_ade_nm, median_step_error_km / 1.852::DOUBLE AS median_step_error_nm
    FROM (SELECT model, avg(km) AS mean_ade_km, {pct('km', 0.5)} AS median_step_error_km FROM err GROUP BY model) a
    JOIN (SELECT model, count(*) AS n, avg(fde_km) AS final_step_mean_error_km, avg(nade) AS mean_nade, {pct('nade', 0.5)} AS median_nade, {pct('nade', 0.9)} AS p90_nade,
                 {pct('ade_km', 0.5)} AS median_window_ade_km, avg(true_path_km) AS mean_true_path_km FROM ferr GROUP BY model) b USING (model)"""


@query("e03_whole_track", TRACK, TRACK_SQL)
def e03(spark, sf):
    return E.trajectory_metrics(errors(spark, sf))


@query("e03_from_long_predictions", TRACK, TRACK_SQL)
def e03_long(spark, sf):
    return E.trajectory_metrics(E.with_errors(E.from_predictions(E.to_predictions(forecasts(spark, sf)))))


@query("e04_by_motion_bucket", "model:s bucket:s " + FINAL, final_sql("model, bucket", """(
    SELECT f.*, v.bucket FROM ferr f JOIN buckets b USING (window_id), (VALUES ('straight'), ('maneuver'), ('anchored'), ('other')) v(bucket)
    WHERE CASE v.bucket WHEN 'straight' THEN b.straight WHEN 'maneuver' THEN b.maneuver WHEN 'anchored' THEN b.anchored ELSE b.other END)"""))
def e04(spark, sf):
    return E.metrics_by_bucket(E.errors_with_buckets(A.stored_windows(spark, sf), MODELS, A.N))


@query("e05_error_by_horizon", "model:s step:i n:i mean_error_nm:d median_error_nm:d p90_error_nm:d hours_ahead:d", f"""
    SELECT model, step, count(*) AS n, avg(km / 1.852::DOUBLE) AS mean_error_nm, {pct('km / 1.852::DOUBLE', 0.5)} AS median_error_nm,
           {pct('km / 1.852::DOUBLE', 0.9)} AS p90_error_nm, (step + 1) * 3.0 AS hours_ahead FROM err GROUP BY model, step""")
def e05(spark, sf):
    return E.error_by_horizon(forecasts(spark, sf), STEP)


@query("e05_track_error", "model:s window_id:s step:i error_km:d hours_ahead:d", """
    SELECT model, window_id, step, km AS error_km, (step + 1) * 3.0 AS hours_ahead FROM err WHERE window_id IN (SELECT window_id FROM win ORDER BY window_id LIMIT 3)""")
def e05_track(spark, sf):
    ids = [r["window_id"] for r in _win(spark, sf).select("window_id").orderBy("window_id").limit(3).collect()]
    return E.track_error(forecasts(spark, sf), ids, STEP)


@query("e06_error_histogram", "model:s bin:i n:i bin_from:d bin_to:d", """
    SELECT model, bin, count(*) AS n, bin * 10.0 AS bin_from, (bin + 1) * 10.0 AS bin_to FROM (
        SELECT model, least(CAST(floor(fde_km / 10.0::DOUBLE) AS BIGINT), 19) AS bin FROM ferr WHERE fde_km BETWEEN 0 AND 200) GROUP BY model, bin""")
def e06(spark, sf):
    return E.histogram(E.final_errors(forecasts(spark, sf)), "fde_km", 0.0, 200.0, 20, ("model",))


@query("e06_box_quantiles", "model:s step:i p:d n:i value:d", """
    SELECT model, step, p, count(*) AS n, CASE p WHEN 0.05 THEN quantile_cont(km, 0.05) WHEN 0.25 THEN quantile_cont(km, 0.25) WHEN 0.5 THEN quantile_cont(km, 0.5)
           WHEN 0.75 THEN quantile_cont(km, 0.75) ELSE quantile_cont(km, 0.95) END AS value
    FROM err, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(p) WHERE step IN (1, 3) GROUP BY model, step, p""")
def e06_box(spark, sf):
    return E.box_quantiles(forecasts(spark, sf), [1, 3])


@query("e06_sampled_pairs", "model:s window_id:s true_lat:d pred_lat:d true_lon:d pred_lon:d", """
    SELECT model, window_id, true_lat, pred_lat, true_lon, pred_lon FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('42|' || window_id), window_id) AS rn FROM ferr) WHERE rn <= 5000""")
def e06_pairs(spark, sf):
    return E.sampled_pairs(forecasts(spark, sf), 5000, A.N - 1)


@query("e07_percent_change", "metric:s base_value:d other_value:d change_pct:d", f"""
    WITH m AS ({final_sql("model", "ferr")}),
    t AS (SELECT metric, max(CASE WHEN model = 'naive' THEN v END) AS base_value, max(CASE WHEN model = 'kinematic' THEN v END) AS other_value FROM (
        SELECT model, 'mean_error_km' AS metric, mean_error_km AS v FROM m UNION ALL SELECT model, 'median_error_km', median_error_km FROM m
        UNION ALL SELECT model, 'mae_lat', mae_lat FROM m) GROUP BY metric)
    SELECT *, round((other_value - base_value) / nullif(base_value, 0) * 100, 2) AS change_pct FROM t""")
def e07(spark, sf):
    m = E.final_position_metrics(errors(spark, sf))
    return E.percent_change(m, "naive", "kinematic", ["mean_error_km", "median_error_km", "mae_lat"])


# Runs: vessels in three groups; losses from the events of each group by day.
def run_documents(spark, sf) -> DataFrame:
    models = {**MODELS, "persist": B.predictor("persist")}
    names = F.create_map(*[F.lit(x) for x in (
        "naive", "Naive baseline (12.0 h)", "kinematic", "Kinematic baseline (12.0 h)", "persist", "LSTM position (12.0 h ahead)")])
    err = E.with_errors(B.forecasts(A.stored_windows(spark, sf), models, A.N, keep=("mmsi",))).withColumn(
        "run", F.concat(F.lit("run"), F.col("mmsi") % 3)
    )
    final = E.final_position_metrics(err, ("run", "model"))
    metrics = final.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct(names[F.col("model")].alias("model"), "mean_error_km", "median_error_km", "p90_error_km"))).alias("metrics"),
        F.max("n").alias("samples_train"),
    )
    daily = A.events(spark, sf).groupBy(F.concat(F.lit("run"), F.col("user_id") % 3).alias("run"), (F.dayofyear("ts") - 1).alias("epoch")).agg(
        F.avg("value").alias("train_loss"), F.avg(F.abs(F.col("value") - 20.0)).alias("val_loss"), (F.count(F.lit(1)) / 10).alias("epoch_sec")
    )
    history = daily.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_loss", "epoch_sec"))).alias("history"),
        F.struct(F.min("val_loss").alias("best_val_loss"), F.count(F.lit(1)).cast("int").alias("epochs_ran")).alias("training"),
    )
    return metrics.join(history, "run")


def stored_runs(spark, sf) -> DataFrame:
    path = new_path(spark, "runs")
    run_documents(spark, sf).write.json(path)
    return reports.read_run_metrics(spark, path, multi_line=False)


RUN_ROWS = f"""
    SELECT 'run' || CAST(w.mmsi % 3 AS VARCHAR) AS run, kind, avg(km) AS mean_error_km, {pct('km', 0.5)} AS median_error_km, count(*) AS n FROM (
        SELECT window_id, model AS kind, fde_km AS km FROM ferr UNION ALL SELECT window_id, 'model', net_km FROM ferr WHERE model = 'naive') e
    JOIN win w USING (window_id) GROUP BY 1, 2"""
EPOCHS = """
    SELECT 'run' || CAST(user_id % 3 AS VARCHAR) AS run, dayofyear(ts) - 1 AS epoch, avg(value) AS train_loss, avg(abs(value - 20.0::DOUBLE)) AS val_loss, count(*) / 10.0::DOUBLE AS epoch_sec
    FROM events GROUP BY 1, 2"""


@query("s08_run_metric_rows", "run:s kind:s mean_error_km:d median_error_km:d", RUN_ROWS)
def s08(spark, sf):
    return reports.metric_rows(stored_runs(spark, sf))


@query("e08_compare_runs", "run:s naive_fde_km_mean:d naive_fde_km_median:d kinematic_fde_km_mean:d model_fde_km_median:d best_epoch:i best_val_loss:d missing:b", f"""
    WITH r AS ({RUN_ROWS}), e AS ({EPOCHS}),
    wide AS (SELECT run, max(CASE WHEN kind = 'naive' THEN mean_error_km END) AS naive_fde_km_mean, max(CASE WHEN kind = 'naive' THEN median_error_km END) AS naive_fde_km_median,
                    max(CASE WHEN kind = 'kinematic' THEN mean_error_km END) AS kinematic_fde_km_mean, max(CASE WHEN kind = 'model' THEN median_error_km END) AS model_fde_km_median
             FROM r GROUP BY run),
    b AS (SELECT run, arg_min(epoch, val_loss) AS best_epoch, min(val_loss) AS best_val_loss FROM e GROUP BY run)
    SELECT l.run, naive_fde_km_mean, naive_fde_km_median, kinematic_fde_km_mean, model_fde_km_median, best_epoch, best_val_loss, best_val_loss IS NULL AS missing
    FROM (VALUES ('run0'), ('run1'), ('run2'), ('run9')) l(run) LEFT JOIN wide USING (run) LEFT JOIN b USING (run)""")
def e08(spark, sf):
    return E.compare_runs(stored_runs(spark, sf), ["run0", "run1", "run2", "run9"], ["naive", "kinematic", "model"])


@query("e09_rank_models", "model:s median_error_km:d rank:i", f"""
    SELECT model, median_error_km, rank() OVER (ORDER BY median_error_km) AS rank FROM ({final_sql("model", "ferr")})""")
def e09(spark, sf):
    return E.rank_models(E.final_position_metrics(errors(spark, sf)))


@query("e09_best_model", "model:s median_error_km:d", f"""
    SELECT model, median_error_km FROM ({final_sql("model", "ferr")}) ORDER BY median_error_km, model LIMIT 1""")
def e09_best(spark, sf):
    return E.best_of(E.final_position_metrics(errors(spark, sf)))


@query("e10_training_history", "run:s epoch:i train_loss:d val_loss:d epoch_sec:d train_steps:i samples_per_sec:d", f"""
    WITH e AS ({EPOCHS}), n AS (SELECT run, max(n) AS samples FROM ({RUN_ROWS}) GROUP BY run)
    SELECT run, epoch, train_loss, val_loss, epoch_sec, samples / epoch_sec AS samples_per_sec,
           greatest(1, least(72, CAST(round_even(36 + least(1.0::DOUBLE, epoch / greatest(1, floor((count(*) OVER (PARTITION BY run)) * 0.5::DOUBLE))) * 36, 0) AS BIGINT))) AS train_steps
    FROM e JOIN n USING (run)""")
def e10(spark, sf):
    return E.training_history(stored_runs(spark, sf), 72, curriculum=True, start_steps=36)


@query("e10_compute_costs", "run:s epochs:i train_sec:d samples_per_sec:d", f"""
    WITH e AS ({EPOCHS}), n AS (SELECT run, max(n) AS samples FROM ({RUN_ROWS}) GROUP BY run)
    SELECT run, count(*) AS epochs, sum(epoch_sec) AS train_sec, sum(samples) / sum(epoch_sec) AS samples_per_sec FROM e JOIN n USING (run) GROUP BY run""")
def e10_costs(spark, sf):
    return E.compute_costs(stored_runs(spark, sf))


@query("s09_read_forecast_samples", "model:s step:i n:i true_lat:d pred_lon:d anchor_lat:d", """
    SELECT model, step, count(*) AS n, avg(true_lat) AS true_lat, avg(pred_lon) AS pred_lon, avg(anchor_lat) AS anchor_lat FROM pred GROUP BY model, step""")
def s09(spark, sf):
    pair = lambda p: F.array(p.lat, p.lon)
    rows = forecasts(spark, sf, keep=("traj_id", "start_time")).select(
        "model",
        "traj_id",
        F.to_date("start_time").alias("day"),
        F.transform("true_track", pair).alias("t"),
        F.transform("pred_track", pair).alias("p"),
        F.array("anchor.lat", "anchor.lon").alias("a"),
    )
    # A sample document holds the windows of one trajectory and day, at most one per grid step.
    docs = rows.groupBy("model", "traj_id", "day").agg(F.collect_list(F.struct("t", "p", "a")).alias("s")).select(
        "model", F.col("s.t").alias("y_true"), F.col("s.p").alias("y_pred"), F.col("s.a").alias("anchor")
    )
    path = new_path(spark, "samples")
    docs.write.json(path)
    back = reports.read_forecast_samples(spark, path, multi_line=False)
    return back.groupBy("model", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_lat").alias("true_lat"), F.avg("pred_lon").alias("pred_lon"), F.avg("anchor_lat").alias("anchor_lat")
    )


ALT_SQL = f"""
    SELECT window_id, CASE WHEN e0 <= e1 AND e0 <= e2 AND e0 <= e3 THEN 0 WHEN e1 <= e2 AND e1 <= e3 THEN 1 WHEN e2 <= e3 THEN 2 ELSE 3 END AS best,
           least(e0, e1, e2, e3) AS best_km, choice, mmsi FROM (
        SELECT a.window_id, a.fde_km AS e0, b.fde_km AS e1, a.net_km AS e2, c.km AS e3, g.choice, g.mmsi
        FROM ferr a JOIN ferr b ON b.window_id = a.window_id AND a.model = 'naive' AND b.model = 'kinematic'
        JOIN (SELECT window_id, {hav('true_lat', 'true_lon', 'pred_lat', 'pred_lon')} AS km FROM ({KIN_REF}) WHERE step = 3) c ON c.window_id = a.window_id
        JOIN gate g ON g.window_id = a.window_id)"""
