"""Masks, buckets, shapes and land lookups on hand-made windows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wakeline.constants import FEATURES
from wakeline.operators import land as L, motion as M, windows as W

T0 = dt.datetime(2024, 1, 1)
KM = 1 / 111.19492664455873  # degrees of latitude per kilometre on the sphere
STRUCT = ", ".join(f"{f}: float" for f in FEATURES)
SCHEMA = f"traj_id string, mmsi long, start_time timestamp_ntz, hist array<struct<{STRUCT}>>, fut array<struct<lat: float, lon: float>>"


def window(name, north_km, future_km=None, sog=20.0, dcog=0.0, lat0=40.0, lon0=-70.0):
    """History at the given kilometres north of a start; ten-minute steps."""
    hist = []
    for k in north_km:
        v = dict.fromkeys(FEATURES, 0.0)
        v |= {"lat": lat0 + k * KM, "lon": lon0, "sog": sog, "dcog": dcog, "cog_cos": 1.0}
        hist.append(tuple(float(v[f]) for f in FEATURES))
    future_km = future_km or [north_km[-1]] * 72
    return (name, 1, T0, hist, [(lat0 + k * KM, lon0) for k in future_km])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


STEADY = [i * 0.5 for i in range(144)]


def masks(spark, *rows, cfg=M.SmartMotionConfig()):
    m = M.smart_metrics(M.history_metrics(frame(spark, *rows)))
    return {r["traj_id"]: r for r in m.withColumns({"st": M.is_stationary(), "sm": M.fails_smart_motion(cfg), "why": M.reject_reason(cfg)}).collect()}


def test_masks(spark):
    loop = [15 * math.sin(i * math.pi / 72) ** 2 * 0.5 for i in range(144)]
    ferry = [30 * abs(math.sin(i * math.pi / 71.5)) + (8 if i == 143 else 0) for i in range(144)]
    r = masks(
        spark,
        window("parked", [0.1 * (i % 2) for i in range(144)]),
        window("steady", STEADY),
        window("arrived", [i * 0.5 for i in range(96)] + [47.5] * 48),
        window("loop", loop),
        window("ferry", ferry),
    )
    assert r["parked"]["st"] and r["parked"]["sm"]
    assert not r["steady"]["st"] and not r["steady"]["sm"] and r["steady"]["why"] == "?"
    assert r["arrived"]["sm"] and r["arrived"]["arrived_then_stopped"] and "last8h" in r["arrived"]["why"]
    assert r["loop"]["sm"] and "local_loop" in r["loop"]["why"]
    assert r["ferry"]["history_path_km"] > 50 and "local_loop" not in r["ferry"]["why"]


def test_metrics_of_a_straight_track(spark):
    r = masks(spark, window("s", STEADY, [71.5 + i * 0.5 for i in range(1, 73)]))["s"]
    assert r["history_full_net_km"] == pytest.approx(71.5, rel=1e-4)
    assert r["history_16h_net_km"] == pytest.approx(47.5, rel=1e-4)
    assert r["history_last_8h_net_km"] == pytest.approx(23.5, rel=1e-4)
    assert r["future_8h_net_km"] == pytest.approx(24.0, rel=1e-4)
    assert r["future_12h_net_km"] == pytest.approx(36.0, rel=1e-4)
    assert r["history_loop_ratio"] == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize("sog,dcog,want", [(20.0, 0.0, {"straight"}), (0.5, 40.0, {"anchored", "maneuver"}), (3.0, 0.0, {"other"}), (20.0, -16.0, {"maneuver"})])
def test_buckets(spark, sog, dcog, want):
    r = M.motion_buckets(frame(spark, window("w", STEADY, sog=sog, dcog=dcog))).first()
    assert {b for b in ("straight", "maneuver", "anchored", "other") if r[b]} == want


def test_stationary_report(spark):
    kept, report = M.filter_stationary(frame(spark, window("a", STEADY), window("b", [0.0] * 144), window("c", STEADY)))
    row = report.first()
    assert kept.count() == 2 and kept.columns == ["traj_id", "mmsi", "start_time", "hist", "fut"]
    assert (row["windows_total"], row["windows_removed"], row["windows_kept"]) == (3, 1, 2)
    assert row["median_max_radius_km_removed"] == 0.0 and row["median_max_radius_km_kept"] == pytest.approx(71.5, rel=1e-3)
    again, second = M.filter_stationary(kept)
    assert again.count() == 2 and second.first()["windows_removed"] == 0


def test_difficulty_weight_of_equal_scores(spark):
    w = M.difficulty_weights(frame(spark, window("a", STEADY, dcog=4.0), window("b", STEADY, dcog=4.0))).collect()
    assert all(r["weight"] == pytest.approx(2.0, rel=1e-5) for r in w)


def grid(spark):
    """20 x 20 cells of 0.05 degrees, the western half land."""
    cells = L.cell_nodes(spark, 30.0, 30.95, -80.0, -79.05, 0.05).select("row", "col", (F.col("col") < 10).cast("tinyint").alias("land"))
    return L.LandGrid(cells, 30.0, -80.0, 0.05, 20, 20)


def test_land_join_and_inline_agree(spark):
    g = grid(spark)
    pts = spark.createDataFrame(
        [("deep", 30.5, -79.98), ("shore", 30.5, -79.51), ("sea", 30.5, -79.2), ("outside", 31.5, -79.9)], "k string, lat double, lon double"
    )
    land = {r["k"]: r["land"] for r in L.flag_land(pts, g).collect()}
    assert land == {"deep": True, "shore": True, "sea": False, "outside": False}
    joined = {r["k"]: r["open_water"] for r in L.flag_open_water(pts, g, km=3.0).collect()}
    inline = {r["k"]: r["w"] for r in pts.select("k", L.open_water(F.col("lat"), F.col("lon"), g, L.land_lookup(g), 3.0).alias("w")).collect()}
    assert joined == inline == {"deep": True, "shore": True, "sea": True, "outside": True}
    inner = spark.createDataFrame([("inner", 30.5, -79.8)], "k string, lat double, lon double")
    assert L.flag_open_water(inner, g, km=3.0).first()["open_water"] is False


@pytest.mark.parametrize("inland_steps,kept", [(12, True), (13, False)])
def test_inland_rule_is_strictly_more_than_half(spark, inland_steps, kept):
    g = grid(spark)
    rows = window("w", [0.0] * 144, lat0=30.5, lon0=-79.2)
    hist = [list(p) for p in rows[3]]
    for j in range(inland_steps):  # every 6th point is looked at: 24 points
        hist[j * 6][FEATURES.index("lon")] = -79.8
    df = frame(spark, (rows[0], rows[1], rows[2], [tuple(p) for p in hist], rows[4]))
    assert (L.filter_inland(df, g, km=3.0).count() == 1) is kept


def test_windows_of_two_regions_with_one_key(spark):
    """Equal ids and times do not mix, and a window without history has no share."""
    g = grid(spark)
    rows = [window("w", [0.0] * 144, lat0=30.5, lon0=lon) for lon in (-79.85, -79.1)]
    empty = (*rows[0][:3], [], rows[0][4])
    found = L.inland_fraction(frame(spark, *rows, empty), g, km=3.0).select("inland_fraction").collect()
    assert [r[0] for r in found] == [1.0, 0.0, None]
    assert L.filter_inland(frame(spark, *rows, empty), g, km=3.0).count() == 2


def test_a_raster_beyond_four_million_cells(spark):
    n = 2100
    cells = spark.range(n * 3).select((F.col("id") % n).cast("int").alias("row"), F.lit(2099).alias("col"), F.lit(1).cast("tinyint").alias("land"))
    g = L.LandGrid(cells, 0.0, 0.0, 0.01, n, n)
    pts = spark.createDataFrame([(0, 5.005, 20.995), (1, 5.005, 20.985), (2, 20.995, 20.995), (3, 21.5, 20.995)], "k int, lat double, lon double")
    assert [r["land"] for r in L.flag_land(pts, g).orderBy("k").collect()] == [True, False, True, False]


def test_bilinear_occupancy(spark):
    g = grid(spark)
    pts = spark.createDataFrame(
        [("node", 30.5, -79.9), ("edge", 30.5, -79.525), ("sea", 30.5, -79.2), ("out", 31.5, -79.9)], "k string, lat double, lon double"
    )
    got = {r["k"]: r["occupancy"] for r in L.land_occupancy(pts, g).collect()}
    assert got["node"] == pytest.approx(1.0) and got["edge"] == pytest.approx(0.5)
    assert got["sea"] == got["out"] == 0.0


def test_track_shape_of_a_straight_line(spark):
    w = frame(spark, window("s", STEADY, [71.5 + i for i in range(1, 73)]))
    r = M.track_shape(w.select(W.anchor().alias("anchor"), W.as_points("fut").alias("true_track"))).first()
    assert r["directness"] == pytest.approx(1.0, abs=1e-5) and r["cross_track_km"] < 1e-2 and r["turn_deg"] < 1e-2


def test_filters_read_each_metric_once(spark):
    """The predicate names values, not the expressions that make them."""
    windows = frame(spark, window("s", STEADY))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert plan(M.filter_smart_motion(windows)) <= plan(M.smart_metrics(windows))
