"""Segmentation: hand-made cases, and any chunk length against a pandas loop."""

from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest

from wakeline.operators import segment as G
from wakeline.sources.scratch import materialize

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp_ntz, mmsi long, lat double, lon double, sog double, cog double, heading double, vessel_type string"


def frame(spark, rows):
    full = [(T0 + dt.timedelta(seconds=r["t"]), r.get("mmsi", 1), r.get("lat", 40.0), r.get("lon", -70.0), r.get("sog", 10.0), r.get("cog", 0.0), r.get("heading"), "70") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(h))


def brute(pdf, cfg):
    out = []
    for mmsi, g in pdf.sort_values(["mmsi", "timestamp"]).groupby("mmsi"):
        prev, seg = None, 0
        for r in g.itertuples():
            if prev is None:
                new, ok, dist, dt_s = 1, False, None, None
            else:
                dt_s = (r.timestamp - prev.timestamp).total_seconds()
                dist = hav(prev.lat, prev.lon, r.lat, r.lon)
                ok = dt_s > 0 and dist / (dt_s / 3600) <= cfg.max_speed_kmh
                new = int(not (ok and dt_s / 3600 <= cfg.max_gap_hours))
            seg += new
            out.append((mmsi, r.timestamp, f"{mmsi}_{seg}", new, ok, dist))
            prev = r
    return pd.DataFrame(out, columns=["mmsi", "timestamp", "traj_id", "new_segment", "ok", "dist_km"])


@pytest.fixture(scope="module")
def wandering(spark):
    rnd = random.Random(3)
    rows = []
    for mmsi, n in ((1, 400), (2, 60), (3, 1)):
        t, lat = 0, 40.0
        for _ in range(n):
            t += rnd.choice([60, 600, 3600, 7 * 3600, 30 * 3600])
            lat += rnd.choice([0.0, 0.001, 0.05, 0.05, 3.0 if rnd.random() < 0.1 else 0.0])
            lat = 35.0 if lat > 60 else lat
            rows.append({"t": t, "mmsi": mmsi, "lat": lat})
    return frame(spark, rows)


@pytest.mark.parametrize("chunk", [1, 24, 24 * 400])
def test_chunks_do_not_change_result(spark, wandering, chunk):
    cfg = G.SegmentConfig(min_points=3, min_hours=1.0, min_distance_km=1.0, chunk_hours=chunk)
    got = G.segment_points(wandering, cfg).select("mmsi", "timestamp", "traj_id", "new_segment").toPandas()
    want = brute(wandering.toPandas(), cfg)
    both = got.merge(want, on=["mmsi", "timestamp"], suffixes=("", "_w"))
    assert len(both) == len(want) == len(got)
    assert (both.traj_id == both.traj_id_w).all() and (both.new_segment == both.new_segment_w).all()

    kept = G.build_segments(wandering, cfg).select("mmsi", "timestamp", "traj_id").toPandas()
    ok = want[want.ok]
    stats = ok.groupby("traj_id").agg(n=("timestamp", "size"), d=("dist_km", "sum"), a=("timestamp", "min"), b=("timestamp", "max"))
    long = stats[(stats.n >= 3) & (stats.d >= 1.0) & ((stats.b - stats.a).dt.total_seconds() >= 3600)].index
    expected = ok[ok.traj_id.isin(long)]
    assert sorted(zip(kept.mmsi, kept.timestamp)) == sorted(zip(expected.mmsi, expected.timestamp))
    assert len(kept) > 50


def test_gap_row_is_kept(spark):
    pts = frame(spark, [{"t": 0}, {"t": 6 * 3600, "lat": 40.1}, {"t": 12 * 3600 + 1, "lat": 40.2}])
    rows = G.segment_points(pts).orderBy("timestamp").collect()
    assert [r["new_segment"] for r in rows] == [1, 0, 1]
    left = G.drop_invalid_steps(G.segment_points(pts)).orderBy("timestamp").collect()
    assert [r["segment_id"] for r in left] == [1, 2]
    assert left[1]["dt_sec"] == 6 * 3600 + 1


def test_outlier_drops_two_rows_and_numbers_two_segments(spark):
    pts = frame(spark, [{"t": 0}, {"t": 600, "lat": 40.01}, {"t": 1200, "lat": 45.0}, {"t": 1800, "lat": 40.02}, {"t": 2400, "lat": 40.03}])
    rows = G.segment_points(pts).orderBy("timestamp").collect()
    assert [r["segment_id"] for r in rows] == [1, 1, 2, 3, 3]
    left = G.drop_invalid_steps(G.segment_points(pts)).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in left] == [T0 + dt.timedelta(seconds=600), T0 + dt.timedelta(seconds=2400)]


def test_course_wrap_and_heading(spark):
    pts = frame(spark, [{"t": 0, "cog": 350.0}, {"t": 60, "cog": 10.0}, {"t": 120, "cog": 350.0}, {"t": 180, "cog": 170.0, "heading": 90.0}])
    rows = G.segment_points(pts).orderBy("timestamp").collect()
    assert [r["dcog"] for r in rows] == [None, 20.0, -20.0, -180.0]
    assert [r["heading_missing"] for r in rows] == [1, 1, 1, 0]
    assert rows[0]["heading_sin"] == pytest.approx(rows[0]["cog_sin"])
    assert rows[3]["heading_sin"] == pytest.approx(1.0)


def test_first_row_has_no_distance(spark):
    row = G.segment_points(frame(spark, [{"t": 0}])).first()
    assert row["dist_km"] is None and row["dt_sec"] is None and row["new_segment"] == 1


@pytest.mark.parametrize("n,hours,km,kept", [(50, 12.0, 18.52, True), (49, 12.0, 18.52, False), (50, 11.99, 18.52, False), (50, 12.0, 18.51, False)])
def test_limits(spark, n, hours, km, kept):
    stats = spark.createDataFrame([(n, hours, km)], "n_points long, duration_hours double, total_distance_km double")
    assert (stats.filter(G.long_enough(G.SegmentConfig())).count() == 1) is kept


def test_one_wide_shuffle(spark, wandering):
    """Rows are exchanged once; the chunk table reads the same exchange."""
    cfg = G.SegmentConfig(min_points=3, min_hours=1.0, min_distance_km=1.0)
    plan = G.build_segments(materialize(wandering), cfg)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = [x for x in text.splitlines() if "Exchange hashpartitioning(" in x and "Reused" not in x]
    assert sum("REPARTITION_BY_COL" in line for line in exchanges) == 1
    assert len(exchanges) == 2 and "ReusedExchange" in text
