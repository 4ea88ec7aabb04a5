"""Segments that follow new reports against a full rebuild."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from wakeline.operators import segment as G
from wakeline.plans.increments import SegmentState
from wakeline.sources.scratch import new_path

CFG = G.SegmentConfig(max_gap_hours=6.0, max_speed_kmh=92.6, min_points=20, min_hours=30.0, min_distance_km=5.0)
START = dt.datetime(2024, 3, 1)
POINTS = "timestamp timestamp_ntz, mmsi long, lat double, lon double, sog double, cog double, heading double, vessel_type string, vessel_type_code int"


def reports() -> list[tuple]:
    """Eight vessels over six days, with gaps, jumps and copies."""
    rng, rows = random.Random(3), []
    for mmsi in range(1, 9):
        lat, lon, t = 40.0 + mmsi, -70.0, START + dt.timedelta(minutes=mmsi)
        while t < START + dt.timedelta(days=6):
            course = rng.uniform(0, 360)
            lat += 0.02 * math.cos(course / 60)
            lon += 0.02
            jump = 3.0 if rng.random() < 0.004 else 0.0
            row = (t, mmsi, lat + jump, lon, 10.0, course, None, None, 70)
            rows += [row] * (2 if rng.random() < 0.05 else 1)
            t += dt.timedelta(minutes=30 if rng.random() < 0.97 else rng.choice([300, 800]))
    return rows


def same(a, b) -> bool:
    cols = sorted(a.columns)
    key = lambda df: sorted(map(repr, df.select(*cols).collect()))
    return key(a) == key(b)


def test_days_in_order_equal_a_rebuild(spark):
    rows = reports()
    state = SegmentState(spark, new_path(spark, "state"), CFG)
    for day in range(6):
        a = START + dt.timedelta(days=day)
        part = [r for r in rows if a <= r[0] < a + dt.timedelta(days=1)]
        found = state.append(spark.createDataFrame(part, POINTS))
        assert len(found.touched) == 1
        if day >= 4:
            # only days that a trajectory of the new day reaches back to are derived again
            assert len(found.changed) <= 3
    points = spark.createDataFrame(rows, POINTS).dropDuplicates()
    want = G.build_segments(points, CFG)
    assert want.count() > 500
    assert same(state.segments(), want)
    assert same(SegmentState(spark, state.root, CFG).segments(), want)


def test_late_reports_change_the_chain_after_them(spark):
    rows = reports()
    late = [r for r in rows if r[1] == 3 and START + dt.timedelta(days=2) <= r[0] < START + dt.timedelta(days=2, hours=9)]
    early = [r for r in rows if r not in late]
    state = SegmentState(spark, new_path(spark, "state"), CFG)
    state.append(spark.createDataFrame(early, POINTS), sources=[1, 2])
    assert same(state.segments(), G.build_segments(spark.createDataFrame(early, POINTS).dropDuplicates(), CFG))
    found = state.append(spark.createDataFrame(late, POINTS), sources=[3])
    assert len(found.touched) == 1 and min(found.changed) <= found.touched[0] <= max(found.changed)
    assert same(state.segments(), G.build_segments(spark.createDataFrame(rows, POINTS).dropDuplicates(), CFG))
    assert state.sources() == {1, 2, 3}


def test_known_reports_change_nothing_and_unread_days_stay(spark):
    rows = reports()
    state = SegmentState(spark, new_path(spark, "state"), CFG)
    state.append(spark.createDataFrame(rows, POINTS))
    held = dict(state.held)
    again = [r for r in rows if r[0] >= START + dt.timedelta(days=5)] + [(None, 4, *rows[0][2:]), (rows[0][0], None, *rows[0][2:])]
    found = state.append(spark.createDataFrame(again, POINTS))
    assert found.changed == found.touched and len(found.touched) == 1
    moved = {k for k, v in state.held.items() if held.get(k) != v}
    assert {c for _, c in moved} == set(found.touched)
    assert same(state.segments(), G.build_segments(spark.createDataFrame(rows, POINTS).dropDuplicates(), CFG))


def test_a_run_without_its_manifest_is_not_there(spark):
    rows = reports()
    state = SegmentState(spark, new_path(spark, "state"), CFG)
    state.append(spark.createDataFrame([r for r in rows if r[0] < START + dt.timedelta(days=3)], POINTS))
    rest = spark.createDataFrame([r for r in rows if r[0] >= START + dt.timedelta(days=3)], POINTS)
    # a lost run left points of the next version
    rest.limit(5).withColumn("_chunk", G.chunk_of(CFG)).write.partitionBy("_chunk").parquet(f"{state.root}/points/version=2")
    again = SegmentState(spark, state.root, CFG)
    again.append(rest)
    assert same(again.segments(), G.build_segments(spark.createDataFrame(rows, POINTS).dropDuplicates(), CFG))
    assert again.segments().select(F.countDistinct("traj_id")).first()[0] > 1
