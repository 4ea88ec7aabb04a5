"""Nearest windows of a table of targets against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import routes as V


def windows_at(spark, places):
    rows = [(f"t{i % 7}", i, [(0.0, 0.0), (float(a), float(b))]) for i, (a, b) in enumerate(places)]
    return spark.createDataFrame(rows, "traj_id string, start_time int, hist array<struct<lat:double,lon:double>>")


def brute(places, targets):
    best = {}
    for name, lat, lon in targets:
        rows = [((a - lat) ** 2 + (b - lon) ** 2, f"t{i % 7}", i) for i, (a, b) in enumerate(places)]
        best[name] = min(rows)
    return best


def test_nearest_of_many_equals_all_distances(spark):
    rng = np.random.default_rng(11)
    port = np.array([40.7, -74.0]) + rng.normal(0, 1e-3, (300, 2))  # a third of all windows at one place
    coast = np.column_stack([rng.uniform(25, 45, 300), rng.uniform(-80, -65, 300)])
    world = np.column_stack([rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200)])
    corners = np.array([(0.0, 0.0), (0.0, 0.0), (0.5, 0.5), (-0.5, 0.5), (32.0, -64.0), (90.0, 180.0), (-90.0, -180.0)])
    places = [tuple(map(float, p)) for p in np.concatenate([port, port[:50], coast, world, corners])]
    aims = np.concatenate([port[:60] + 1e-5, rng.uniform(-90, 90, (100, 2)), coast[:40], [(0.0, 0.5), (0.0, 0.0), (90.0, -180.0)]])
    targets = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(aims)]
    table = spark.createDataFrame(targets, "target string, lat double, lon double")
    got = {r["target"]: (r["distance2"], r["traj_id"], r["start_time"]) for r in V.nearest_windows_of(windows_at(spark, places), table).collect()}
    want = brute(places, targets)
    assert got.keys() == want.keys()
    for name, (d, traj, start) in want.items():
        assert got[name][0] == pytest.approx(d, rel=1e-12, abs=0) and got[name][1:] == (traj, start)


def test_nearest_of_many_without_positions(spark):
    table = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, 3.0)], "target string, lat double, lon double")
    places = windows_at(spark, [(float("nan"), 1.0), (2.0, 4.0)])
    assert [r["target"] for r in V.nearest_windows_of(places, table).collect()] == ["b"]
    assert V.nearest_windows_of(places.limit(0), table).collect() == []
    assert V.nearest_windows_of(places, table.limit(0)).collect() == []


def test_plan_does_not_grow_with_the_targets_and_joins_by_cell(spark):
    table = spark.range(5000).select(F.col("id").alias("target"), (F.col("id") % 90).alias("lat"), (F.col("id") % 180).alias("lon"))
    plans = [
        V.nearest_windows_of(windows_at(spark, [(1.0, 2.0)]), t)._jdf.queryExecution().executedPlan().toString() for t in (table, table.filter("target < 3"))
    ]
    assert plans[0].count("Join") == plans[1].count("Join") == len(V.CELL_EDGES) + 1
    assert "NestedLoop" not in plans[0] and "Cartesian" not in plans[0]
