"""Land by tiles on a raster of the globe, against plain lookups."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import land as L

RES = 0.01
ROWS, COLS = L.grid_shape(-90.0, 90.0, -180.0, 180.0, RES)


@pytest.fixture(scope="module")
def world(spark):
    """650 million cells, land in two blocks of the coast and in the last corner."""
    block = lambda r, c, n, m: spark.range(n * m).select(
        (F.lit(r) + F.floor(F.col("id") / m)).cast("int").alias("row"), (F.lit(c) + F.col("id") % m).cast("int").alias("col")
    )
    cells = block(13_000, 10_600, 90, 130).unionByName(block(13_100, 10_900, 3, 70)).unionByName(block(ROWS - 1, COLS - 1, 1, 1))
    cells = cells.withColumn("land", F.lit(1)).unionByName(block(13_010, 10_610, 2, 2).withColumn("land", F.lit(0)))
    grid = L.LandGrid(cells, -90.0, -180.0, RES, ROWS, COLS)
    land = {(r["row"], r["col"]) for r in cells.filter("land = 1").select("row", "col").collect()}
    return grid, land, L.land_tiles(grid)


def is_land(land, lat: float, lon: float) -> bool:
    return (math.floor((lat + 90.0) / RES), math.floor((lon + 180.0) / RES)) in land


def places(n: int) -> list[tuple[float, float]]:
    rng = np.random.default_rng(2)
    near = np.column_stack([rng.uniform(39.9, 41.2, n), rng.uniform(-74.2, -70.0, n)])
    return [tuple(map(float, p)) for p in [*near, (90.0, 180.0), (89.0, 0.0), (-90.0, -180.0), (95.0, 0.0), (40.0, -200.0)]]


def test_points_of_a_global_raster(spark, world):
    grid, land, tiles = world
    assert grid.size > 600_000_000 and tiles.count() < 30
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places(800))], "id int, lat double, lon double")
    found = L.flag_land_by_tiles(points.unionByName(spark.createDataFrame([(-1, None, 1.0)], points.schema)), grid, tiles)
    got = {r["id"]: r["land"] for r in found.collect()}
    want = {i: is_land(land, *p) for i, p in enumerate(places(800))} | {-1: False}
    assert got == want and 100 < sum(want.values()) < 700


def test_windows_of_a_global_raster(spark, world):
    grid, land, tiles = world
    p = places(600)
    tracks = {f"w{i}": p[i : i + 5] for i in range(0, 600, 5)} | {"empty": [], "away": [(0.0, 0.0)] * 5}
    windows = spark.createDataFrame(list(tracks.items()), "window_id string, hist array<struct<lat:double,lon:double>>")
    got = {r["window_id"]: r["inland_fraction"] for r in L.inland_fraction_by_tiles(windows, grid, tiles, every=2).collect()}

    def water_near(lat: float, lon: float) -> bool:
        dlat = 10.0 / L.SPAN_KM_PER_DEG
        dlon = 10.0 / (L.SPAN_KM_PER_DEG * math.cos(math.radians(max(-60.0, min(60.0, lat)))))
        return any(not is_land(land, lat + a * dlat, lon + b * dlon) for a in (-1, 0, 1) for b in (-1, 0, 1))

    for name, track in tracks.items():
        picked = track[::2]
        if not picked:
            assert got[name] is None
        else:
            assert got[name] == pytest.approx(sum(not water_near(*q) for q in picked) / len(picked))
    assert any(x for x in got.values()) and got["away"] == 0.0


def test_tiles_equal_the_constant_and_large_constants_are_refused(spark, world):
    grid, land, tiles = world
    with pytest.raises(ValueError, match="tiles"):
        L.land_lookup(grid)
    shifted = grid.cells.select((F.col("row") - 12_900).alias("row"), (F.col("col") - 10_500).alias("col"), "land")
    small = L.LandGrid(shifted, 39.0, -75.0, RES, 400, 700)
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places(500))], "id int, lat double, lon double")
    a = L.flag_land(points, small).select("id", "land").collect()
    b = L.flag_land_by_tiles(points, small, L.land_tiles(small)).select("id", "land").collect()
    assert sorted(a) == sorted(b) and any(r["land"] for r in a)


def test_plan_holds_no_raster(spark, world):
    grid, _, tiles = world
    windows = spark.createDataFrame([("w", [(40.0, -74.0)])], "window_id string, hist array<struct<lat:double,lon:double>>")
    plan = L.inland_fraction_by_tiles(windows, grid, tiles)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 100_000 and "Cartesian" not in plan and "NestedLoop" not in plan
