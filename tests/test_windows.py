"""Windows, targets and wide form."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.constants import FEATURES
from wakeline.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def grid(spark, n, traj="1_1", skip=()):
    rows = [(1, traj, i, T0 + dt.timedelta(minutes=10 * i), *[float(i)] * len(FEATURES)) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "mmsi long, traj_id string, bin long, timestamp timestamp_ntz, " + ", ".join(f"{f} double" for f in FEATURES))


def build(g, **kw):
    return W.build_windows(g, history_hours=0.5, future_hours=1 / 3, resample_minutes=10, **kw)  # 3 + 2 steps


@pytest.mark.parametrize("block", [5, 7, 16, 512])
def test_every_start_once_for_any_block(spark, block):
    rows = build(grid(spark, 23), block_rows=block).orderBy("start_time").collect()
    assert [r["hist"][0]["lat"] for r in rows] == [float(i) for i in range(19)]
    for i, r in enumerate(rows):
        assert [p["lat"] for p in r["hist"]] == [i, i + 1, i + 2] and [p["lat"] for p in r["fut"]] == [i + 3, i + 4]
        assert r["split_time"] == T0 + dt.timedelta(minutes=10 * (i + 2))
        assert r["target_end_time"] == T0 + dt.timedelta(minutes=10 * (i + 4))


def test_short_tracks_give_none(spark):
    assert build(grid(spark, 4)).count() == 0
    assert build(grid(spark, 5)).count() == 1


def test_windows_span_holes_unless_contiguous(spark):
    g = grid(spark, 12, skip={5, 6})
    assert build(g).count() == 6
    assert build(g, require_contiguous=True).count() == 2


def test_cap_is_exact_and_seeded(spark):
    g = grid(spark, 60).unionByName(grid(spark, 8, traj="1_2"))
    a = build(g, cap=7, block_rows=8)
    counts = {r["traj_id"]: r["count"] for r in a.groupBy("traj_id").count().collect()}
    assert counts == {"1_1": 7, "1_2": 4}
    key = lambda df: sorted((r["traj_id"], r["start_time"]) for r in df.select("traj_id", "start_time").collect())
    assert key(a) == key(build(g, cap=7, block_rows=64))
    assert key(a) != key(build(g, cap=7, seed=1))


def test_future_in_frame(spark):
    assert build(grid(spark, 10)).count() == 6
    assert build(grid(spark, 10), frame=(0.0, 7.0, 0.0, 7.0)).count() == 4


def test_target_round_trips(spark):
    w = build(grid(spark, 9)).withColumn("a", W.anchor()).withColumn("f", W.as_points("fut"))
    steps, offsets = W.step_deltas(F.col("f"), F.col("a")), W.anchor_offsets(F.col("f"), F.col("a"))
    row = w.select(
        (W.to_absolute(steps, F.col("a"), "step_delta") == F.col("f")).alias("s"),
        (W.to_absolute(offsets, F.col("a")) == F.col("f")).alias("o"),
        (W.steps_to_offsets(steps) == offsets).alias("c"),
        (W.offsets_to_steps(offsets) == steps).alias("d"),
    ).distinct().collect()
    assert [tuple(r) for r in row] == [(True, True, True, True)]


def test_wide_round_trip_and_shape(spark):
    w = build(grid(spark, 9))
    wide = W.to_wide(w, 3, 2)
    assert W.shape_from_columns(wide.columns) == (3, 2)
    assert len([c for c in wide.columns if W.STEP_COLUMN.match(c)]) == 3 * 15 + 2 * 2
    back = W.from_wide(wide).select(w.columns)
    assert back.exceptAll(w).count() == 0 and w.exceptAll(back).count() == 0
    old = wide.withColumnsRenamed({f"x_t{t:03d}_v_north_kmh": f"x_t{t:03d}_v_north_knots" for t in range(3)})
    assert W.from_wide(old).first()["hist"][0]["v_north_kmh"] == 0.0


def test_select_hours(spark):
    w = W.select_hours(build(grid(spark, 5)), 1 / 3, 1 / 6, 10)
    row = w.first()
    assert [p["lat"] for p in row["hist"]] == [1, 2] and [p["lat"] for p in row["fut"]] == [3]
    with pytest.raises(Exception, match="fewer than"):
        W.select_hours(build(grid(spark, 5)), 2.0, 1 / 6, 10).collect()


def test_horizon_step_is_clamped():
    assert W.horizon_step(1.0, 10, 72) == 5
    assert W.horizon_step(99.0, 10, 72) == 71
    assert W.horizon_step(0.0, 10, 72) == 0


def test_possible_windows(spark):
    r = spark.range(1).select(*[W.possible_windows(F.lit(h), 24.0, 12.0, 10).alias(f"h{i}") for i, h in enumerate((35.9, 36.0, 36.2, 48.0))]).first()
    assert tuple(r) == (0, 1, 2, 73)
