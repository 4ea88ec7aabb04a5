"""Exact counts of splits and samples."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.constants import FEATURES
from wakeline.operators import split as P

T0 = dt.datetime(2024, 1, 1)
STRUCT = ", ".join(f"{f}: float" for f in FEATURES)


@pytest.fixture(scope="module")
def windows(spark):
    """400 windows of 37 trajectories; one trajectory holds a third of them."""
    n = F.col("id")
    traj = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), n % 36))
    step = lambda sog, dcog: F.struct(*[
        (sog if f == "sog" else dcog if f == "dcog" else F.lit(0.0)).cast("float").alias(f) for f in FEATURES])
    kind = n % 10
    sog = F.when(kind == 0, 20.0).when(kind == 1, 3.0).otherwise(15.0)
    dcog = F.when(kind <= 1, 1.0).otherwise(20.0 + n % 50)
    return spark.range(400).select(
        traj.alias("traj_id"), n.alias("mmsi"), (F.lit(T0) + F.make_dt_interval(F.lit(0), n.cast("int"))).cast("timestamp_ntz").alias("start_time"),
        F.array(step(sog, dcog), step(sog, dcog)).alias("hist"),
    ).cache()


@pytest.mark.parametrize("test,val,want", [(0.2, 0.1, (7, 3, 27)), (0.001, 0.001, (1, 1, 35)), (0.5, 0.0, (18, 0, 19))])
def test_split_counts(windows, test, val, want):
    out = P.split_groups(windows, test_fraction=test, val_fraction=val)
    groups = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("traj_id").alias("n")).collect()}
    n = windows.select("traj_id").distinct().count()
    assert n == 37 - 12 or n == 37 or n == 25
    total = sum(groups.values())
    assert total == n and out.count() == 400
    expect_test = max(1, int(n * test))
    expect_val = max(1, int(n * val)) if val > 0 else 0
    assert groups.get("test", 0) == expect_test and groups.get("val", 0) == expect_val
    assert out.groupBy("traj_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_split_is_stable_under_row_order(windows):
    key = lambda df: {r["traj_id"]: r["split"] for r in df.select("traj_id", "split").distinct().collect()}
    assert key(P.split_groups(windows)) == key(P.split_groups(windows.orderBy(F.rand(1))))


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (57, 57), (400, 400), (999, 400)])
def test_sample_exact(windows, n, want):
    s = P.sample_exact(windows, n, ("traj_id", "start_time"))
    assert s.count() == want and s.select("traj_id", "start_time").distinct().count() == want


@pytest.mark.parametrize("n", [20, 120, 390, 500])
def test_biased_sample_size(windows, n):
    s = P.sample_maneuver_biased(windows, n)
    assert s.select("traj_id", "start_time").distinct().count() == min(n, 400)


@pytest.mark.parametrize("n", [20, 100, 390, 500])
def test_stratified_sample_size(windows, n):
    s = P.sample_motion_stratified(windows, n)
    assert s.select("traj_id", "start_time").distinct().count() == min(n, 400)
    straight = s.filter(F.element_at("hist", 1)["sog"] == 20.0).count()
    assert straight >= min(40, round(n * 0.15))


def test_split_then_sample_touches_training_only(windows):
    full = P.split_groups(windows)
    some = P.split_then_sample(windows, 50)
    count = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(some)["train"] == 50
    assert {k: v for k, v in count(some).items() if k != "train"} == {k: v for k, v in count(full).items() if k != "train"}


def test_blocks_are_whole(windows):
    s = P.sample_blocks(windows, "traj_id", 30)
    whole = windows.join(s.select("traj_id").distinct(), "traj_id", "left_semi").count()
    assert s.count() == whole > 0


def test_scaler(spark, windows):
    scaler = P.fit_scaler(windows)
    scaled = P.apply_scaler(windows, scaler).select(F.explode("hist").alias("s"))
    r = scaled.agg(F.avg("s.sog").alias("m"), F.stddev_pop("s.sog").alias("d"), F.max("s.lat").alias("flat")).first()
    assert r["m"] == pytest.approx(0, abs=1e-5) and r["d"] == pytest.approx(1, abs=1e-5) and r["flat"] == 0.0
    stored = P.stored_scaler(spark, dict.fromkeys(FEATURES, 1.0), dict.fromkeys(FEATURES, 2.0))
    assert P.apply_scaler(windows, stored).first()["hist"][0]["lat"] == -0.5


def test_audit_draw(windows):
    flagged = windows.withColumn("removed", F.col("mmsi") % 4 == 0)
    counts = {r["removed"]: r["count"] for r in P.audit_draw(flagged, "removed", 11, ("mmsi",)).groupBy("removed").count().collect()}
    assert counts == {True: 6, False: 5}
