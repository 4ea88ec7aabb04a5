"""Tables laid out by key, lines in parts, and picks by many rules in one pass."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.operators import routes as V
from wakeline.sources import tables


def scanned_rows(df) -> int:
    """Rows that the scan of a collected frame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_keyed_reads_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "keyed")
    hot = F.when(F.col("id") % 3 == 0, F.lit("k0")).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    df = spark.range(200_000).select(hot.alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or the small table is one file
    tables.write_by_key(df.repartition(7), path, "k", "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(path).filter("k = 'k0'").select(F.input_file_name().alias("f")).distinct().count()
    assert parts > 1  # a key with a third of the rows is spread
    keys = spark.createDataFrame([("k77",), ("k78",), ("no such key",), (None,), ("k77",)], "k string")
    found = tables.read_by_keys(spark, path, "k", keys)
    want = df.filter(F.col("k").isin("k77", "k78"))
    assert sorted(found.collect()) == sorted(want.collect())
    assert scanned_rows(found) < 100_000
    nothing = tables.read_by_keys(spark, path, "k", spark.createDataFrame([("k77x",)], "k string"))
    assert nothing.collect() == [] and scanned_rows(nothing) == 0  # within the range of keys, not in a Bloom filter
    many = df.select("k").distinct()
    assert tables.read_by_keys(spark, path, "k", many, listed=20).count() == 200_000
    assert tables.read_by_keys(spark, path, "k", many, listed=1000).count() == 200_000
    assert tables.read_by_keys(spark, path, "k", many.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2, 3, 7, 100])
def test_parts_draw_the_whole_line(spark, size):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{t}", start + dt.timedelta(hours=5 * i), 10.0 + i / 100, 20.0 + t) for t, n in enumerate((1, 2, 7, 15)) for i in range(n)]
    segments = spark.createDataFrame(rows[::-1], "traj_id string, timestamp timestamp_ntz, lat double, lon double")
    parts = V.polyline_parts(segments, size).orderBy("traj_id", "part").collect()
    lines: dict[str, list[str]] = {}
    for r in parts:
        points = r["wkt"].removeprefix("LINESTRING (").removesuffix(")").split(", ")
        assert 2 <= len(points) == r["n_points"] <= size + 1
        line = lines.setdefault(r["traj_id"], [])
        assert not line or line[-1] == points[0]
        line += points[1:] if line else points
    want = {}
    for traj, _, lat, lon in rows:
        want.setdefault(traj, []).append(f"{lon:.5f} {lat:.5f}")
    assert lines == {t: w for t, w in want.items() if len(w) > 1}


def plain_picks(rows: list[dict], n: int) -> list[tuple]:
    out, used = [], set()

    def take(label, cls, low, high, k, order):
        fits = [r for r in rows if r["net_km"] >= 45 and r[cls] and (low is None or r["err_km"] >= low) and (high is None or r["err_km"] < high) and r["window_id"] not in used]
        for r in sorted(fits, key=lambda r: (-r[order], r["window_id"]))[: max(k, 0)]:
            used.add(r["window_id"])
            out.append((label, r["window_id"]))

    for rule in V.SHAPE_RULES:
        take(*rule)
    take("Maneuver (extra)", "maneuver", None, None, n - len(out), "maneuver_score")
    take("Extra track", "mid", None, None, n - len(out), "net_km")
    return out[:n]


@pytest.mark.parametrize("n,rows", [(15, 400), (15, 6), (40, 300), (3, 50)])
def test_picks_by_shape_equal_rules_one_by_one(spark, n, rows):
    shapes = spark.range(rows).select(
        F.concat(F.lit("w"), "id").alias("window_id"),
        (F.pmod(F.xxhash64("id"), F.lit(120)) / 1.0).alias("net_km"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("directness"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(30)) / 1.0).alias("cross_track_km"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(180)) / 1.0).alias("turn_deg"),
        (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10)) / 1.0).alias("maneuver_score"),
        (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(80)) / 1.0).alias("err_km"),
    )
    plain = [
        r.asDict() | {"straight": r.is_straight, "maneuver": r.is_maneuver} for r in V.shape_classes(shapes).collect()
    ]
    got = V.picks_by_shape(shapes, n).orderBy("place").collect()
    assert [(r["rule"], r["window_id"]) for r in got] == plain_picks(plain, n)
    assert [r["place"] for r in got] == list(range(len(got)))
