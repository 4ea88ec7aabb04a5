"""Streams equal batches, days are ingested once, and whole jobs run."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.operators import clean as C, segment as G
from wakeline.plans import adapter as A, jobs
from wakeline.plans.increments import SegmentState
from wakeline.sources import ais_csv, datasets, days, scratch, tables
from wakeline.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing") / "raw")
    ais_csv.write_raw_csv(A.raw_reports(spark, SF).repartition(3, "timestamp"), path)
    return path


def columns(spark, path):
    return spark.read.option("header", True).csv(path).columns


def same(got, want):
    want = want.select(got.columns)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_equals_batch(spark, landing, tmp_path):
    stream = lambda **k: ingest.clean_stream(spark, landing, columns(spark, landing), A.BOX, commercial_only=False, **k)
    out, ckpt = str(tmp_path / "points"), str(tmp_path / "ckpt")
    ingest.write_points(stream(files_per_batch=1), out, ckpt).awaitTermination()
    same(ingest.read_points(spark, out).drop("lat", "lon"), A.points(spark, SF))
    n = spark.read.parquet(out).count()
    ingest.write_points(stream(), out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == n


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, mmsi string, lat string, lon string, sog string, cog string, heading string, vessel_type string")


def test_a_late_file_loses_nothing(spark, tmp_path):
    def day(n):
        return raw_rows(spark, [(f"2024-01-{n:02d}T{h:02d}:00:00", "7", "40.0", "-70.0", "5", "10", "", "70") for h in range(24)])

    path, out = str(tmp_path / "raw"), str(tmp_path / "points")
    for n in (10, 5):
        ais_csv.write_raw_csv(day(n).coalesce(1), f"{path}/{n}")
        stream = ingest.clean_stream(spark, path, columns(spark, f"{path}/{n}"), A.BOX)
        ingest.write_points(stream, out, str(tmp_path / "ckpt")).awaitTermination()
    assert ingest.read_points(spark, out).count() == 48


def test_another_header_stops_the_stream(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw = raw_rows(spark, [("2024-01-01T00:00:00", "7", "37.0", "-72.0", "5", "10", "", "70")])
    ais_csv.write_raw_csv(raw, f"{path}/a")
    named = columns(spark, f"{path}/a")
    swapped = ["timestamp", "mmsi", "lon", "lat", "sog", "cog", "heading", "vessel_type"]
    ais_csv.write_raw_csv(raw, f"{path}/b", in_order=swapped)
    stream = ingest.clean_stream(spark, path, named, A.BOX)
    with pytest.raises(Exception, match="header"):
        ingest.write_points(stream, str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()


def test_each_file_has_its_own_header(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw = raw_rows(spark, [("2024-01-01T00:00:00", "7", "37.0", "-72.0", "5", "10", "", "70")])
    ais_csv.write_raw_csv(raw, f"{path}/a", "noaa_old")
    ais_csv.write_raw_csv(raw, f"{path}/b b", in_order=["timestamp", "mmsi", "lon", "lat", "sog", "cog", "heading", "vessel_type"])
    found, source, fmt = ais_csv.read_raw(spark, path)
    assert (source, fmt) == ("noaa", None)
    assert [(r.lat, r.lon, r.mmsi) for r in found.collect()] == [("37.0", "-72.0", "7")] * 2
    (tmp_path / "raw" / "c.csv").write_text("mmsi,base_date_time,latitude\n7,2024-01-01T00:00:00,37\n")
    with pytest.raises(ValueError, match=r"c\.csv.*lon"):
        ais_csv.read_raw(spark, path)


def test_streamed_segments_equal_batch(spark, landing, tmp_path):
    stream = ingest.clean_stream(spark, landing, columns(spark, landing), A.BOX, commercial_only=False, files_per_batch=1)
    segments = str(tmp_path / "segments")
    ingest.write_segments(stream, str(tmp_path / "points"), segments, str(tmp_path / "ckpt"), A.SEGMENTS, vessel_groups=4).awaitTermination()
    same(spark.read.parquet(segments).select("traj_id", "timestamp", "dt_sec"), A.segments(spark, SF))


def test_followed_segments_equal_batch_for_files_in_any_order(spark, landing, tmp_path):
    stream = lambda: ingest.clean_stream(spark, landing, columns(spark, landing), A.BOX, commercial_only=False, files_per_batch=1)
    root = str(tmp_path / "state")
    ingest.follow_segments(stream(), root, str(tmp_path / "ckpt"), A.SEGMENTS).awaitTermination()
    state = SegmentState(spark, root, A.SEGMENTS)
    assert len(state.sources()) > 1
    same(state.segments().select("traj_id", "timestamp", "dt_sec"), A.segments(spark, SF))
    # a lost query starts over with the same batches: none is added twice
    ingest.follow_segments(stream(), root, str(tmp_path / "ckpt-2"), A.SEGMENTS).awaitTermination()
    assert SegmentState(spark, root, A.SEGMENTS).held == state.held


def test_followed_segments_read_only_the_days_a_batch_touches(spark, tmp_path):
    cfg = G.SegmentConfig(max_gap_hours=3.0, max_speed_kmh=90.0, min_points=5, min_hours=4.0, min_distance_km=1.0)
    hours = lambda n: [(f"2024-01-{n:02d}T{h:02d}:00:00", "7", f"{36 + h / 10}", "-70.0", "5", "10", "", "70") for h in range(0, 8)]
    path, root, ckpt = (str(tmp_path / p) for p in ("raw", "state", "ckpt"))
    held = []
    for n in (1, 2, 9, 5):
        ais_csv.write_raw_csv(raw_rows(spark, hours(n)).coalesce(1), f"{path}/{n}")
        stream = ingest.clean_stream(spark, path, columns(spark, f"{path}/{n}"), A.BOX)
        ingest.follow_segments(stream, root, ckpt, cfg).awaitTermination()
        held.append(SegmentState(spark, root, cfg).held)
    day = (dt.date(2024, 1, 2) - dt.date(1970, 1, 1)).days
    # the late file of day 5 renumbers day 9 after it; reports, summaries and segments of days 1 and 2 stay
    for table in ("points", "summaries", "segments"):
        assert held[3][table, day] == held[1][table, day]
        assert held[3][table, day - 1] == held[0][table, day - 1]
    assert held[3]["points", day + 7] == held[2]["points", day + 7] and held[3]["segments", day + 7] > held[2]["segments", day + 7]
    want = G.build_segments(C.deduplicate(SegmentState(spark, root, cfg)._read("points", ingest.clean_stream(spark, path, columns(spark, path + "/1"), A.BOX).schema)), cfg)
    same(SegmentState(spark, root, cfg).segments().select("traj_id", "timestamp", "dt_sec"), want)


def test_a_group_without_segments_is_emptied(spark, tmp_path):
    """Later reports break the only segment of a vessel into parts that are too short."""
    cfg = G.SegmentConfig(max_gap_hours=3.0, max_speed_kmh=90.0, min_points=5, min_hours=4.0, min_distance_km=1.0)
    path, seg, pts, ckpt = (str(tmp_path / p) for p in ("raw", "seg", "pts", "ckpt"))
    first = [(f"2024-01-01T{h:02d}:00:00", "7", f"{40 + h / 10}", "-70.0", "5", "10", "", "70") for h in range(0, 7)]
    jumps = [(f"2024-01-01T{h:02d}:30:00", "7", "46.0", "-70.0", "5", "10", "", "70") for h in range(0, 7)]
    counts = []
    for k, rows in enumerate((first, jumps)):
        ais_csv.write_raw_csv(raw_rows(spark, rows).coalesce(1), f"{path}/{k}")
        stream = ingest.clean_stream(spark, path, columns(spark, f"{path}/{k}"), A.BOX)
        ingest.write_segments(stream, pts, seg, ckpt, cfg, vessel_groups=2).awaitTermination()
        stored = spark.read.schema("traj_id string").option("recursiveFileLookup", True).parquet(seg)
        counts.append(stored.count())
    assert counts[0] > 0 and counts[1] == 0


def test_days_are_done_once(spark, tmp_path):
    pts, root, asked = A.points(spark, SF), str(tmp_path / "days"), []

    def of(wanted):
        asked.append(list(wanted))
        return pts.withColumn("file_day", F.to_date("timestamp")).filter(F.col("file_day").isin(*wanted))

    start = dt.date(2024, 1, 1)
    assert len(days.ingest_days(spark, root, start, start + dt.timedelta(days=3), of)) == 4
    assert days.ingest_days(spark, root, start, start + dt.timedelta(days=3), of) == []
    assert days.ingest_days(spark, root, start, start + dt.timedelta(days=5), of) == [start + dt.timedelta(days=4), start + dt.timedelta(days=5)]
    assert [len(a) for a in asked] == [4, 2]
    want = pts.filter(F.to_date("timestamp") <= F.lit(start + dt.timedelta(days=5)))
    assert days.read_days(spark, root).count() == want.count()
    assert days.dataset_label("gulf", "30d") == "gulf_30d" and days.dataset_label("gulf", None) == "gulf"


def test_a_stray_report_keeps_the_days_before(spark, tmp_path):
    """A report of day 1 in the file of day 2 does not replace the folder of day 1."""
    root, one, two = str(tmp_path / "days"), dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [(one, 7, dt.datetime(2024, 1, 1, h)) for h in range(5)] + [(two, 7, dt.datetime(2024, 1, 2, 3)), (two, 7, dt.datetime(2024, 1, 1, 23))]
    table = spark.createDataFrame(rows, "file_day date, mmsi long, timestamp timestamp_ntz").withColumn("lat", F.lit(1.0))
    of = lambda wanted: table.filter(F.col("file_day").isin(*wanted))
    days.ingest_days(spark, root, one, one, of)
    days.ingest_days(spark, root, one, two, of)
    assert days.read_days(spark, root).count() == 7


def test_shared_folder_is_required_off_local(spark):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[4]"})
    assert scratch.shared_dir(Session()) == Session.conf["spark.checkpoint.dir"]


def test_raw_to_windows_job(spark, landing, tmp_path):
    cfg = jobs.WindowConfig(resample_minutes=A.STEP_MINUTES, cap=20)
    paths = jobs.raw_to_windows(spark, landing, str(tmp_path / "out"), A.BOX, commercial_only=False, segment_cfg=A.SEGMENTS, window_cfg=cfg)
    windows = spark.read.parquet(paths["windows"])
    assert windows.count() > 0 and windows.groupBy("traj_id").count().agg(F.max("count")).first()[0] <= 20
    assert spark.read.parquet(paths["segments"]).count() == A.segments(spark, SF).count()
    table = jobs.training_table(windows, step_minutes=A.STEP_MINUTES)
    assert set(table.columns) == {*windows.columns, "split"} and table.count() > 0
    trajectories, vessels = jobs.audit_tables(spark.read.parquet(paths["segments"]), cfg)
    assert trajectories.count() >= vessels.count() > 0


def test_rebuild_skips_finished(spark, tmp_path):
    root = str(tmp_path / "sets")
    one, two = (lambda: spark.range(3)), (lambda: spark.range(5))
    assert datasets.rebuild(spark, {"a": one}, root) == ["a"]
    assert datasets.rebuild(spark, {"a": two, "b": two}, root) == ["b"]
    assert spark.read.parquet(f"{root}/a").count() == 3
    assert datasets.rebuild(spark, {"a": two}, root, overwrite=True) == ["a"]
    assert spark.read.parquet(f"{root}/a").count() == 5


def test_key_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "seg")
    tables.write_table(A.segments(spark, SF), path, compression="zstd")
    df = tables.read_keys(spark, path, "traj_id", ["1_1", "2_1"]).select("traj_id", "lat")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(traj_id" in plan and "ReadSchema: struct<lat:double,traj_id:string>" in plan


def test_misplaced_and_short_datasets(spark, tmp_path):
    for place in ("West Coast/ais_west_coast_30d_long_horizon", "West Coast/ais_east_coast_30d_long_horizon", "Eastern coast/ais_east_coast_1d_long_horizon"):
        spark.range(2).select(F.col("id").alias("traj_id")).write.parquet(str(tmp_path / place / "w"))
    kept = datasets.read_datasets(spark, str(tmp_path))
    assert {(r["region"], r["tag"]) for r in kept.select("region", "tag").distinct().collect()} == {("west_coast", "30d")}
    assert dict(kept.dtypes)["traj_id"] == "string"
    assert datasets.read_datasets(spark, str(tmp_path), include_misplaced=True).count() == 4


def test_hot_vessel_is_spread(spark):
    """One vessel holds a third of the rows; its rows still fall in many partitions."""
    n = F.col("id")
    rows = spark.range(30_000).select(
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), (n * 30).cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        F.when(n % 3 == 0, F.lit(1)).otherwise(2 + n % 50).cast("bigint").alias("mmsi"),
        (F.lit(40.0) + n * 1e-6).alias("lat"), F.lit(-70.0).alias("lon"), F.lit(5.0).alias("sog"), F.lit(10.0).alias("cog"),
        F.lit(None).cast("double").alias("heading"), F.lit("70").alias("vessel_type"),
    )
    segmented = G.segment_points(C.deduplicate(rows), G.SegmentConfig(chunk_hours=6))
    parts = segmented.filter("mmsi = 1").select(F.spark_partition_id().alias("p"), "segment_id").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 10_000
    assert segmented.filter("mmsi = 1").agg(F.max("segment_id")).first()[0] == 1
