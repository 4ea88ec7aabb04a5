"""Cleaning on hand-made raw rows."""

from __future__ import annotations

import datetime as dt
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from wakeline.operators import clean as C
from wakeline.sources import ais_csv

BOX = (32.0, 49.5, -126.0, -117.0)
GOOD = dict(timestamp="2024-01-01T00:00:00", mmsi="100", lat="40.0", lon="-120.0", sog="10", cog="90", heading="91", vessel_type="70")


def raw(spark, *changes):
    names = list(GOOD)
    return spark.createDataFrame([tuple({**GOOD, **c}[n] for n in names) for c in changes], ", ".join(f"{n} string" for n in names))


def cleaned(spark, *changes, **kw):
    return C.clean(raw(spark, *changes), BOX, **kw).collect()


@pytest.mark.parametrize(
    "change,kept",
    [
        ({}, True),
        ({"timestamp": "not a time"}, False),
        ({"lat": "abc"}, False),
        ({"mmsi": "0"}, False),
        ({"mmsi": ""}, False),
        ({"mmsi": "100.0"}, True),
        ({"lat": "32.0"}, True),
        ({"lat": "31.9999"}, False),
        ({"lon": "-117.0"}, True),
        ({"lon": "-116.99"}, False),
        ({"sog": "102.2"}, True),
        ({"sog": "102.3"}, False),
        ({"sog": ""}, True),
        ({"cog": "360"}, True),
        ({"cog": "360.1"}, False),
        ({"vessel_type": "29"}, False),
        ({"vessel_type": "30"}, True),
        ({"vessel_type": "39"}, True),
        ({"vessel_type": "40"}, False),
        ({"vessel_type": "49"}, False),
        ({"vessel_type": "50"}, True),
        ({"vessel_type": "89"}, True),
        ({"vessel_type": "90"}, False),
        ({"vessel_type": ""}, False),
        ({"sog": "NaN"}, True),
    ],
)
def test_validity(spark, change, kept):
    assert bool(cleaned(spark, change)) is kept


def test_repairs(spark):
    rows = cleaned(
        spark,
        {"mmsi": "1", "sog": ""},
        {"mmsi": "2", "cog": "", "heading": "123"},
        {"mmsi": "3", "cog": "", "heading": "511"},
        {"mmsi": "4", "timestamp": "2024-01-01T05:00:00+05:00"},
        {"mmsi": "5", "timestamp": "2024-01-01 00:00:00Z"},
    )
    by = {r["mmsi"]: r for r in rows}
    assert by[1]["sog"] == 0.0 and by[2]["sog"] == pytest.approx(18.52)
    assert by[2]["cog"] == 123.0
    assert by[3]["cog"] == 0.0 and by[3]["heading"] is None
    assert by[4]["timestamp"] == by[5]["timestamp"] == dt.datetime(2024, 1, 1)


def test_deduplicate_is_global_and_deterministic(spark):
    rows = cleaned(spark, {"lat": "41"}, {"lat": "40"}, {"lat": "42"})
    assert [r["lat"] for r in rows] == [40.0]


def test_danish_ship_types(spark):
    danish = {"timestamp": "31/01/2024 10:20:30"}
    rows = cleaned(
        spark,
        {**danish, "mmsi": "1", "vessel_type": "  Cargo "},
        {**danish, "mmsi": "2", "vessel_type": "Fishing"},
        source="danish",
        timestamp_format=ais_csv.DANISH_TIMESTAMP,
    )
    assert [(r["mmsi"], r["vessel_type"], r["timestamp"]) for r in rows] == [(1, "Cargo", dt.datetime(2024, 1, 31, 10, 20, 30))]


def test_header_mapping():
    assert ais_csv.map_header(["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselType"])[0] == "noaa"
    assert ais_csv.map_header(["# Timestamp", "MMSI", "Latitude", "Longitude", "SOG", "COG", "Heading", "Ship type"])[0] == "danish"
    with pytest.raises(ValueError, match="heading"):
        ais_csv.map_header(["mmsi", "base_date_time", "latitude", "longitude", "sog", "cog", "vessel_type"])
    with pytest.raises(ValueError, match="Cannot tell"):
        ais_csv.map_header(["a", "b", "c"])


def test_reads_zstd_csv(spark, tmp_path):
    text = "mmsi,base_date_time,latitude,longitude,sog,cog,heading,vessel_type\n7,2024-01-01 00:00:00,40,-120,1,2,3,70\n"
    with open(tmp_path / "day.csv.zst", "wb") as f:
        with zstandard.ZstdCompressor().stream_writer(f) as z:
            z.write(text.encode())
    frame, source, _ = ais_csv.read_raw(spark, str(tmp_path))
    assert source == "noaa" and frame.first()["mmsi"] == "7"
    assert io.StringIO(text).readline()


def test_another_column_order_in_the_folder_is_mapped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,base_date_time,latitude,longitude,sog,cog,heading,vessel_type\n" + "7,2024-01-01 00:00:00,40,-120,1,2,3,70\n" * 3)
    (tmp_path / "b.csv").write_text("mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_type\n7,2024-01-01 00:00:00,-120,40,1,2,3,70\n")
    frame, _, _ = ais_csv.read_raw(spark, str(tmp_path))
    assert [tuple(r) for r in frame.select("lat", "lon").collect()] == [("40", "-120")] * 4


def test_region_and_bounds():
    assert C.resolve_bounds("gulf", lat_max=30.0) == (24.0, 30.0, -98.0, -80.0)
    with pytest.raises(ValueError):
        C.resolve_bounds("atlantis")
    with pytest.raises(ValueError):
        C.resolve_bounds(lat_min=1.0)


def test_fill_motion_columns_without_course(spark):
    row = C.fill_motion_columns(spark.range(1).select(F.lit(1.0).alias("sog"))).first()
    assert (row["v_north_kmh"], row["v_east_kmh"]) == (0.0, 0.0)
