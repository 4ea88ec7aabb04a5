"""Sources, cleaning and segmentation checked from the raw reports on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.catalog.base import query
from wakeline.constants import REGIONS
from wakeline.functions.vessel import is_commercial, vessel_class, vessel_label
from wakeline.operators import clean as C, segment as G
from wakeline.operators.windows import feature_columns
from wakeline.functions.ranking import percentile_columns
from wakeline.plans import adapter as A
from wakeline.sources import ais_csv, tables
from wakeline.sources.scratch import new_path

POINT = "timestamp:t mmsi:i lat:d lon:d sog:d cog:d heading:d vessel_type:s"
POINT_SQL = "SELECT timestamp, mmsi, lat, lon, sog, cog, heading, vessel_type FROM {}"
EAST = REGIONS["east_coast"]


def _csv(spark: SparkSession, sf: str, style: str, compression: str | None = None) -> DataFrame:
    """Raw reports written as CSV and read back through the source."""
    path = new_path(spark, f"csv-{style}")
    ais_csv.write_raw_csv(A.raw_reports(spark, sf), path, style, compression)
    raw, source, fmt = ais_csv.read_raw(spark, path)
    return C.clean(raw, A.BOX, source=source, timestamp_format=fmt, commercial_only=False)


@query("s01_scan_csv_plain", POINT, POINT_SQL.format("points"))
def s01_plain(spark, sf):
    return _csv(spark, sf, "noaa_new")


@query("s01_scan_csv_gzip", POINT, POINT_SQL.format("points"))
def s01_gzip(spark, sf):
    return _csv(spark, sf, "noaa_new", "gzip")


@query("s02_header_old_noaa", POINT, POINT_SQL.format("points"))
def s02_old(spark, sf):
    return _csv(spark, sf, "noaa_old")


@query(
    "s02_header_danish",
    POINT,
    "SELECT timestamp, mmsi, lat, lon, sog, cog, heading, 'Cargo' AS vessel_type FROM points",
)
def s02_danish(spark, sf):
    raw = A.raw_reports(spark, sf)
    stamp = F.date_format(C.parse_timestamp(F.col("timestamp")).cast("timestamp"), "dd/MM/yyyy HH:mm:ss")
    path = new_path(spark, "csv-danish")
    ais_csv.write_raw_csv(
        raw.withColumn("timestamp", F.coalesce(stamp, F.lit("n/a"))).withColumn("vessel_type", F.lit(" Cargo ")),
        path,
        "danish",
    )
    back, source, fmt = ais_csv.read_raw(spark, path)
    return C.clean(back, A.BOX, source=source, timestamp_format=fmt)


@query("c01_parse_timestamp", "year_day:i n:i bad:i", """
    SELECT coalesce(dayofyear(timestamp), 0) AS year_day, count(*) AS n, sum(CASE WHEN timestamp IS NULL THEN 1 ELSE 0 END) AS bad
    FROM raw GROUP BY 1""")
def c01(spark, sf):
    ts = C.parse_timestamp(F.col("timestamp"))
    return A.raw_reports(spark, sf).select(ts.alias("ts")).groupBy(
        F.coalesce(F.dayofyear("ts"), F.lit(0)).alias("year_day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ts").isNull().cast("int")).alias("bad"))


@query("c02_coerce_numbers", "lat_missing:i sog_missing:i cog_missing:i lat_sum:d sog_sum:d", """
    SELECT sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) AS lat_missing, sum(CASE WHEN sog IS NULL THEN 1 ELSE 0 END) AS sog_missing,
           sum(CASE WHEN cog IS NULL THEN 1 ELSE 0 END) AS cog_missing, round(sum(lat), 3) AS lat_sum, round(sum(sog), 3) AS sog_sum FROM raw""")
def c02(spark, sf):
    n = A.raw_reports(spark, sf).select(*[C.number(F.col(c)).alias(c) for c in ("lat", "sog", "cog")])
    missing = [F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_missing") for c in ("lat", "sog", "cog")]
    return n.agg(*missing, F.round(F.sum("lat"), 3).alias("lat_sum"), F.round(F.sum("sog"), 3).alias("sog_sum"))


def _norm(spark, sf):
    return C.normalize(A.raw_reports(spark, sf))


@query("c03_heading_sentinel", "mmsi:i n:i missing:i", """
    SELECT mmsi, count(*) AS n, sum(CASE WHEN heading IS NULL THEN 1 ELSE 0 END) AS missing FROM norm GROUP BY mmsi""")
def c03(spark, sf):
    raw = A.raw_reports(spark, sf)
    h = C.heading_or_null(C.number(F.col("heading")))
    return raw.select(C.number(F.col("mmsi"), "bigint").alias("mmsi"), h.alias("h")).groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").isNull().cast("int")).alias("missing")
    )


@query("c04_speed_to_kmh", "mmsi:i total:d peak:d", "SELECT mmsi, sum(sog) AS total, max(sog) AS peak FROM norm GROUP BY mmsi")
def c04(spark, sf):
    return _norm(spark, sf).groupBy("mmsi").agg(F.sum("sog").alias("total"), F.max("sog").alias("peak"))


@query("c05_course_fallback", "mmsi:i total:d zero:i", """
    SELECT mmsi, sum(cog) AS total, sum(CASE WHEN cog = 0 THEN 1 ELSE 0 END) AS zero FROM norm GROUP BY mmsi""")
def c05(spark, sf):
    return _norm(spark, sf).groupBy("mmsi").agg(
        F.sum("cog").alias("total"), F.sum((F.col("cog") == 0).cast("int")).alias("zero")
    )


@query("c06_validity", POINT, POINT_SQL.format("valid"))
def c06(spark, sf):
    return _norm(spark, sf).filter(C.is_valid(A.BOX))


@query("c07_commercial_codes", POINT, POINT_SQL.format("valid WHERE code BETWEEN 30 AND 39 OR code BETWEEN 50 AND 89"))
def c07(spark, sf):
    return _norm(spark, sf).filter(C.is_valid(A.BOX)).filter(is_commercial(F.col("vessel_type_code"), F.col("vessel_type")))


SHIP_TYPE = "CASE c_custkey % 9 WHEN 0 THEN 'Cargo' WHEN 1 THEN ' Tanker ' WHEN 2 THEN 'Passenger' WHEN 3 THEN 'Towing' WHEN 4 THEN 'Tug' WHEN 5 THEN 'Port tender' WHEN 6 THEN 'Dredging' WHEN 7 THEN 'Fishing' ELSE NULL END"


@query("c08_commercial_ship_types", "ship_type:s n:i", f"""
    SELECT trim({SHIP_TYPE}) AS ship_type, count(*) AS n FROM customer
    WHERE trim({SHIP_TYPE}) IN ('Cargo', 'Tanker', 'Passenger', 'Towing', 'Tug', 'Port tender', 'Dredging') GROUP BY 1""")
def c08(spark, sf):
    types = spark.read.parquet(f"{sf}/customer.parquet").select(F.trim(F.expr(SHIP_TYPE)).alias("ship_type"))
    return types.filter(is_commercial(F.lit(None).cast("int"), F.col("ship_type"))).groupBy("ship_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("c09_deduplicate", POINT, POINT_SQL.format("points"))
def c09(spark, sf):
    return A.points(spark, sf)


@query("c10_resolve_region", "n:i lat_low:d lat_high:d", f"""
    SELECT count(*) AS n, min(lat) AS lat_low, max(lat) AS lat_high FROM norm
    WHERE timestamp IS NOT NULL AND mmsi > 0 AND lat BETWEEN {EAST[0]} AND 40.0 AND lon BETWEEN {EAST[2]} AND {EAST[3]}
      AND sog BETWEEN 0 AND 189.2744 AND cog BETWEEN 0 AND 360""")
def c10(spark, sf):
    bounds = C.resolve_bounds("east_coast", lat_max=40.0)
    return _norm(spark, sf).filter(C.is_valid(bounds)).agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("lat_low"), F.max("lat").alias("lat_high")
    )


@query("c11_frame_flag", "mmsi:i n:i inside:i", f"""
    SELECT mmsi, count(*) AS n, sum(CASE WHEN lat BETWEEN {EAST[0]} AND {EAST[1]} AND lon BETWEEN {EAST[2]} AND {EAST[3]} THEN 1 ELSE 0 END) AS inside
    FROM points GROUP BY mmsi""")
def c11(spark, sf):
    return C.flag_in_frame(A.points(spark, sf), EAST).groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("in_frame").cast("int")).alias("inside")
    )


_regions_sql = ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in REGIONS.items())


@query("c11_regions_of_points", "region:s n:i vessels:i", f"""
    SELECT region, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM points
    JOIN (VALUES {_regions_sql}) r(region, a, b, c, d) ON lat BETWEEN a AND b AND lon BETWEEN c AND d GROUP BY region""")
def c11_many(spark, sf):
    return C.regions_of_points(A.points(spark, sf)).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels")
    )


@query("c12_fill_velocity", "mmsi:i north:d east:d", """
    SELECT mmsi, sum(sog * 1.852::DOUBLE * cos(radians(cog))) AS north, sum(sog * 1.852::DOUBLE * sin(radians(cog))) AS east FROM points GROUP BY mmsi""")
def c12(spark, sf):
    old = A.points(spark, sf).select(
        "mmsi", "sog", F.cos(F.radians("cog")).alias("cog_cos"), F.sin(F.radians("cog")).alias("cog_sin")
    )
    return C.fill_motion_columns(old).groupBy("mmsi").agg(F.sum("v_north_kmh").alias("north"), F.sum("v_east_kmh").alias("east"))


@query("c13_feature_aliases", "mmsi:i north:d", "SELECT mmsi, sum(sog * cos(radians(cog))) AS north FROM points GROUP BY mmsi")
def c13(spark, sf):
    old = A.points(spark, sf).select("mmsi", (F.col("sog") * F.cos(F.radians("cog"))).alias("v_north_knots"))
    name = feature_columns(old.columns)["v_north_kmh"]
    return old.groupBy("mmsi").agg(F.sum(name).alias("north"))


_label_sql = """CASE WHEN vessel_type IS NULL THEN 'Unknown' WHEN code = 30 THEN 'Fishing' WHEN code = 31 THEN 'Towing' WHEN code = 32 THEN 'Towing (large)'
    WHEN code = 33 THEN 'Dredging' WHEN code = 34 THEN 'Diving' WHEN code = 35 THEN 'Military' WHEN code = 36 THEN 'Sailing' WHEN code = 37 THEN 'Pleasure craft'
    WHEN code = 50 THEN 'Pilot' WHEN code = 51 THEN 'SAR' WHEN code = 52 THEN 'Tug' WHEN code = 53 THEN 'Port tender' WHEN code = 54 THEN 'Pollution control'
    WHEN code = 55 THEN 'Law enforcement' WHEN code = 58 THEN 'Medical' WHEN code = 59 THEN 'Special craft'
    WHEN code BETWEEN 60 AND 69 THEN 'Passenger' WHEN code BETWEEN 70 AND 79 THEN 'Cargo' WHEN code BETWEEN 80 AND 89 THEN 'Tanker'
    WHEN code BETWEEN 30 AND 39 THEN 'Special / fishing' WHEN code BETWEEN 50 AND 59 THEN 'Special craft' ELSE 'Type ' || code END"""


@query("c14_vessel_label", "label:s n:i", f"SELECT {_label_sql} AS label, count(*) AS n FROM norm GROUP BY 1")
def c14(spark, sf):
    return _norm(spark, sf).select(vessel_label(F.col("vessel_type")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("c15_vessel_class", "cls:i n:i", """
    SELECT CASE WHEN code IS NULL THEN 0 WHEN code BETWEEN 60 AND 69 THEN 1 WHEN code BETWEEN 70 AND 79 THEN 2 WHEN code BETWEEN 80 AND 89 THEN 3
           WHEN code BETWEEN 50 AND 59 THEN 4 WHEN code BETWEEN 30 AND 39 THEN 5 WHEN code BETWEEN 20 AND 29 THEN 6 WHEN code BETWEEN 40 AND 49 THEN 7 ELSE 8 END AS cls,
           count(*) AS n FROM norm GROUP BY 1""")
def c15(spark, sf):
    return _norm(spark, sf).groupBy(vessel_class(F.col("vessel_type_code")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("c16_clip", "mmsi:i total:d", "SELECT mmsi, sum(least(greatest(sog, 2.0::DOUBLE), 55.56::DOUBLE)) AS total FROM points GROUP BY mmsi")
def c16(spark, sf):
    return A.points(spark, sf).groupBy("mmsi").agg(F.sum(C.clip(F.col("sog"), 2.0, 55.56)).alias("total"))


@query("c17_swapped_positions", "n_points:i lat_lon_equal_frac:d median_lat:d median_lon:d plausible:b", """
    SELECT n_points, lat_lon_equal_frac, median_lat, median_lon,
           median_lat BETWEEN 10 AND 55 AND median_lon BETWEEN -130 AND -65 AND lat_lon_equal_frac < 0.05 AS plausible
    FROM (SELECT count(*) AS n_points, avg(CASE WHEN round(lat, 4) = round(lon, 4) THEN 1.0 ELSE 0.0 END) AS lat_lon_equal_frac,
                 quantile_cont(lat, 0.5) AS median_lat, quantile_cont(lon, 0.5) AS median_lon
          FROM (SELECT lat, CASE WHEN mmsi % 17 = 0 THEN lat ELSE lon END AS lon FROM points))""")
def c17(spark, sf):
    pts = A.points(spark, sf).select("lat", F.when(F.col("mmsi") % 17 == 0, F.col("lat")).otherwise(F.col("lon")).alias("lon"))
    return C.swapped_position_check(pts, percentile_columns)


ID = "mmsi:i timestamp:t "


def _feature(name: str, spec: str, columns: str):
    """A query on columns of the segmented points, whole table."""

    @query(name, ID + spec, f"SELECT mmsi, timestamp, {columns} FROM numbered")
    def run(spark, sf):
        return G.segment_points(A.points(spark, sf), A.SEGMENTS)

    return run


_feature("f01_previous_report", "prev_timestamp:t prev_lat:d prev_lon:d prev_sog:d prev_cog:d", "prev_timestamp, prev_lat, prev_lon, prev_sog, prev_cog")
_feature("f02_time_step", "dt_sec:d dt_hours:d", "dt_sec, dt_hours")
_feature("f03_step_distance", "dist_km:d", "dist_km")
_feature("f04_implied_speed", "speed_between_kmh:d", "speed_between_kmh")
_feature("f05_deltas", "dlat:d dlon:d dsog:d", "dlat, dlon, dsog")
_feature("f06_course_change", "dcog:d", "dcog")
_feature("f07_course_vectors", "cog_sin:d cog_cos:d v_north_kmh:d v_east_kmh:d", "cog_sin, cog_cos, v_north_kmh, v_east_kmh")
_feature("f08_heading", "heading_missing:i heading:d heading_sin:d heading_cos:d", "heading_missing, heading, heading_sin, heading_cos")
_feature("g01_break_flag", "new_segment:i", "new_segment")
_feature("g02_segment_number", "segment_id:i", "segment_id")
_feature("g03_trajectory_id", "traj_id:s", "traj_id")


@query("g04_drop_invalid_steps", ID + "traj_id:s dt_sec:d dist_km:d", "SELECT mmsi, timestamp, traj_id, dt_sec, dist_km FROM usable")
def g04(spark, sf):
    return G.drop_invalid_steps(G.segment_points(A.points(spark, sf), A.SEGMENTS), A.SEGMENTS)


STATS = "traj_id:s mmsi:i n_points:i start_time:t end_time:t mean_sog:d median_dt_sec:d total_distance_km:d duration_hours:d"


@query("g05_trajectory_stats", STATS, "SELECT * FROM stats")
def g05(spark, sf):
    return G.trajectory_stats(g04(spark, sf))


@query("g06_long_segments", ID + "traj_id:s lat:d lon:d dist_km:d", "SELECT mmsi, timestamp, traj_id, lat, lon, dist_km FROM segments")
def g06(spark, sf):
    return A.segments(spark, sf)


@query("g06_long_segments_by_semi_join", STATS, "SELECT * FROM long_stats")
def g06_semi(spark, sf):
    _, stats = G.keep_long_segments(g04(spark, sf), A.SEGMENTS)
    return stats


@query("s03_column_subset", "mmsi:i n:i", "SELECT mmsi, count(*) AS n FROM segments GROUP BY mmsi")
def s03(spark, sf):
    path = new_path(spark, "segments")
    tables.write_table(A.stored_segments(spark, sf), path)
    return tables.read_columns(spark, path, ["mmsi", "traj_id", "no_such_column"]).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))


@query("s04_scan_by_keys", ID + "traj_id:s", """
    SELECT mmsi, timestamp, traj_id FROM segments WHERE traj_id IN (
        SELECT traj_id FROM segments GROUP BY traj_id ORDER BY count(*) DESC, traj_id LIMIT 25)""")
def s04(spark, sf):
    path = new_path(spark, "segments")
    tables.write_table(A.stored_segments(spark, sf), path)
    keys = tables.read_columns(spark, path, ["traj_id"]).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "traj_id"
    ).limit(25)
    return tables.read_matching(spark, path, "traj_id", keys)


@query("s04_scan_of_keyed_table", ID + "traj_id:s", """
    SELECT mmsi, timestamp, traj_id FROM segments WHERE traj_id IN (
        SELECT traj_id FROM segments GROUP BY traj_id ORDER BY count(*) DESC, traj_id LIMIT 25)""")
def s04_keyed(spark, sf):
    path = new_path(spark, "keyed")
    tables.write_by_key(A.stored_segments(spark, sf), path, "traj_id", "timestamp")
    keys = spark.read.parquet(path).groupBy("traj_id").count().orderBy(F.col("count").desc(), "traj_id").limit(25)
    return tables.read_by_keys(spark, path, "traj_id", keys)


@query("s05_parquet_zstd", STATS, "SELECT * FROM long_stats")
def s05(spark, sf):
    path = new_path(spark, "stats")
    tables.write_table(G.trajectory_stats(A.stored_segments(spark, sf)), path, compression="zstd")
    return spark.read.parquet(path)


@query("s07_csv_stats", "traj_id:s mmsi:i n_points:i total_distance_km:d duration_hours:d", "SELECT traj_id, mmsi, n_points, total_distance_km, duration_hours FROM long_stats")
def s07(spark, sf):
    path = new_path(spark, "stats-csv")
    tables.write_csv(G.trajectory_stats(A.stored_segments(spark, sf)), path)
    return spark.read.option("header", True).csv(path)


@query("s13_export_points", "coast:s region:s dataset_label:s mmsi:i timestamp:t lat:d lon:d in_frame:b", f"""
    SELECT 'Eastern coast' AS coast, 'east_coast' AS region, '30d' AS dataset_label, mmsi, timestamp, lat, lon, TRUE AS in_frame FROM segments
    WHERE lat BETWEEN {EAST[0]} AND {EAST[1]} AND lon BETWEEN {EAST[2]} AND {EAST[3]}""")
def s13(spark, sf):
    return tables.export_points(A.stored_segments(spark, sf), "Eastern coast", "east_coast", "30d", EAST, strict=True)
