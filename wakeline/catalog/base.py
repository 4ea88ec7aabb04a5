"""Registry, output shaping and the SQL forms of the tables most queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.constants import FEATURES
from wakeline.plans.adapter import BOX, H, N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select and normalise the columns 'name:kind' (i int, d double, s text, b flag, t time)."""
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        cols.append(
            {
                "i": lambda c: c.cast("bigint"),
                "d": lambda c: F.round(c.cast("double"), 6),
                "s": lambda c: c.cast("string"),
                "b": lambda c: c.cast("int").cast("bigint"),
                "t": lambda c: F.unix_seconds(c.cast("timestamp")),
            }[kind](c).alias(name)
        )
    return df.select(*cols)


def shape_sql(spec: str) -> str:
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        cols.append(
            {
                "i": f"CAST({name} AS BIGINT)",
                "d": f"CASE WHEN round(CAST({name} AS DOUBLE), 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({name} AS DOUBLE), 6) END",
                "s": f"CAST({name} AS VARCHAR)",
                "b": f"CAST(CAST({name} AS INTEGER) AS BIGINT)",
                "t": f"CAST(epoch({name}) AS BIGINT)",
            }[kind]
            + f" AS {name}"
        )
    return ", ".join(cols)


def query(name: str, spec: str, body: str | None = None):
    """Register a Spark query and, with `body`, the SQL over the CTEs that it names."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if body is not None:
            ORACLES[name] = with_ctes(body, spec)
        return fn

    return register


def hav(a: str, b: str, c: str, d: str) -> str:
    p, q = f"radians({a})", f"radians({c})"
    h = f"(radians({d}) - radians({b})) / 2"
    return (
        f"(12742.0::DOUBLE * asin(sqrt(pow(sin(({q} - {p}) / 2), 2) + cos({p}) * cos({q}) * pow(sin({h}), 2))))"
    )


def turn(cur: str, prev: str) -> str:
    x = f"({cur} - {prev} + 180.0::DOUBLE)"
    return f"({x} - 360.0::DOUBLE * floor({x} / 360.0::DOUBLE) - 180.0::DOUBLE)"


def pct(col: str, p: float, flt: str = "") -> str:
    f = f" FILTER (WHERE {flt})" if flt else ""
    return f"quantile_cont(CAST({col} AS DOUBLE), {p}){f}"


_lat0, _lat1, _lon0, _lon1 = BOX
_sum_limit = repr(102.2 * 1.852)
_feat_avg = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in FEATURES)
_feat_fill = ", ".join(
    f"CASE WHEN k = 0 THEN {f} ELSE {f} + (next_{f} - {f}) * (k::DOUBLE / gap) END AS {f}" for f in FEATURES
)
_feat_next = ", ".join(f"lead({f}) OVER w AS next_{f}" for f in FEATURES)
_feat_float = ", ".join(f"CAST(CAST(g.{f} AS FLOAT) AS DOUBLE) AS {f}" for f in FEATURES)
STEP_US = 180 * 60 * 1_000_000


def fill_sql(limit: int) -> str:
    return f"""
        SELECT mmsi, traj_id, bin + k AS bin, to_timestamp((bin + k) * {STEP_US // 1_000_000})::TIMESTAMP AS timestamp, {_feat_fill},
               CASE WHEN k = 0 THEN label_type ELSE coalesce(last_type, next_label) END AS vessel_type
        FROM (
            SELECT *, unnest(range(0, gap)) AS k FROM (
                SELECT *, coalesce(next_bin - bin, 1) AS gap FROM bins_next
            )
        )
        WHERE k <= {limit} OR gap - k <= {limit}
    """


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        """
        SELECT event_id AS i, user_id AS u, date_trunc('second', ts) AS t, event_type,
               37.0::DOUBLE + size * sin(phase) + (CASE WHEN event_id % 211 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END) AS lat,
               -72.0::DOUBLE + size * cos(phase) AS lon,
               (CASE WHEN user_id % 5 = 0 THEN value % 1.0::DOUBLE ELSE value % 40.0::DOUBLE END) * (0.99::DOUBLE + 0.01::DOUBLE * sin(phase)) AS knots,
               CASE WHEN user_id % 5 = 2 THEN 45.0::DOUBLE + event_id % 4 ELSE ((event_id * 7) % 360)::DOUBLE END AS course
        FROM (
            SELECT *, 2 * pi() * epoch(date_trunc('second', ts))::DOUBLE / 864000.0::DOUBLE + user_id AS phase,
                   CASE WHEN user_id % 5 = 0 THEN 0.009::DOUBLE WHEN user_id % 5 = 1 THEN 0.05::DOUBLE ELSE 3.0::DOUBLE END AS size
            FROM events
        )""",
    ),
    "raw": (
        ("base",),
        """
        SELECT i, CASE WHEN i % 97 = 0 THEN NULL ELSE t END AS timestamp,
               CASE WHEN i % 83 = 0 THEN 0 ELSE u END AS mmsi,
               CASE WHEN i % 89 = 0 THEN NULL ELSE lat + shift END AS lat, lon,
               CASE WHEN i % 79 = 0 THEN NULL WHEN i % 73 = 0 THEN 103.5::DOUBLE ELSE knots END AS sog,
               CASE WHEN i % 71 = 0 THEN NULL WHEN i % 67 = 0 THEN 360.5::DOUBLE ELSE course END AS cog,
               CASE WHEN event_type = 'error' THEN NULL ELSE course END AS heading,
               CASE WHEN i % 59 = 0 THEN NULL ELSE CAST(30 + i % 60 AS VARCHAR) END AS vessel_type
        FROM (SELECT *, 0.0::DOUBLE AS shift FROM base UNION ALL SELECT *, 0.001::DOUBLE AS shift FROM base WHERE i % 61 = 0)""",
    ),
    "norm": (
        ("raw",),
        """
        SELECT timestamp, mmsi, lat, lon, coalesce(sog, 0.0::DOUBLE) * 1.852::DOUBLE AS sog,
               coalesce(cog, heading, 0.0::DOUBLE) AS cog, heading, vessel_type, CAST(vessel_type AS INTEGER) AS code
        FROM raw""",
    ),
    "valid": (
        ("norm",),
        f"""
        SELECT * FROM norm
        WHERE timestamp IS NOT NULL AND mmsi > 0 AND lat BETWEEN {_lat0} AND {_lat1} AND lon BETWEEN {_lon0} AND {_lon1}
          AND sog BETWEEN 0 AND {_sum_limit}::DOUBLE AND cog BETWEEN 0 AND 360""",
    ),
    "points": (
        ("valid",),
        """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY mmsi, timestamp ORDER BY lat, lon, sog, cog,
                   heading NULLS FIRST, vessel_type NULLS FIRST) AS rn FROM valid
        ) WHERE rn = 1""",
    ),
    "lagged": (
        ("points",),
        """
        SELECT *, lag(timestamp) OVER w AS prev_timestamp, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon,
               lag(sog) OVER w AS prev_sog, lag(cog) OVER w AS prev_cog
        FROM points WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)""",
    ),
    "stepped": (
        ("lagged",),
        f"""
        SELECT *, dist_km / nullif(dt_hours, 0) AS speed_between_kmh FROM (
            SELECT *, dt_sec / 3600.0::DOUBLE AS dt_hours FROM (
                SELECT *, (epoch_us(timestamp) - epoch_us(prev_timestamp)) / 1e6::DOUBLE AS dt_sec,
                       {hav("prev_lat", "prev_lon", "lat", "lon")} AS dist_km
                FROM lagged
            )
        )""",
    ),
    "features": (
        ("stepped",),
        f"""
        SELECT * EXCLUDE (heading), coalesce(heading, cog) AS heading,
               CASE WHEN heading IS NULL THEN 1 ELSE 0 END AS heading_missing,
               lat - prev_lat AS dlat, lon - prev_lon AS dlon, sog - prev_sog AS dsog, {turn("cog", "prev_cog")} AS dcog,
               sin(radians(cog)) AS cog_sin, cos(radians(cog)) AS cog_cos,
               sog * cos(radians(cog)) AS v_north_kmh, sog * sin(radians(cog)) AS v_east_kmh,
               sin(radians(coalesce(heading, cog))) AS heading_sin, cos(radians(coalesce(heading, cog))) AS heading_cos,
               CASE WHEN dt_sec > 0 AND dt_hours <= 24.0 AND speed_between_kmh <= 92.6::DOUBLE THEN 0 ELSE 1 END AS new_segment
        FROM stepped""",
    ),
    "numbered": (
        ("features",),
        """
        SELECT *, CAST(mmsi AS VARCHAR) || '_' || CAST(segment_id AS VARCHAR) AS traj_id FROM (
            SELECT *, CAST(sum(new_segment) OVER (PARTITION BY mmsi ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
            FROM features
        )""",
    ),
    "usable": (
        ("numbered",),
        "SELECT * FROM numbered WHERE dt_sec > 0 AND speed_between_kmh <= 92.6::DOUBLE",
    ),
    "stats": (
        ("usable",),
        f"""
        SELECT traj_id, mmsi, count(*) AS n_points, min(timestamp) AS start_time, max(timestamp) AS end_time,
               avg(sog) AS mean_sog, {pct("dt_sec", 0.5)} AS median_dt_sec, sum(dist_km) AS total_distance_km,
               (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE / 3600.0::DOUBLE AS duration_hours
        FROM usable GROUP BY traj_id, mmsi""",
    ),
    "long_stats": (
        ("stats",),
        "SELECT * FROM stats WHERE n_points >= 5 AND duration_hours >= 36.0 AND total_distance_km >= 1.0",
    ),
    "segments": (
        ("usable", "long_stats"),
        "SELECT * FROM usable WHERE traj_id IN (SELECT traj_id FROM long_stats)",
    ),
    "bins": (
        ("segments",),
        f"""
        SELECT mmsi, traj_id, CAST(floor(epoch_us(timestamp) / {STEP_US}::DOUBLE) AS BIGINT) AS bin, {_feat_avg},
               arg_max_null(vessel_type, timestamp) AS last_type,
               max(CASE WHEN epoch_us(timestamp) % {STEP_US} = 0 THEN vessel_type END) AS exact_type
        FROM segments GROUP BY ALL""",
    ),
    "bins_labelled": (
        ("bins",),
        "SELECT *, coalesce(exact_type, lag(last_type) OVER (PARTITION BY traj_id ORDER BY bin)) AS own_type FROM bins",
    ),
    "bins_next": (
        ("bins_labelled",),
        f"""
        SELECT *, coalesce(own_type, CASE WHEN next_bin IS NULL THEN NULL
                    ELSE coalesce(CASE WHEN next_bin = bin + 1 THEN coalesce(next_own, last_type) ELSE last_type END, next_label) END) AS label_type
        FROM (
            SELECT *, lead(bin) OVER w AS next_bin, {_feat_next}, lead(own_type) OVER w AS next_own,
                   first_value(own_type IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_label
            FROM bins_labelled WINDOW w AS (PARTITION BY traj_id ORDER BY bin)
        )""",
    ),
    "grid": (("bins_next",), fill_sql(6)),
    "grid2": (("bins_next",), fill_sql(2)),
    "placed": (
        ("grid",),
        """
        SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY bin) - 1 AS pos, count(*) OVER (PARTITION BY traj_id) AS n FROM grid""",
    ),
    "win": (
        ("placed",),
        f"""
        SELECT a.traj_id, a.mmsi, a.pos, a.timestamp AS start_time, b.timestamp AS split_time, c.timestamp AS target_end_time,
               a.traj_id || '@' || CAST(CAST(epoch(a.timestamp) AS BIGINT) AS VARCHAR) AS window_id
        FROM placed a
        JOIN placed b ON b.traj_id = a.traj_id AND b.pos = a.pos + {H - 1}
        JOIN placed c ON c.traj_id = a.traj_id AND c.pos = a.pos + {H + N - 1}""",
    ),
    "hs": (
        ("win", "placed"),
        f"""
        SELECT w.window_id, w.traj_id, w.mmsi, w.start_time, g.pos - w.pos AS i, {_feat_float}
        FROM win w JOIN placed g ON g.traj_id = w.traj_id AND g.pos BETWEEN w.pos AND w.pos + {H - 1}""",
    ),
    "fs": (
        ("win", "placed"),
        f"""
        SELECT w.window_id, g.pos - w.pos - {H} AS k, CAST(CAST(g.lat AS FLOAT) AS DOUBLE) AS lat, CAST(CAST(g.lon AS FLOAT) AS DOUBLE) AS lon
        FROM win w JOIN placed g ON g.traj_id = w.traj_id AND g.pos BETWEEN w.pos + {H} AND w.pos + {H + N - 1}""",
    ),
    "last": (("hs",), f"SELECT * FROM hs WHERE i = {H - 1}"),
    "first_step": (("hs",), "SELECT * FROM hs WHERE i = 0"),
    # History metrics of each window from its steps.
    "hm": (
        ("hs", "last"),
        f"""
        SELECT s.window_id, any_value(s.traj_id) AS traj_id, any_value(s.mmsi) AS mmsi, any_value(s.start_time) AS start_time,
               max({hav("a.lat", "a.lon", "s.lat", "s.lon")}) AS radius,
               max(CASE WHEN s.i = 0 THEN {hav("s.lat", "s.lon", "a.lat", "a.lon")} END) AS net,
               max(CASE WHEN s.i = 2 THEN {hav("s.lat", "s.lon", "a.lat", "a.lon")} END) AS net_i2,
               max(CASE WHEN s.i = 3 THEN {hav("s.lat", "s.lon", "a.lat", "a.lon")} END) AS net_i3,
               max(CASE WHEN s.i = 5 THEN {hav("s.lat", "s.lon", "a.lat", "a.lon")} END) AS net_i5,
               coalesce(sum({hav("s.plat", "s.plon", "s.lat", "s.lon")}), 0) AS path,
               avg(s.sog) AS mean_sog, stddev_pop(s.sog) AS std_sog, max(abs(s.dcog)) AS max_dcog,
               avg(abs(s.dcog)) AS mean_dcog, avg(abs(s.dsog)) AS mean_dsog,
               any_value(a.lat) AS alat, any_value(a.lon) AS alon,
               max(CASE WHEN s.i = 0 THEN s.lat END) AS flat, max(CASE WHEN s.i = 0 THEN s.lon END) AS flon
        FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM hs WINDOW w AS (PARTITION BY window_id ORDER BY i)) s
        JOIN last a USING (window_id) GROUP BY s.window_id""",
    ),
    "buckets": (
        ("hm",),
        """
        SELECT *, NOT (anchored OR maneuver OR straight) AS other FROM (
            SELECT *, mean_sog < 1.0 AS anchored, max_dcog > 15.0 AS maneuver,
                   mean_sog >= 5.0 AND max_dcog < 5.0 AND NOT mean_sog < 1.0 AS straight, mean_dcog + mean_dsog AS score
            FROM hm
        )""",
    ),
    # Two models on every window: repeated last change, and constant speed and course.
    "pred": (
        ("fs", "last"),
        """
        SELECT m.model, f.window_id, f.k AS step, f.lat AS true_lat, f.lon AS true_lon,
               a.lat + CASE m.model WHEN 'naive' THEN a.dlat ELSE a.sog * a.cog_cos * 3.0::DOUBLE / 111.322::DOUBLE END * (f.k + 1) AS pred_lat,
               a.lon + CASE m.model WHEN 'naive' THEN a.dlon
                            ELSE a.sog * a.cog_sin * 3.0::DOUBLE / (111.322::DOUBLE * greatest(cos(radians(a.lat)), 1e-3::DOUBLE)) END * (f.k + 1) AS pred_lon,
               a.lat AS anchor_lat, a.lon AS anchor_lon
        FROM fs f JOIN last a USING (window_id), (VALUES ('naive'), ('kinematic')) m(model)""",
    ),
    "err": (
        ("pred",),
        f"SELECT *, {hav('true_lat', 'true_lon', 'pred_lat', 'pred_lon')} AS km FROM pred",
    ),
    # One row per model and window: final and mean error, floored displacement and path.
    "ferr": (
        ("err",),
        f"""
        SELECT *, fde_km / displacement_km AS nfde, ade_km / true_path_km AS nade FROM (
            SELECT model, window_id, max(CASE WHEN step = {N - 1} THEN km END) AS fde_km, avg(km) AS ade_km,
                   max(CASE WHEN step = {N - 1} THEN true_lat END) AS true_lat, max(CASE WHEN step = {N - 1} THEN true_lon END) AS true_lon,
                   max(CASE WHEN step = {N - 1} THEN pred_lat END) AS pred_lat, max(CASE WHEN step = {N - 1} THEN pred_lon END) AS pred_lon,
                   any_value(anchor_lat) AS anchor_lat, any_value(anchor_lon) AS anchor_lon,
                   greatest(max(CASE WHEN step = {N - 1} THEN {hav("anchor_lat", "anchor_lon", "true_lat", "true_lon")} END), 10.0::DOUBLE) AS displacement_km,
                   max(CASE WHEN step = {N - 1} THEN {hav("anchor_lat", "anchor_lon", "true_lat", "true_lon")} END) AS net_km,
                   greatest(coalesce(sum({hav("plat", "plon", "true_lat", "true_lon")}), 0), 10.0::DOUBLE) AS true_path_km,
                   sum({hav("coalesce(plat, anchor_lat)", "coalesce(plon, anchor_lon)", "true_lat", "true_lon")}) AS full_path_km
            FROM (SELECT *, lag(true_lat) OVER w AS plat, lag(true_lon) OVER w AS plon FROM err WINDOW w AS (PARTITION BY model, window_id ORDER BY step))
            GROUP BY model, window_id
        )""",
    ),
    # Context weights of each window from four of its history speeds.
    "gate": (
        ("hs",),
        """
        SELECT *, CASE WHEN a0 >= a1 AND a0 >= a2 AND a0 >= a3 THEN 0 WHEN a1 >= a2 AND a1 >= a3 THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END AS choice,
               -(a0 * ln(a0 + 1e-8) + a1 * ln(a1 + 1e-8) + a2 * ln(a2 + 1e-8) + a3 * ln(a3 + 1e-8)) AS entropy
        FROM (
            SELECT window_id, mmsi, w0 / t AS a0, w1 / t AS a1, w2 / t AS a2, w3 / t AS a3 FROM (
                SELECT *, w0 + w1 + w2 + w3 AS t FROM (
                    SELECT window_id, any_value(mmsi) AS mmsi, 1 + max(CASE WHEN i = 7 THEN sog END) AS w0, 1 + max(CASE WHEN i = 5 THEN sog END) AS w1,
                           1 + max(CASE WHEN i = 3 THEN sog END) AS w2, 1 + max(CASE WHEN i = 1 THEN sog END) AS w3
                    FROM hs GROUP BY window_id
                )
            )
        )""",
    ),
    "lookup": (
        ("segments",),
        """
        SELECT mmsi, code AS vessel_type_code, CASE WHEN code IS NULL THEN 0 WHEN code BETWEEN 60 AND 69 THEN 1 WHEN code BETWEEN 70 AND 79 THEN 2
               WHEN code BETWEEN 80 AND 89 THEN 3 WHEN code BETWEEN 50 AND 59 THEN 4 WHEN code BETWEEN 30 AND 39 THEN 5
               WHEN code BETWEEN 20 AND 29 THEN 6 WHEN code BETWEEN 40 AND 49 THEN 7 ELSE 8 END AS vessel_class
        FROM (
            SELECT mmsi, code, row_number() OVER (PARTITION BY mmsi ORDER BY code IS NULL, c DESC, code) AS rn
            FROM (SELECT mmsi, code, count(*) AS c FROM segments GROUP BY mmsi, code)
        ) WHERE rn = 1""",
    ),
}
MATERIALIZED = {"points", "usable", "segments", "bins_next", "placed", "win", "hs", "fs", "last", "hm", "pred", "err", "ferr"}


def needed_ctes(body: str, extra: dict[str, str] | None = None) -> list[str]:
    """Named tables used by the body, with their own inputs, in definition order."""
    import re

    words = set(re.findall(r"[a-z_0-9]+", body))
    stack = [n for n in CTES if n in words]
    seen: set[str] = set()
    while stack:
        n = stack.pop()
        if n not in seen:
            seen.add(n)
            stack.extend(CTES[n][0])
    return [n for n in CTES if n in seen]


def with_ctes(body: str, spec: str) -> str:
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n][1]})" for n in needed_ctes(body)
    ]
    parts.append(f"answer AS ({body})")
    return f"WITH {', '.join(parts)} SELECT {shape_sql(spec)} FROM answer"
