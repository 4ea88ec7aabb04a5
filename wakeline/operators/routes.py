"""Route tables, polylines and example picks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.ranking import ordered_rank, seeded_hash
from wakeline.functions.vessel import vessel_label
from wakeline.operators.audit import group_column, top_rows
from wakeline.sources.scratch import materialize


def top_by_points(segments: DataFrame, n: int) -> DataFrame:
    g = group_column(segments)
    return top_rows(segments.groupBy(g).agg(F.count(F.lit(1)).alias("n_points")), "n_points", [g], n)


def top_by_distance(stats: DataFrame, n: int) -> DataFrame:
    top = top_rows(stats, "total_distance_km", ["traj_id"], n)
    return top.withColumn("label", F.format_string("%.1f km, %.1f h", "total_distance_km", "duration_hours"))


def route_points(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """All points of chosen routes; the list of routes is a top-n result."""
    g = group_column(segments)
    return segments.join(F.broadcast(routes.select(g)), g, "left_semi")


def polylines(segments: DataFrame, routes: DataFrame, bucket_points: int = 10_000) -> DataFrame:
    """Ordered line per chosen route with end points, times, label and WKT.

    Meant for a handful of routes: the line of a route is one value, so its points
    are collected. Parts of a route are built in parallel and joined in order. For routes
    of any number and length see `polyline_parts`.
    """
    g = group_column(segments)
    chosen = route_points(segments, routes)
    part = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 86400)
    point = F.struct("timestamp", "lat", "lon")
    parts = chosen.groupBy(g, part.alias("_part")).agg(
        F.array_sort(F.collect_list(point)).alias("_pts"),
        F.first("mmsi").alias("mmsi"),
        F.min_by("vessel_type", "timestamp").alias("_type"),
    )
    lines = parts.groupBy(g).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_pts", "_type"))).alias("_parts"), F.first("mmsi").alias("mmsi")
    )
    pts = F.flatten(F.transform("_parts", lambda p: p["_pts"]))
    out = lines.withColumn("_p", pts).filter(F.size("_p") >= 2)
    first, last = F.col("_p")[0], F.element_at("_p", -1)
    pair = lambda p: F.format_string("%.5f %.5f", p.lon, p.lat)
    return out.select(
        g,
        "mmsi",
        F.size("_p").alias("n_points"),
        first.timestamp.alias("start_time"),
        last.timestamp.alias("end_time"),
        first.lat.alias("start_lat"),
        first.lon.alias("start_lon"),
        last.lat.alias("end_lat"),
        last.lon.alias("end_lon"),
        F.concat(
            F.lit(f"{g} "),
            F.col(g).cast("string"),
            F.lit(" ("),
            vessel_label(F.col("_parts")[0]["_type"].cast("string")),
            F.lit(")"),
            *([F.lit(" | MMSI "), F.col("mmsi").cast("string")] if g == "traj_id" else []),
        ).alias("label"),
        F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("_p", pair), ", "), F.lit(")")).alias("wkt"),
    )


def error_band(error: Column) -> Column:
    return F.when(error < 15, F.lit("low")).when(error < 40, F.lit("medium")).otherwise(F.lit("high"))


def picks_by_error_band(
    examples: DataFrame, n_each: int = 2, min_net_km: float = 5.0, *, prefer_long: bool = True, seed: int = 7
) -> DataFrame:
    """n examples per error band among moving windows; an empty band falls back to error ranks.

    examples: window_id, err_km, net_km. Fallbacks: the 20 smallest errors, the
    middle third by rank, the 20 largest.
    """
    examples = materialize(examples.select("window_id", "err_km", "net_km"), "examples")
    pool = examples.filter(F.col("net_km") > min_net_km).withColumn("band", error_band(F.col("err_km")))
    missing = sorted({"low", "medium", "high"} - {r["band"] for r in pool.select("band").distinct().collect()})
    if missing:
        ranked = ordered_rank(examples, "err_km", ["window_id"], seed, "_pos").drop("_pos_avg")
        total = examples.agg(F.count(F.lit(1))).scalar()
        pos = F.col("_pos")
        ranges = {
            "low": pos <= 20,
            "medium": (pos > F.floor(total / 3)) & (pos <= F.floor(total * 2 / 3)),
            "high": pos > total - 20,
        }
        for band in missing:
            pool = pool.unionByName(ranked.filter(ranges[band]).drop("_pos").withColumn("band", F.lit(band)))
    return _first_per_group(pool, "band", n_each, prefer_long, seed)


def _first_per_group(pool: DataFrame, group: str, n: int, prefer_long: bool, seed: int) -> DataFrame:
    """Top n per group in two steps: per salt first, then over the few survivors."""
    order = [F.col("net_km").desc(), "window_id"] if prefer_long else ["_h", "window_id"]
    keyed = pool.withColumn("_h", seeded_hash(seed, "window_id")).withColumn("_salt", F.substring("_h", 1, 2))
    salted = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).filter(
        F.col("_r") <= n
    )
    w = Window.partitionBy(group).orderBy(*order)
    return salted.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n).drop("_h", "_salt", "_r")


def longest_tracks(examples: DataFrame, n: int = 6, min_net_km: float = 40.0) -> DataFrame:
    """The n largest true displacements of at least `min_net_km`, or of all windows if none is."""
    largest = examples.agg(F.max("net_km")).scalar()
    return top_rows(
        examples.filter((F.col("net_km") >= min_net_km) | (largest < min_net_km)), "net_km", ["window_id"], n
    )


SHAPE_RULES = (
    # Fixed values: (label, class, error from, error below, how many, ordering), in priority order.
    ("Straight (good)", "straight", None, 20.0, 3, "net_km"),
    ("Straight (medium)", "straight", 20.0, 50.0, 2, "net_km"),
    ("Straight/long (high FDE)", "long", 50.0, None, 2, "net_km"),
    ("Maneuver (good pred)", "maneuver", None, 25.0, 2, "maneuver_score"),
    ("Maneuver (medium pred)", "maneuver", 25.0, 55.0, 3, "maneuver_score"),
    ("Maneuver (hard)", "maneuver", 55.0, None, 3, "maneuver_score"),
)


def shape_classes(shapes: DataFrame) -> DataFrame:
    """long / mid / maneuver / straight flags of track_shape rows."""
    long = F.col("net_km") >= 80.0
    mid = F.col("net_km") >= 45.0
    return (
        shapes.withColumn("long", long)
        .withColumn("mid", mid)
        .withColumn(
            "is_maneuver",
            mid & ((F.col("directness") < 0.75) | (F.col("cross_track_km") > 20.0)) & (F.col("turn_deg") > 80.0),
        )
        .withColumn("is_straight", long & (F.col("directness") >= 0.90) & (F.col("cross_track_km") < 15.0))
    )


def picks_by_shape(shapes: DataFrame, n: int = 15) -> DataFrame:
    """Gallery of straight and maneuver tracks over error bands, each window used once.

    shapes: window_id, err_km and the track_shape columns. One pass keeps the first rows of every rule, so many
    that the rules before it cannot use them all up; the rules then choose in order from these few rows.
    Left-over places go to maneuvers, then to any travelling track. Every class implies travel.
    """
    rules = (*SHAPE_RULES, ("Maneuver (extra)", "maneuver", None, None, n, "maneuver_score"), ("Extra track", "mid", None, None, n, "net_km"))
    spare = sum(k for *_, k, _ in SHAPE_RULES) + 2 * n
    flag = {"straight": "is_straight", "long": "long", "maneuver": "is_maneuver", "mid": "mid"}
    entries = []
    for i, (_, cls, low, high, _, order) in enumerate(rules):
        cond = F.col(flag[cls])
        if low is not None:
            cond = cond & (F.col("err_km") >= low)
        if high is not None:
            cond = cond & (F.col("err_km") < high)
        entries.append(F.when(cond, F.struct(F.lit(i).alias("_rule"), F.col(order).cast("double").alias("_score"))))
    columns = ("window_id", "net_km", "directness", "cross_track_km", "err_km")
    entered = F.filter(F.array(*entries), lambda e: e.isNotNull())
    tall = shape_classes(shapes).filter("mid").select(*columns, F.inline(entered))
    best = (F.col("_score").desc(), F.col("window_id"))
    in_salt = Window.partitionBy("_rule", F.pmod(F.xxhash64("window_id"), F.lit(256))).orderBy(*best)
    in_rule = Window.partitionBy("_rule").orderBy(*best)
    rows = (
        tall.withColumn("_at", F.row_number().over(in_salt))
        .filter(F.col("_at") <= spare)
        .withColumn("_at", F.row_number().over(in_rule))
        .filter(F.col("_at") <= spare)
        .collect()
    )
    used: set[str] = set()
    parts: list[tuple] = []
    for i, (label, _, _, _, k, _) in enumerate(rules):
        left = k if i < len(SHAPE_RULES) else n - len(parts)
        of_rule = sorted((r for r in rows if r["_rule"] == i and r["window_id"] not in used), key=lambda r: r["_at"])
        for j, r in enumerate(of_rule[: max(left, 0)], 1):
            used.add(r["window_id"])
            parts.append((len(parts), label, j, *(r[c] for c in columns)))
    return shapes.sparkSession.createDataFrame(
        parts[:n],
        "place int, rule string, number int, window_id string, net_km double, directness double, cross_track_km double, err_km double",
    )


def spread_picks(
    examples: DataFrame, n: int, min_net_km: float, min_path_km: float, seed: int = 42
) -> DataFrame:
    """n windows spread evenly over the sorted net displacement.

    Thresholds are relaxed in steps until enough windows pass. examples:
    window_id, net_km, path_km.
    """
    # Relaxed (net, path) thresholds in kilometres.
    ladder = [(min_net_km, min_path_km), (5, 5), (2, 5), (1, 1)]
    passing = [F.sum(((F.col("net_km") >= a) & (F.col("path_km") >= b)).cast("int")) for a, b in ladder]
    counts = [c or 0 for c in examples.agg(*passing).first()]
    level = next((i for i, c in enumerate(counts) if c >= n), len(ladder) - 1)
    have = counts[level]
    if not have:
        from wakeline.operators.split import sample_exact

        return sample_exact(examples, n, ["window_id"], seed)
    a, b = ladder[level]
    pool = examples.filter((F.col("net_km") >= a) & (F.col("path_km") >= b))
    if have <= n:
        return pool
    spots = sorted({int(round(i * (have - 1) / (n - 1))) + 1 for i in range(n)} if n > 1 else {1})
    return ordered_rank(pool, "net_km", ["window_id"], seed, "_pos").filter(F.col("_pos").isin(*spots)).drop("_pos", "_pos_avg")


def nearest_windows(windows: DataFrame, targets: Sequence[tuple[str, float, float]], at_once: int = 200) -> DataFrame:
    """For each named (lat, lon): the window whose anchor is nearest in squared degrees.

    The targets are constants, `at_once` of them per pass, and one aggregate finds all of a
    pass without a join; a longer list takes more passes.
    """
    last = F.element_at("hist", -1)
    row = F.struct("traj_id", "start_time", last.lat.cast("double").alias("anchor_lat"), last.lon.cast("double").alias("anchor_lon"))
    passes = []
    for k in range(0, len(targets), at_once):
        found = []
        for name, lat, lon in targets[k : k + at_once]:
            d = F.pow(last.lat.cast("double") - F.lit(lat), F.lit(2)) + F.pow(last.lon.cast("double") - F.lit(lon), F.lit(2))
            best = F.min(F.struct(d.alias("distance2"), row.alias("w")))
            found.append(F.struct(F.lit(name).alias("target"), best["distance2"].alias("distance2"), best["w"].alias("w")))
        passes.append(windows.agg(F.array(*found).alias("_a")).select(F.inline("_a")).select("target", "distance2", "w.*"))
    return reduce(DataFrame.unionByName, passes)


#: Edges of cells in degrees, coarse to fine; powers of two, so borders of cells are exact. 1/8192 is some 13 m.
CELL_EDGES = tuple(32.0 / 8**k for k in range(7))


def nearest_windows_of(windows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each row of targets (target, lat, lon): the window whose anchor is nearest in squared degrees.

    For target lists of any length; `nearest_windows` takes a few constants. Anchors are counted in cells of
    seven sizes, each an eighth of the one before, with one anchor per cell as its witness. All targets go down
    from coarse to fine together: a witness bounds the nearest distance from above, the border of a cell bounds
    its anchors from below, and a cell that cannot hold the nearest anchor is left out with all its parts. Only
    the finest cells that stay are joined with anchors, one row per distinct place. Every join is by cell.

    `target` must be unique and not null. Targets and anchors without a position, or outside latitudes -96 to 96
    and longitudes -192 to 192, are left out. Equal distances go to the first traj_id and start_time.
    """
    last = F.element_at("hist", -1)
    inside = F.col("lat").between(-96.0, 95.999) & F.col("lon").between(-192.0, 191.999)
    places = materialize(
        windows.select(last.lat.cast("double").alias("lat"), last.lon.cast("double").alias("lon"), "traj_id", "start_time")
        .filter(inside)
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("traj_id", "start_time")).alias("window")),
        "anchor-places",
    )
    cell = lambda edge: [F.floor(F.col(c) / F.lit(edge)).alias(name) for c, name in (("lat", "row"), ("lon", "col"))]
    levels = F.array(*[F.struct(F.lit(k).alias("level"), *cell(edge)) for k, edge in enumerate(CELL_EDGES)])
    cells = materialize(
        places.select("lat", "lon", F.inline(levels))
        .groupBy("level", "row", "col")
        .agg(F.min(F.struct("lat", "lon")).alias("witness"))
        .select("*", F.floor(F.col("row") / 8).alias("up_row"), F.floor(F.col("col") / 8).alias("up_col")),
        "anchor-cells",
    )

    def apart(value: Column, low: Column, high: Column) -> Column:
        return F.pow(F.greatest(low - value, value - high, F.lit(0.0)), F.lit(2))

    def square(lat: Column, lon: Column) -> Column:
        return F.pow(lat - F.col("lat"), F.lit(2)) + F.pow(lon - F.col("lon"), F.lit(2))

    # All coarsest cells there are: 6 by 12 of them.
    grid = lambda n, name: F.explode(F.sequence(F.lit(-n).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    open_cells = (
        targets.select("target", F.col("lat").cast("double"), F.col("lon").cast("double")).filter(inside)
        .select("*", grid(3, "up_row")).select("*", grid(6, "up_col"))
    )
    of_target = Window.partitionBy("target")
    for k, edge in enumerate(CELL_EDGES):
        part = cells.filter(F.col("level") == k).drop("level")
        if k == 0:
            part = part.withColumns({"up_row": F.col("row"), "up_col": F.col("col")})
        low = lambda name: F.col(name) * F.lit(edge)
        border = apart(F.col("lat"), low("row"), low("row") + edge) + apart(F.col("lon"), low("col"), low("col") + edge)
        open_cells = (
            open_cells.join(part, ["up_row", "up_col"])
            .withColumn("upper", F.min(square(F.col("witness.lat"), F.col("witness.lon"))).over(of_target))
            .filter(border <= F.col("upper"))
            .select("target", "lat", "lon", F.col("row").alias("up_row"), F.col("col").alias("up_col"))
        )
    finest = [c.alias(f"up_{name}") for c, name in zip(cell(CELL_EDGES[-1]), ("row", "col"))]
    anchors = places.select(F.col("lat").alias("anchor_lat"), F.col("lon").alias("anchor_lon"), "window", *finest)
    found = open_cells.join(anchors, ["up_row", "up_col"]).withColumn("distance2", square(F.col("anchor_lat"), F.col("anchor_lon")))
    best = F.min(F.struct("distance2", "window.traj_id", "window.start_time", "anchor_lat", "anchor_lon"))
    return found.groupBy("target").agg(best.alias("best")).select("target", "best.*")


def thin(segments: DataFrame, target_points: int = 216) -> DataFrame:
    """Every k-th point of each trajectory so that about `target_points` remain."""
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target_points))
    return numbered_points(segments, "traj_id").filter(F.col("_pos") % step == 0).drop("_pos", "_n")


def numbered_points(segments: DataFrame, key: str) -> DataFrame:
    """Adds `_pos`, the place of a point in its route from 0, and `_n`, the points of the route.

    Positions come from per-day counts chained per route, so a long route is numbered in parallel.
    """
    day = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 86400)
    spread = segments.withColumn("_day", day).repartition(key, "_day")
    inside = Window.partitionBy(key, "_day").orderBy("timestamp")
    local = spread.withColumn("_r", F.row_number().over(inside))
    counts = local.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(key).orderBy("_day")
    offsets = counts.withColumn("_before", F.sum("_c").over(order) - F.col("_c")).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(key))
    )
    return (
        local.join(offsets.drop("_c"), [key, "_day"])
        .withColumn("_pos", F.col("_before") + F.col("_r") - 1)
        .drop("_day", "_r", "_before")
    )


def polyline_parts(segments: DataFrame, part_points: int = 1000) -> DataFrame:
    """(key, part, n_points, start_time, end_time, wkt): lines of all routes in parts of a fixed size.

    A part ends with the first point of the next one, so the parts of a route, in order, draw its whole line, and
    no value grows with the route. A route of one point, and a last point that its part has already, give no line.
    """
    g = group_column(segments)
    part = F.floor(F.col("_pos") / part_points)
    shared = (F.col("_pos") % part_points == 0) & (F.col("_pos") > 0)
    numbered = numbered_points(segments.select(g, "timestamp", "lat", "lon"), g)
    points = numbered.select(
        g, "_pos", "timestamp", "lat", "lon", F.explode(F.when(shared, F.array(part - 1, part)).otherwise(F.array(part))).alias("part")
    )
    line = F.array_sort(F.collect_list(F.struct("_pos", F.format_string("%.5f %.5f", "lon", "lat").alias("pair"))))
    return (
        points.groupBy(g, "part")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            line.alias("_line"),
        )
        .filter("n_points >= 2")
        .withColumn("wkt", F.concat(F.lit("LINESTRING ("), F.array_join("_line.pair", ", "), F.lit(")")))
        .drop("_line")
    )
