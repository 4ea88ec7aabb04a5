"""Raw position reports to clean points: parse, repair, validate, de-duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.constants import HEADING_MISSING, KNOTS_TO_KMH, MAX_SOG_KNOTS, REGIONS
from wakeline.functions.geo import in_box
from wakeline.functions.vessel import is_commercial

ZONE_SUFFIX = r"(Z|[+-]\d\d:?\d\d)\s*$"


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Text to naive UTC (the session runs in UTC); anything unreadable becomes NULL."""
    if fmt is not None:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    zoned = F.when(text.rlike(ZONE_SUFFIX), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned).cast("timestamp_ntz")


def number(text: Column, kind: str = "double") -> Column:
    """Text to a number; anything unreadable, and NaN, becomes NULL."""
    value = F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))
    return value if kind == "double" else value.try_cast(kind)


def heading_or_null(heading: Column) -> Column:
    return F.nullif(heading, F.lit(float(HEADING_MISSING)))


def speed_kmh(sog_knots: Column) -> Column:
    return F.coalesce(sog_knots, F.lit(0.0)) * F.lit(KNOTS_TO_KMH)


def course_or_heading(cog: Column, heading: Column) -> Column:
    return F.coalesce(cog, heading, F.lit(0.0))


def normalize(raw: DataFrame, source: str = "noaa", timestamp_format: str | None = None) -> DataFrame:
    """Canonical string columns to typed columns with repaired values."""
    typed = raw.select(
        parse_timestamp(F.col("timestamp"), timestamp_format).alias("timestamp"),
        number(F.col("mmsi"), "bigint").alias("mmsi"),
        number(F.col("lat")).alias("lat"),
        number(F.col("lon")).alias("lon"),
        number(F.col("sog")).alias("sog"),
        number(F.col("cog")).alias("cog"),
        heading_or_null(number(F.col("heading"))).alias("heading"),
        F.nullif(F.trim(F.col("vessel_type")), F.lit("")).alias("vessel_type"),
        *[F.col(c) for c in raw.columns if c not in RAW_COLUMNS],
    )
    code = number(F.col("vessel_type"), "int") if source == "noaa" else F.lit(None).cast("int")
    return (
        typed.withColumn("sog", speed_kmh(F.col("sog")))
        .withColumn("cog", course_or_heading(F.col("cog"), F.col("heading")))
        .withColumn("vessel_type_code", code)
    )


RAW_COLUMNS = ("timestamp", "mmsi", "lat", "lon", "sog", "cog", "heading", "vessel_type")


def is_valid(bounds: tuple[float, float, float, float]) -> Column:
    return (
        F.col("timestamp").isNotNull()
        & F.col("mmsi").isNotNull()
        & (F.col("mmsi") > 0)
        & in_box(F.col("lat"), F.col("lon"), bounds)
        & F.col("sog").between(0.0, MAX_SOG_KNOTS * KNOTS_TO_KMH)
        & F.col("cog").between(0.0, 360.0)
    )


def deduplicate(points: DataFrame, keys: tuple[str, ...] = ("mmsi", "timestamp")) -> DataFrame:
    """One row per key over the whole table: the smallest row in column order.

    min(struct) combines on the map side, so copies of one report collapse before
    the shuffle however often they occur.
    """
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}") for c in points.columns]
    )


def clean(
    raw: DataFrame,
    bounds: tuple[float, float, float, float],
    *,
    source: str = "noaa",
    timestamp_format: str | None = None,
    commercial_only: bool = True,
) -> DataFrame:
    """The whole cleaning step, from canonical string columns to points.

    The parsed row passes through a one-element generator. Filters are not pushed
    below it, where they would parse the text of every row a second time.
    """
    parsed = normalize(raw, source, timestamp_format)
    points = parsed.select(F.inline_outer(F.array(F.struct(*parsed.columns)))).filter(is_valid(bounds))
    if commercial_only:
        points = points.filter(is_commercial(F.col("vessel_type_code"), F.col("vessel_type")))
    return deduplicate(points)


def resolve_bounds(
    region: str | None = None,
    *,
    lat_min: float | None = None,
    lat_max: float | None = None,
    lon_min: float | None = None,
    lon_max: float | None = None,
) -> tuple[float, float, float, float]:
    """A named region, any side of which can be overridden."""
    if region is not None and region not in REGIONS:
        raise ValueError(f"Unknown region {region!r}; known: {sorted(REGIONS)}")
    base = REGIONS.get(region, (None,) * 4)
    given = (lat_min, lat_max, lon_min, lon_max)
    out = tuple(b if g is None else g for g, b in zip(given, base))
    if any(v is None for v in out):
        raise ValueError("Give a region or all four sides of a box")
    return out


def flag_in_frame(points: DataFrame, bounds: tuple[float, float, float, float], *, strict: bool = False) -> DataFrame:
    flagged = points.withColumn("in_frame", F.coalesce(in_box(F.col("lat"), F.col("lon"), bounds), F.lit(False)))
    return flagged.filter("in_frame") if strict else flagged


def regions_of_points(points: DataFrame) -> DataFrame:
    """One row per point and region that holds it, through an array of box tests.

    The region table is fixed, so the tests are literals in one projection: no join.
    """
    names = [
        F.when(in_box(F.col("lat"), F.col("lon"), box), F.lit(name)) for name, box in REGIONS.items()
    ]
    return points.withColumn("region", F.explode(F.array_compact(F.array(*names))))


def fill_motion_columns(segments: DataFrame) -> DataFrame:
    """Velocity components for files that lack them, from speed and course or zero.

    The speed of such files is in knots, hence the conversion.
    """
    have = set(segments.columns)
    if {"v_north_kmh", "v_east_kmh"} <= have:
        return segments
    if {"sog", "cog_sin", "cog_cos"} <= have:
        kmh = F.col("sog") * F.lit(KNOTS_TO_KMH)
        return segments.withColumn("v_north_kmh", kmh * F.col("cog_cos")).withColumn(
            "v_east_kmh", kmh * F.col("cog_sin")
        )
    return segments.withColumn("v_north_kmh", F.lit(0.0)).withColumn("v_east_kmh", F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value on either side; NULL stays NULL."""
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(high)).otherwise(out)
    return out


def swapped_position_check(points: DataFrame, median_fn, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose latitude equals the longitude, and whether medians are plausible."""
    share = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg((F.round("lat", 4) == F.round("lon", 4)).cast("int")).alias("lat_lon_equal_frac"),
    )
    medians = median_fn(points, ["lat", "lon"], {"median": 0.5}, by)
    joined = share.join(medians, list(by)) if by else share.withColumn("_k", F.lit(1)).join(
        medians.withColumn("_k", F.lit(1)), "_k"
    ).drop("_k")
    return joined.withColumn(
        "plausible",
        F.col("median_lat").between(10.0, 55.0)
        & F.col("median_lon").between(-130.0, -65.0)
        & (F.col("lat_lon_equal_frac") < 0.05),
    )
