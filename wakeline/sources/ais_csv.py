"""Raw AIS CSV files to canonical string columns."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Header names accepted per canonical column, lower case with '_' for spaces.
NOAA_NAMES = {
    "mmsi": ("mmsi",),
    "timestamp": ("base_date_time", "basedatetime"),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lon"),
    "sog": ("sog",),
    "cog": ("cog",),
    "heading": ("heading",),
    "vessel_type": ("vessel_type", "vesseltype"),
}
# Header and timestamp format of Danish files.
DANISH_NAMES = {
    "timestamp": "# Timestamp",
    "mmsi": "MMSI",
    "lat": "Latitude",
    "lon": "Longitude",
    "sog": "SOG",
    "cog": "COG",
    "heading": "Heading",
    "vessel_type": "Ship type",
}
DANISH_TIMESTAMP = "dd/MM/yyyy HH:mm:ss"
CSV_GLOB = "*.csv*"


def map_header(columns: list[str], source: str = "auto") -> tuple[str, dict[str, str], str | None]:
    """(source, canonical -> file column, timestamp format); an error names what is missing."""
    if source not in ("auto", "noaa", "danish"):
        raise ValueError(f"Unknown source {source!r}")
    by_name = {c.strip().lower().replace(" ", "_"): c for c in columns}
    noaa_time = any(n in by_name for n in NOAA_NAMES["timestamp"])
    if source == "noaa" or (source == "auto" and noaa_time):
        found = {k: next((by_name[n] for n in names if n in by_name), None) for k, names in NOAA_NAMES.items()}
        missing = [k for k, v in found.items() if v is None]
        if missing:
            raise ValueError(f"NOAA files lack columns for: {', '.join(missing)}")
        return "noaa", found, None
    if source == "danish" or any(c.startswith("#") for c in by_name):
        missing = [c for c in DANISH_NAMES.values() if c not in columns]
        if missing:
            raise ValueError(f"Danish files lack columns: {', '.join(missing)}")
        return "danish", dict(DANISH_NAMES), DANISH_TIMESTAMP
    raise ValueError("Cannot tell the AIS format from the header; pass source='noaa' or 'danish'")


def headers_of(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of a path by header, the first line that names an mmsi column.

    One scan of the text; what reaches the driver is a row per file, as in a file listing.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CSV_GLOB).text(path)
    files = sorted({unquote(f) for f in lines.inputFiles()})
    found = (
        lines.select(F.col("_metadata.file_path").alias("file"), "value")
        .filter(F.lower("value").contains("mmsi"))
        .groupBy("file")
        .agg(F.min("value").alias("header"))
        .collect()
    )
    plain = lambda file: re.sub(r"^file:/+", "/", file)
    names = {plain(unquote(r["file"])): r["header"] for r in found}
    out: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        header = names.get(plain(file))
        if header is None:
            if spark.read.text(file).isEmpty():
                continue
            raise ValueError(f"{file}: no header line with an mmsi column")
        columns = tuple(c.strip().strip('"') for c in header.lstrip("\ufeff").split(","))
        out.setdefault(columns, []).append(file)
    return out


def read_raw(spark: SparkSession, path: str | list[str], source: str = "auto") -> tuple[DataFrame, str, str | None]:
    """(canonical string columns, source, timestamp format) of files that may differ in header.

    Files are grouped by their own header and each group is mapped and read by it, so old
    and new names and any column order mix in one folder. A file that lacks a column, or
    is of another source than the rest, fails with its name.
    """
    parts, sources = [], {}
    for columns, files in headers_of(spark, path).items():
        try:
            found, names, fmt = map_header(list(columns), source)
        except ValueError as error:
            raise ValueError(f"{files[0]}: {error}") from error
        sources[found] = (files[0], fmt)
        rows = spark.read.schema(raw_schema(list(columns))).csv(files, header=True, enforceSchema=False)
        parts.append(rows.select(*[F.col(f"`{c}`").cast("string").alias(k) for k, c in names.items()]))
    if not parts:
        raise ValueError(f"No CSV files in {path}")
    if len(sources) > 1:
        raise ValueError("Files of several sources: " + ", ".join(f"{k} ({f})" for k, (f, _) in sources.items()))
    (found, (_, fmt)), = sources.items()
    return reduce(DataFrame.unionByName, parts), found, fmt


def raw_schema(columns: list[str]) -> T.StructType:
    """String schema in file order, for streaming reads, which do not infer."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def stream_raw(spark: SparkSession, path: str, columns: list[str], source: str = "auto", files_per_batch: int = 1000) -> tuple[DataFrame, str, str | None]:
    """The same as a file stream of one header: each landed file is read exactly once.

    A file with another header or column order stops the stream instead of shifting columns.
    """
    found, names, fmt = map_header(columns, source)
    files = (
        spark.readStream.schema(raw_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", CSV_GLOB)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )
    return files.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()]), found, fmt


def write_raw_csv(
    raw: DataFrame, path: str, style: str = "noaa_new", compression: str | None = None, in_order: list[str] | None = None
) -> None:
    """Canonical string columns to CSV with one of the known headers, in any column order."""
    names = {
        "noaa_old": dict(zip(NOAA_NAMES, ("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselType"))),
        "noaa_new": dict(zip(NOAA_NAMES, ("mmsi", "base_date_time", "latitude", "longitude", "sog", "cog", "heading", "vessel_type"))),
        "danish": DANISH_NAMES,
    }[style]
    out = raw.select(*[F.col(k).alias(names[k]) for k in in_order or names])
    writer = out.write.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
