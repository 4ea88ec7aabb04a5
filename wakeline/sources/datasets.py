"""Many dataset folders ais_<region>[_<n>d|_<n>m]_long_horizon as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.constants import COAST_REGION

FOLDER = r"/ais_([^/]+?)(?:_(\d+[dm]))?_long_horizon/"


def with_origin(df: DataFrame) -> DataFrame:
    """Adds coast folder, region, period tag and source path of each row's file."""
    path = F.url_decode(F.col("_metadata.file_path"))
    return df.select(
        "*",
        F.regexp_extract(path, r"/([^/]+)/ais_[^/]+_long_horizon/", 1).alias("coast"),
        F.regexp_extract(path, FOLDER, 1).alias("region"),
        F.regexp_extract(path, FOLDER, 2).alias("tag"),
        F.regexp_extract(path, r"/([^/]+/ais_[^/]+_long_horizon)/", 1).alias("source_file"),
    )


def is_canonical(tag: str | None = None, include_misplaced: bool = False) -> Column:
    """Keep a dataset unless it is too short (one day), misplaced, or not of the wanted tag."""
    table = F.create_map(*[F.lit(x) for pair in COAST_REGION.items() for x in pair])
    expected = F.try_element_at(table, F.col("coast"))
    ok = (F.col("region") != "") & (F.col("tag") != "1d")
    if tag:
        ok = ok & (F.col("tag") == tag)
    if not include_misplaced:
        ok = ok & (expected.isNull() | (expected == F.col("region")))
    return ok


def read_datasets(
    spark: SparkSession, root: str, file_glob: str = "*.parquet", *, tag: str | None = None, include_misplaced: bool = False
) -> DataFrame:
    """Canonical datasets under a root, with region and source of each row and text trajectory ids."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).parquet(root)
    kept = with_origin(files).filter(is_canonical(tag, include_misplaced))
    if "traj_id" in kept.columns:
        kept = kept.withColumn("traj_id", F.col("traj_id").cast("string"))
    return kept


def list_datasets(spark: SparkSession, root: str, file_glob: str = "*.parquet", *, tag: str | None = None, include_misplaced: bool = False) -> DataFrame:
    """Every dataset folder with its rows and whether it would be kept."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).parquet(root)
    return (
        with_origin(files)
        .groupBy("coast", "region", "tag", "source_file")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("keep", is_canonical(tag, include_misplaced))
    )


def unite_coasts(parts: dict[str, DataFrame], qualify_ids: bool = False) -> DataFrame:
    """Union of window tables by region; missing columns become NULL.

    Trajectories are numbered per coast, so two coasts may share an id and then form one
    group in splits. `qualify_ids` puts the region before each id, which keeps them apart.
    """
    out = None
    for region, df in parts.items():
        plain = F.col("traj_id").cast("string")
        traj_id = F.concat(F.lit(f"{region}:"), plain) if qualify_ids else plain
        labelled = df.withColumn("region", F.lit(region)).withColumn("traj_id", traj_id)
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    return out


def rebuild(spark: SparkSession, builders: dict[str, "callable"], root: str, *, overwrite: bool = False) -> list[str]:
    """Write each named dataset; existing ones are skipped unless overwriting. Returns what was built."""
    built = []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name, build in builders.items():
        target = hadoop(f"{root}/{name}")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        done = fs.exists(hadoop(f"{root}/{name}/_SUCCESS"))
        if done and not overwrite:
            continue
        build().write.mode("overwrite").parquet(f"{root}/{name}")
        built.append(name)
    return built
