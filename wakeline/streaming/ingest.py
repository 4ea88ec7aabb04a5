"""File streams of raw reports: cleaned points by day, and segments kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wakeline.functions.vessel import is_commercial
from wakeline.operators.clean import deduplicate, is_valid, normalize
from wakeline.operators.segment import SegmentConfig, build_segments
from wakeline.plans.increments import SegmentState
from wakeline.sources.ais_csv import stream_raw
from wakeline.sources.scratch import materialize


def clean_stream(
    spark: SparkSession,
    path: str,
    columns: list[str],
    bounds: tuple[float, float, float, float],
    *,
    source: str = "auto",
    commercial_only: bool = True,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Valid points of a file stream, every copy of every report, however late its file lands.

    Nothing is dropped by arrival: which copy of a report stays is decided where the
    points are read (`read_points`) or rebuilt (`write_segments`), by the same rule as
    in the batch path, so the order of files does not matter and no state is kept.
    """
    raw, found, fmt = stream_raw(spark, path, columns, source, files_per_batch)
    points = normalize(raw, found, fmt).filter(is_valid(bounds))
    if commercial_only:
        points = points.filter(is_commercial(F.col("vessel_type_code"), F.col("vessel_type")))
    return points


def write_points(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to day folders; everything available now is processed and the query ends."""
    return (
        points.withColumn("day", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Streamed points as one table, one row per (mmsi, timestamp), as the batch path gives them."""
    return deduplicate(spark.read.parquet(path).drop("day"))


def _drop_empty_groups(spark: SparkSession, path: str, touched: list[int], written: set[int]) -> None:
    """Remove the folders of touched groups that have no segments any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for group in touched:
        if group not in written:
            fs.delete(folder(f"{path}/vessel_group={group}"), True)


def write_segments(
    points: DataFrame,
    points_path: str,
    segments_path: str,
    checkpoint: str,
    cfg: SegmentConfig = SegmentConfig(),
    vessel_groups: int = 64,
) -> StreamingQuery:
    """Store each batch of points, then rebuild the segments of the vessel groups it touches.

    Both tables are partitioned by a vessel group (mmsi modulo `vessel_groups`), so
    a batch rewrites only the groups it touches. A batch folder is named by its
    number and replaced as a whole, which makes a repeated batch harmless.
    """
    group = F.pmod("mmsi", F.lit(vessel_groups)).cast("int")
    schema = T.StructType([*points.schema.fields, T.StructField("vessel_group", T.IntegerType())])

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch_dir = f"{points_path}/batch={number}"
        batch.withColumn("vessel_group", group).write.mode("overwrite").partitionBy("vessel_group").parquet(batch_dir)
        landed = spark.read.schema(schema).parquet(batch_dir)
        touched = [r["vessel_group"] for r in landed.select("vessel_group").distinct().collect()]
        if not touched:
            return
        stored = spark.read.schema(schema).option("basePath", points_path).parquet(f"{points_path}/batch=*")
        current = deduplicate(stored.filter(F.col("vessel_group").isin(*touched)).select(points.columns))
        segments = materialize(build_segments(current, cfg).withColumn("vessel_group", group), "batch-segments")
        written = {r["vessel_group"] for r in segments.select("vessel_group").distinct().collect()}
        (
            segments.hint("rebalance", F.col("vessel_group"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("vessel_group")
            .parquet(segments_path)
        )
        # A group is written as a whole, also when nothing is left of it.
        _drop_empty_groups(spark, segments_path, touched, written)

    return points.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_segments(points: DataFrame, root: str, checkpoint: str, cfg: SegmentConfig = SegmentConfig()) -> StreamingQuery:
    """Keep the segment state under `root` current: a batch costs the vessels' chunks of time it touches.

    Earlier reports are read only in chunks that a report of the batch lies in, or whose segments it changes; of all
    others the summaries are enough, so a vessel's history is not read again. Files may land in any order. A batch's
    number is part of the manifest that makes it visible: a batch that is repeated after a loss is not added twice.
    The state must be fed by this stream alone. Read it with `SegmentState(spark, root, cfg).segments()`.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        state = SegmentState(batch.sparkSession, root, cfg)
        if number not in state.sources():
            state.append(batch, sources=[number])

    return points.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
