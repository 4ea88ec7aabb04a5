"""JSON written by training runs: metrics, forecast samples and gate weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_METRICS = (
    "run string, samples_train long, samples_val long, samples_test long, runtime_sec double, "
    "training struct<best_val_loss: double, epochs_ran: int>, "
    "compute struct<param_count: long, peak_gpu_mb: double, avg_throughput_samples_per_sec: double>, "
    "metrics array<struct<model: string, mean_error_km: double, median_error_km: double, p90_error_km: double, "
    "mean_nfde: double, median_nfde: double, mean_ade_km: double, median_ade_km: double>>, "
    "history array<struct<epoch: int, train_loss: double, val_loss: double, lr: double, epoch_sec: double, train_steps: int>>"
)
FORECAST_SAMPLES = "model string, y_true array<array<array<double>>>, y_pred array<array<array<double>>>, anchor array<array<double>>"
GATE_WEIGHTS = "context_hours array<double>, per_sample array<array<double>>, per_sample_vessel_class array<int>"


def read_run_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per run file. A run without a name takes that of its folder."""
    runs = spark.read.schema(RUN_METRICS).option("multiLine", multi_line).json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return runs.select(F.coalesce("run", folder).alias("run"), *[c for c in runs.columns if c != "run"])


def metric_rows(runs: DataFrame) -> DataFrame:
    """One row per run and metric entry, with the kind told from its name."""
    from wakeline.operators.evaluate import metric_kind

    return runs.select("run", F.inline("metrics")).withColumn("kind", metric_kind(F.col("model")))


def read_forecast_samples(spark: SparkSession, path: str, model: str | None = None, multi_line: bool = True) -> DataFrame:
    """Nested sample files to the long `predictions` table.

    A file holds a small fixed sample of windows; the explode runs where it is read.
    """
    nested = spark.read.schema(FORECAST_SAMPLES).option("multiLine", multi_line).json(path)
    rows = nested.select(
        F.coalesce("model", F.lit(model)).alias("model"),
        F.posexplode(F.arrays_zip("y_true", "y_pred", "anchor")).alias("window_id", "w"),
    )
    steps = rows.select(
        "model", "window_id", F.col("w.anchor").alias("a"), F.posexplode(F.arrays_zip("w.y_true", "w.y_pred")).alias("step", "s")
    )
    return steps.select(
        "model",
        F.col("window_id").cast("bigint").alias("window_id"),
        "step",
        F.col("s.y_true")[0].alias("true_lat"),
        F.col("s.y_true")[1].alias("true_lon"),
        F.col("s.y_pred")[0].alias("pred_lat"),
        F.col("s.y_pred")[1].alias("pred_lon"),
        F.col("a")[0].alias("anchor_lat"),
        F.col("a")[1].alias("anchor_lon"),
    )


def read_gate_weights(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """window_id (position in the file), context_hours, alpha and, where given, vessel class."""
    nested = spark.read.schema(GATE_WEIGHTS).option("multiLine", multi_line).json(path)
    return nested.select(
        "context_hours", F.posexplode("per_sample").alias("window_id", "alpha"), "per_sample_vessel_class"
    ).select(
        F.col("window_id").cast("bigint").alias("window_id"),
        "context_hours",
        "alpha",
        F.try_element_at("per_sample_vessel_class", F.col("window_id") + 1).alias("vessel_class"),
    )
