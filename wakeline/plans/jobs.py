"""Whole jobs: raw files or days to windows, coasts to split tables, windows to a training table, and audits."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.constants import FUTURE_HOURS, HISTORY_HOURS, RESAMPLE_MINUTES
from wakeline.functions.clock import prepare_session
from wakeline.operators.audit import trajectory_audit, vessel_audit
from wakeline.operators.clean import clean
from wakeline.operators.land import LandGrid, filter_inland, inland_fraction
from wakeline.operators.motion import (
    SmartMotionConfig,
    StationaryConfig,
    fails_smart_motion,
    history_metrics,
    is_stationary,
    measured_once,
    smart_metrics,
)
from wakeline.operators.resample import resample
from wakeline.operators.segment import SegmentConfig, build_segments, trajectory_stats
from wakeline.operators.split import split_groups
from wakeline.operators.windows import build_windows
from wakeline.plans.increments import SegmentState
from wakeline.sources.ais_csv import read_raw
from wakeline.sources.datasets import unite_coasts
from wakeline.sources.days import dataset_label, ingest_days, points_of_file_days, processed_days
from wakeline.sources.scratch import materialize
from wakeline.sources.tables import write_csv, write_table


@dataclass(frozen=True)
class WindowConfig:
    history_hours: float = HISTORY_HOURS
    future_hours: float = FUTURE_HOURS
    resample_minutes: int = RESAMPLE_MINUTES
    max_gap_steps: int = 6
    cap: int | None = None  # windows per trajectory; all unless asked
    seed: int = 42
    frame: tuple[float, float, float, float] | None = None
    require_contiguous: bool = False


@dataclass(frozen=True)
class TrainingConfig:
    stationary: StationaryConfig = field(default_factory=StationaryConfig)
    smart: SmartMotionConfig = field(default_factory=SmartMotionConfig)
    test_fraction: float = 0.2
    val_fraction: float = 0.1
    seed: int = 42


def windows_of(segments: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    grid = resample(segments, cfg.resample_minutes, cfg.max_gap_steps)
    return build_windows(
        grid,
        history_hours=cfg.history_hours,
        future_hours=cfg.future_hours,
        resample_minutes=cfg.resample_minutes,
        cap=cfg.cap,
        seed=cfg.seed,
        frame=cfg.frame,
        require_contiguous=cfg.require_contiguous,
    )


def raw_to_windows(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    bounds: tuple[float, float, float, float],
    *,
    source: str = "auto",
    commercial_only: bool = True,
    segment_cfg: SegmentConfig = SegmentConfig(),
    window_cfg: WindowConfig = WindowConfig(),
) -> dict[str, str]:
    """Points, segments, trajectory statistics and windows, each written once and read by the next step."""
    prepare_session(spark)
    paths = {name: f"{out_dir}/{name}" for name in ("points", "segments", "trajectory_stats", "windows")}
    raw, found, fmt = read_raw(spark, raw_path, source)
    write_table(clean(raw, bounds, source=found, timestamp_format=fmt, commercial_only=commercial_only), paths["points"])
    write_table(build_segments(spark.read.parquet(paths["points"]), segment_cfg), paths["segments"])
    segments = spark.read.parquet(paths["segments"])
    write_csv(trajectory_stats(segments), paths["trajectory_stats"])
    write_table(windows_of(segments, window_cfg), paths["windows"])
    return paths


def incremental_job(
    spark: SparkSession,
    days_dir: str,
    out_dir: str,
    region: str,
    tag: str | None,
    start: dt.date,
    end: dt.date,
    points_of_days,
    *,
    segment_cfg: SegmentConfig = SegmentConfig(),
    window_cfg: WindowConfig = WindowConfig(),
) -> dict[str, str]:
    """Ingest the days that are not done, bring the segments up to date, and write statistics and windows again.

    Tables carry the label of region and tag in their folder name. Segments are kept as a state that new days are
    added to: only chunks of time that they change are read and derived again. Days that were ingested
    by a run that was lost before it added them are added by the next one.
    """
    prepare_session(spark)
    ingest_days(spark, days_dir, start, end, points_of_days)
    root = f"{out_dir}/ais_{dataset_label(region, tag)}_long_horizon"
    paths = {name: f"{root}/{name}" for name in ("segment_state", "trajectory_stats", "windows")}
    state = SegmentState(spark, paths["segment_state"], segment_cfg)
    new = sorted(d for d in processed_days(spark, days_dir) if d.toordinal() not in state.sources())
    if new:
        state.append(points_of_file_days(spark, days_dir, new), [d.toordinal() for d in new])
    segments = state.segments()
    write_csv(trajectory_stats(segments), paths["trajectory_stats"], mode="overwrite")
    write_table(windows_of(segments, window_cfg), paths["windows"], mode="overwrite")
    return paths


def combine_job(
    spark: SparkSession,
    coasts: dict[str, DataFrame],
    out_dir: str,
    land: LandGrid | None = None,
    cfg: TrainingConfig = TrainingConfig(),
    step_minutes: int = RESAMPLE_MINUTES,
    *,
    qualify_ids: bool = False,
    second_split: bool = False,
) -> DataFrame:
    """Union of coasts, split, filters, one table per split, and a report of each stage.

    All windows are split first and filtered within their split. With `second_split` the
    inland filter is applied to the train part only, which is then split again: the other
    parts are left out. Each window is written once with its label and whether it passes
    each filter; the report (stage, split, windows) and the tables read that. The report is
    also written as JSON.
    """
    prepare_session(spark)
    united = unite_coasts(coasts, qualify_ids)
    measured = measured_once(smart_metrics(history_metrics(united), step_minutes), united.columns)
    at_sea = inland_fraction(measured, land) if land is not None else measured.withColumn("inland_fraction", F.lit(0.0))
    flagged = materialize(
        at_sea.select(
            *united.columns,
            (~is_stationary(cfg.stationary)).alias("_moves"),
            (~is_stationary(cfg.stationary) & ~fails_smart_motion(cfg.smart)).alias("_smart"),
            (F.coalesce("inland_fraction", F.lit(0.0)) <= 0.5).alias("_at_sea"),
        ),
        "flagged-windows",
    )
    fractions = {"test_fraction": cfg.test_fraction, "val_fraction": cfg.val_fraction, "seed": cfg.seed}
    labelled = split_groups(flagged, **fractions, always_val=True)
    stages = [("combined", F.lit(True)), ("stationary", F.col("_moves")), ("smart_motion", F.col("_smart"))]
    kept = labelled.filter("_smart AND _at_sea")
    if second_split:
        kept = split_groups(materialize(kept.filter("split = 'train'").drop("split"), "train-windows"), **fractions)
    else:
        stages.append(("inland", F.col("_smart") & F.col("_at_sea")))
    passed = F.array(*[F.when(ok, F.lit(name)) for name, ok in stages])
    counts = labelled.select("split", F.explode(F.array_compact(passed)).alias("stage")).groupBy("stage", "split").count()
    if second_split:
        last = kept.groupBy("split").count().select(F.lit("inland_second_split").alias("stage"), "split", "count")
        counts = counts.unionByName(last)
    kept.drop("_moves", "_smart", "_at_sea").write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/windows")
    report = materialize(counts.withColumnRenamed("count", "windows"), "stage-report")
    report.coalesce(1).write.mode("overwrite").json(f"{out_dir}/report")
    return report


def training_table(
    windows: DataFrame, land: LandGrid | None = None, cfg: TrainingConfig = TrainingConfig(), step_minutes: int = RESAMPLE_MINUTES
) -> DataFrame:
    """Windows that move and lie at sea, labelled train / val / test.

    The filters are maps over the windows. The kept windows are written once: the split
    reads their trajectory ids, and the label is a map over them again.
    """
    kept = filter_motion(windows, cfg, step_minutes)
    if land is not None:
        kept = filter_inland(kept, land)
    kept = materialize(kept, "kept-windows")
    return split_groups(kept, test_fraction=cfg.test_fraction, val_fraction=cfg.val_fraction, seed=cfg.seed)


def filter_motion(windows: DataFrame, cfg: TrainingConfig, step_minutes: int = RESAMPLE_MINUTES) -> DataFrame:
    measured = measured_once(smart_metrics(history_metrics(windows), step_minutes), windows.columns)
    return measured.filter(~is_stationary(cfg.stationary) & ~fails_smart_motion(cfg.smart)).select(*windows.columns)


def audit_tables(segments: DataFrame, cfg: WindowConfig = WindowConfig()) -> tuple[DataFrame, DataFrame]:
    trajectories = trajectory_audit(segments, cfg.history_hours, cfg.future_hours, cfg.resample_minutes)
    return trajectories, vessel_audit(trajectories)
