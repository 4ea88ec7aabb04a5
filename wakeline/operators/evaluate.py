"""Forecast errors by model, horizon and motion bucket, and comparison of runs.

Input is the `forecasts` shape: model, window_id, anchor (struct lat, lon),
true_track and pred_track (arrays of structs), one row per window and model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.constants import EXPECTED_FUTURE_STEPS, MIN_NORMALIZE_KM, NM_TO_KM
from wakeline.functions.geo import haversine_km
from wakeline.functions.ranking import exact_percentiles, hash_rank, percentile_columns
from wakeline.functions.series import mean, path_km
from wakeline.operators.motion import bucket_names, motion_buckets
from wakeline.sources.scratch import materialize


def _distance(a: Column, b: Column) -> Column:
    return haversine_km(a.lat, a.lon, b.lat, b.lon)


def to_predictions(forecasts: DataFrame) -> DataFrame:
    """Long form: one row per model, window and step.

    The outer explode keeps Spark from testing the computed array for emptiness
    first, which would evaluate it twice.
    """
    pairs = F.arrays_zip(F.col("true_track").alias("t"), F.col("pred_track").alias("p"))
    return forecasts.select("model", "window_id", "anchor", F.posexplode_outer(pairs).alias("step", "_z")).select(
        "model",
        "window_id",
        "step",
        F.col("_z.t.lat").alias("true_lat"),
        F.col("_z.t.lon").alias("true_lon"),
        F.col("_z.p.lat").alias("pred_lat"),
        F.col("_z.p.lon").alias("pred_lon"),
        F.col("anchor.lat").alias("anchor_lat"),
        F.col("anchor.lon").alias("anchor_lon"),
    )


def from_predictions(predictions: DataFrame) -> DataFrame:
    """Arrays again; a window has a fixed number of steps, so each group is small."""
    step = F.struct(
        "step",
        F.struct(F.col("true_lat").alias("lat"), F.col("true_lon").alias("lon")).alias("t"),
        F.struct(F.col("pred_lat").alias("lat"), F.col("pred_lon").alias("lon")).alias("p"),
    )
    rows = predictions.groupBy("model", "window_id").agg(
        F.first(F.struct(F.col("anchor_lat").alias("lat"), F.col("anchor_lon").alias("lon"))).alias("anchor"),
        F.array_sort(F.collect_list(step)).alias("_s"),
    )
    return rows.select(
        "model", "window_id", "anchor", F.col("_s.t").alias("true_track"), F.col("_s.p").alias("pred_track")
    )


def with_errors(forecasts: DataFrame, step: int | None = None, floor_km: float = MIN_NORMALIZE_KM) -> DataFrame:
    """Per window: error at the final (or given) step, mean error over steps, and both normalised.

    The true path starts at the first future point; displacement and path are
    floored before dividing.
    """
    at = (lambda arr: F.element_at(arr, -1)) if step is None else (lambda arr: F.element_at(arr, step + 1))
    errors = F.zip_with("true_track", "pred_track", _distance)
    return (
        forecasts.withColumn("_t", at(F.col("true_track")))
        .withColumn("_p", at(F.col("pred_track")))
        .withColumn("fde_km", _distance(F.col("_t"), F.col("_p")))
        .withColumn("step_errors_km", errors)
        .withColumn("ade_km", mean(F.col("step_errors_km")))
        .withColumn("displacement_km", F.greatest(_distance(F.col("anchor"), F.col("_t")), F.lit(floor_km)))
        .withColumn("true_path_km", F.greatest(path_km(F.col("true_track")), F.lit(floor_km)))
        .withColumn("nfde", F.col("fde_km") / F.col("displacement_km"))
        .withColumn("nade", F.col("ade_km") / F.col("true_path_km"))
        .select("*", F.col("_t.lat").alias("true_lat"), F.col("_t.lon").alias("true_lon"),
                F.col("_p.lat").alias("pred_lat"), F.col("_p.lon").alias("pred_lon"))
        .drop("_t", "_p")
    )


def r_squared(truth: str, pred: str) -> Column:
    """1 - SSres / SStot (not the squared correlation)."""
    residual = F.sum(F.pow(F.col(truth) - F.col(pred), F.lit(2)))
    return F.lit(1.0) - F.try_divide(residual, F.var_pop(truth) * F.count(truth))


def final_position_metrics(errors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, R² by coordinate and great-circle error statistics per group.

    errors: columns fde_km, nfde, displacement_km and true/pred lat and lon.
    """
    slim = materialize(
        errors.select(*by, "true_lat", "true_lon", "pred_lat", "pred_lon", "fde_km", "nfde", "displacement_km"), "final"
    )
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in ("lat", "lon"):
        diff = F.col(f"true_{c}") - F.col(f"pred_{c}")
        aggs += [
            F.avg(F.abs(diff)).alias(f"mae_{c}"),
            F.sqrt(F.avg(diff * diff)).alias(f"rmse_{c}"),
            r_squared(f"true_{c}", f"pred_{c}").alias(f"r2_{c}"),
        ]
    aggs += [
        F.avg("fde_km").alias("mean_error_km"),
        F.avg("nfde").alias("mean_nfde"),
        F.avg("displacement_km").alias("mean_future_displacement_km"),
    ]
    base = slim.groupBy(*by).agg(*aggs)
    q = percentile_columns(slim, ["fde_km", "nfde"], {"median": 0.5, "p90": 0.9, "p95": 0.95}, by, stored=True)
    out = base.join(F.broadcast(q), list(by))
    km = {"median": "median_fde_km", "p90": "p90_fde_km", "p95": "p95_fde_km"}
    for name, src in km.items():
        out = out.withColumn(f"{name}_error_km", F.col(src))
    for name in ("mean", "median", "p90", "p95"):
        out = out.withColumn(f"{name}_error_nm", F.col(f"{name}_error_km") / F.lit(NM_TO_KM))
    return out.drop(*km.values(), "p95_nfde")


def trajectory_metrics(errors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Error over whole tracks: all-step mean and median, per-window median, final step, nADE."""
    slim = materialize(errors.select(*by, "step_errors_km", "ade_km", "nade", "true_path_km"), "tracks")
    per_step = slim.select(*by, F.explode("step_errors_km").alias("step_error_km"))
    steps = per_step.groupBy(*by).agg(F.avg("step_error_km").alias("mean_ade_km"))
    windows = slim.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.element_at("step_errors_km", -1)).alias("final_step_mean_error_km"),
        F.avg("nade").alias("mean_nade"),
        F.avg("true_path_km").alias("mean_true_path_km"),
    )
    q_step = percentile_columns(per_step, ["step_error_km"], {"median": 0.5}, by, stored=True)
    q_window = percentile_columns(slim, ["ade_km", "nade"], {"median": 0.5, "p90": 0.9}, by, stored=True)
    out = windows
    for part in (steps, q_step, q_window):
        out = out.join(F.broadcast(part), list(by))
    return (
        out.withColumnRenamed("median_ade_km", "median_window_ade_km")
        .withColumn("mean_ade_nm", F.col("mean_ade_km") / F.lit(NM_TO_KM))
        .withColumn("median_step_error_nm", F.col("median_step_error_km") / F.lit(NM_TO_KM))
        .withColumn("final_step_mean_error_nm", F.col("final_step_mean_error_km") / F.lit(NM_TO_KM))
        .drop("p90_ade_km")
    )


def metrics_by_bucket(errors: DataFrame) -> DataFrame:
    """Final-position metrics per model and motion bucket; the buckets may overlap.

    errors must carry `hist` or the four bucket flags.
    """
    flagged = errors if "straight" in errors.columns else motion_buckets(errors)
    tall = flagged.withColumn("bucket", F.explode(bucket_names()))
    return final_position_metrics(tall, ("model", "bucket"))


def error_by_horizon(forecasts: DataFrame, step_minutes: float) -> DataFrame:
    """Median, mean and p90 error in nautical miles at each step, per model."""
    tall = forecasts.select(
        "model", F.posexplode_outer(F.zip_with("true_track", "pred_track", _distance)).alias("step", "km")
    ).select("model", "step", (F.col("km") / F.lit(NM_TO_KM)).alias("error_nm"))
    slim = materialize(tall, "horizon")
    means = slim.groupBy("model", "step").agg(F.count(F.lit(1)).alias("n"), F.avg("error_nm").alias("mean_error_nm"))
    q = percentile_columns(slim, ["error_nm"], {"median": 0.5, "p90": 0.9}, ("model", "step"), stored=True)
    return means.join(F.broadcast(q), ["model", "step"]).withColumn(
        "hours_ahead", (F.col("step") + 1) * F.lit(step_minutes / 60.0)
    )


def track_error(forecasts: DataFrame, ids: Sequence[str], step_minutes: float) -> DataFrame:
    """Per-step error of chosen windows."""
    return (
        forecasts.filter(F.col("window_id").isin(*ids))
        .select("model", "window_id", F.posexplode_outer(F.zip_with("true_track", "pred_track", _distance)).alias("step", "error_km"))
        .withColumn("hours_ahead", (F.col("step") + 1) * F.lit(step_minutes / 60.0))
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed bin, the last bin closed on the right; values outside and non-finite ones are left out."""
    v = F.col(value).cast("double")
    width = (high - low) / bins
    slot = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        df.filter(v.between(low, high))
        .groupBy(*by, slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_from", F.lit(low) + F.col("bin") * F.lit(width))
        .withColumn("bin_to", F.lit(low) + (F.col("bin") + 1) * F.lit(width))
    )


def box_quantiles(forecasts: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Quartiles and tails of the error at chosen steps, per model."""
    errors = F.zip_with("true_track", "pred_track", _distance)
    tall = forecasts.select("model", F.posexplode_outer(errors).alias("step", "error_km")).filter(F.col("step").isin(*steps))
    return exact_percentiles(tall, ["error_km"], [0.05, 0.25, 0.5, 0.75, 0.95], ("model", "step"))


def percent_change(metrics: DataFrame, base: str, other: str, names: Sequence[str]) -> DataFrame:
    """(other - base) / base in percent for each metric; NULL where the base is 0."""
    tall = metrics.select(
        "model", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("_e")
    ).select("model", "_e.metric", "_e.v")
    sides = tall.groupBy("metric").agg(
        F.max(F.when(F.col("model") == base, F.col("v"))).alias("base_value"),
        F.max(F.when(F.col("model") == other, F.col("v"))).alias("other_value"),
    )
    change = (F.col("other_value") - F.col("base_value")) / F.nullif("base_value", F.lit(0.0)) * 100
    return sides.withColumn("change_pct", F.round(change, 2))


ROW_KINDS = {
    # Parts of a metric row name that tell what the row measures.
    "naive": "Naive baseline",
    "kinematic": "Kinematic baseline",
    "full": "full predicted trajectory",
}


def metric_kind(name: Column) -> Column:
    """Kind of a metric row from its model name; NULL for names of no known kind."""
    kind = F.when(name.contains(ROW_KINDS["naive"]), F.lit("naive")).when(
        name.contains(ROW_KINDS["kinematic"]), F.lit("kinematic")
    )
    kind = kind.when(name.contains(ROW_KINDS["full"]), F.lit("full"))
    kind = kind.when(name.rlike(r"\[(straight|maneuver|anchored|other),"), F.regexp_extract(name, r"\[(\w+),", 1))
    is_model = name.contains("position (") & ~name.contains("[") & ~F.lower(name).contains("baseline")
    return kind.when(is_model, F.lit("model"))


def compare_runs(run_metrics: DataFrame, expected: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row per expected run: final errors by kind, best epoch, and whether the run is missing."""
    spark = run_metrics.sparkSession
    rows = run_metrics.select("run", "training.best_val_loss", "training.epochs_ran", F.explode("metrics").alias("m"))
    rows = rows.withColumn("kind", metric_kind(F.col("m.model"))).filter(F.col("kind").isNotNull())
    wide = rows.groupBy("run").pivot("kind", list(kinds)).agg(
        F.first("m.mean_error_km").alias("fde_km_mean"), F.first("m.median_error_km").alias("fde_km_median")
    )
    listed = spark.createDataFrame([(r,) for r in expected], "run string")
    return (
        listed.join(wide, "run", "left")
        .join(best_epochs(run_metrics), "run", "left")
        .withColumn("missing", F.col("best_val_loss").isNull())
    )


def best_epochs(run_metrics: DataFrame) -> DataFrame:
    """Epoch with the lowest validation loss (the earliest of equals) per run."""
    h = training_history(run_metrics)
    return h.groupBy("run").agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.count(F.lit(1)).alias("epochs_ran"),
    )


def training_history(
    run_metrics: DataFrame,
    future_steps: int = EXPECTED_FUTURE_STEPS,
    *,
    curriculum: bool = False,
    start_steps: int = 36,
    ramp_fraction: float = 0.5,
) -> DataFrame:
    """One row per run and epoch; the trained horizon is recomputed where the run did not store it.

    With a curriculum it grows linearly from `start_steps` to all steps over the
    first part of the epochs; without one it is always full.
    """
    h = run_metrics.select("run", "samples_train", F.size("history").alias("_epochs"), F.inline("history"))
    full = F.lit(future_steps)
    if curriculum:
        ramp = F.greatest(F.lit(1), F.floor(F.col("_epochs") * F.lit(ramp_fraction)))
        progress = F.least(F.lit(1.0), F.col("epoch") / ramp)
        grown = F.rint(F.lit(start_steps) + progress * F.lit(future_steps - start_steps))
        full = F.greatest(F.lit(1), F.least(grown.cast("int"), F.lit(future_steps)))
    return (
        h.withColumn("train_steps", F.coalesce(F.col("train_steps"), full).cast("int"))
        .withColumn("samples_per_sec", F.try_divide(F.col("samples_train"), F.col("epoch_sec")))
        .drop("_epochs")
    )


def compute_costs(run_metrics: DataFrame) -> DataFrame:
    """Training time and overall throughput (samples times epochs per second) per run."""
    return training_history(run_metrics).groupBy("run").agg(
        F.count(F.lit(1)).alias("epochs"),
        F.sum("epoch_sec").alias("train_sec"),
        F.try_divide(F.sum("samples_train"), F.sum("epoch_sec")).alias("samples_per_sec"),
    )


def rank_models(metrics: DataFrame, value: str = "median_error_km") -> DataFrame:
    """Rank over models, lowest error first; models are few, so one ordered group is fine."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(value).asc_nulls_last())
    return metrics.select("model", value).withColumn("rank", F.rank().over(w))


def best_of(metrics: DataFrame, value: str = "median_error_km") -> DataFrame:
    return metrics.agg(
        F.min_by("model", F.struct(value, "model")).alias("model"), F.min(value).alias(value)
    )


def final_errors(forecasts: DataFrame) -> DataFrame:
    """model, window_id and the final error only."""
    return forecasts.select(
        "model",
        "window_id",
        _distance(F.element_at("true_track", -1), F.element_at("pred_track", -1)).alias("fde_km"),
    )


def paired_comparison(errors: DataFrame, first: str, second: str) -> DataFrame:
    """Two models on the same windows: share where the first is better, and the median difference."""
    pair = errors.filter(F.col("model").isin(first, second)).groupBy("window_id").agg(
        F.max(F.when(F.col("model") == first, F.col("fde_km"))).alias("a"),
        F.max(F.when(F.col("model") == second, F.col("fde_km"))).alias("b"),
    )
    both = materialize(pair.filter("a IS NOT NULL AND b IS NOT NULL").select((F.col("a") - F.col("b")).alias("difference")), "pairs")
    share = both.agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("difference") < 0).cast("int"))).alias("first_better_pct")
    )
    median = percentile_columns(both, ["difference"], {"median": 0.5}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(share).join(F.broadcast(one(median)), "_k").drop("_k")


def sampled_pairs(forecasts: DataFrame, n: int, step: int, seed: int = 42) -> DataFrame:
    """True and predicted positions of at most n windows of each model at one step.

    Windows are drawn by the hash of their id alone, so models that share windows show the same ones.
    """
    flat = forecasts.select(
        "model",
        "window_id",
        F.col("true_track")[step]["lat"].alias("true_lat"),
        F.col("true_track")[step]["lon"].alias("true_lon"),
        F.col("pred_track")[step]["lat"].alias("pred_lat"),
        F.col("pred_track")[step]["lon"].alias("pred_lon"),
    )
    ranked = hash_rank(flat, ["window_id"], seed, by=["model"], name="_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def mask_history(windows: DataFrame, *, zero_from: int | None = None, zero_to: int | None = None, keep_last: int | None = None) -> DataFrame:
    """Zero every feature of a block of history steps, or of all but the newest steps."""
    n = F.size("hist")

    def masked(step, i):
        hide = (i < n - F.lit(keep_last)) if keep_last is not None else ((i >= F.lit(zero_from)) & (i < F.lit(zero_to)))
        zero = F.struct(*[F.lit(0.0).cast("float").alias(f) for f in _features(windows)])
        return F.when(hide, zero).otherwise(step)

    return windows.withColumn("hist", F.transform("hist", masked))


def _features(windows: DataFrame) -> list[str]:
    return windows.schema["hist"].dataType.elementType.fieldNames()


def masking_effect(windows: DataFrame, step_of, n_steps: int, block_steps: int, history_steps: int) -> DataFrame:
    """Change of the median final error when the oldest or the newest block of history is zeroed.

    The anchor and the truth come from the unmasked window.
    """
    from wakeline.operators.baselines import baseline_at
    from wakeline.operators.windows import anchor

    base = windows.withColumn("_anchor", anchor()).withColumn("_truth", F.element_at("fut", n_steps))
    cases = {
        "base": base,
        "oldest": mask_history(base, zero_from=0, zero_to=block_steps),
        "newest": mask_history(base, zero_from=max(0, history_steps - block_steps), zero_to=history_steps),
    }
    parts = None
    for name, frame in cases.items():
        p = baseline_at(F.col("hist"), F.col("_anchor"), n_steps - 1, step_of)
        err = haversine_km(F.col("_truth.lat").cast("double"), F.col("_truth.lon").cast("double"), p.lat, p.lon)
        part = frame.select(F.lit(name).alias("mask"), err.alias("fde_km"))
        parts = part if parts is None else parts.unionByName(part)
    med = percentile_columns(parts, ["fde_km"], {"median": 0.5}, ("mask",))
    whole = Window.partitionBy(F.lit(1))
    base_value = F.max(F.when(F.col("mask") == "base", F.col("median_fde_km"))).over(whole)
    return med.withColumn("delta_km", F.col("median_fde_km") - base_value)


def errors_with_buckets(windows: DataFrame, models, n_steps: int) -> DataFrame:
    """Forecast errors of baselines with the motion flags of each window."""
    from wakeline.operators.baselines import forecasts

    flagged = motion_buckets(windows)
    return with_errors(
        forecasts(flagged, models, n_steps, keep=("straight", "maneuver", "anchored", "other", "mean_sog", "max_dcog"))
    )


