"""Deterministic forecasts from the last report of a window, and regression on the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.constants import FEATURES, NM_TO_KM, PLANAR_KM_PER_DEG
from wakeline.operators.windows import (
    anchor,
    as_points,
    horizon_step,
    offsets_to_steps,
    to_absolute,
    window_id,
)

Predictor = Callable[[Column], Column]


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def naive_step(hist: Column) -> Column:
    """Last observed change of position, per grid step."""
    last = F.element_at(hist, -1)
    return _point(last.dlat.cast("double"), last.dlon.cast("double"))


def kinematic_step(hist: Column, step_minutes: float, sog_unit: str = "kmh") -> Column:
    """Constant speed and course per grid step.

    Stored speed is km/h. `as_reference` multiplies by 1.852 once more, which
    reproduces published figures of that baseline.
    """
    if sog_unit not in ("kmh", "as_reference"):
        raise ValueError(f"Unknown sog_unit {sog_unit!r}")
    last = F.element_at(hist, -1)
    speed = last.sog.cast("double") * F.lit(NM_TO_KM if sog_unit == "as_reference" else 1.0)
    hours = F.lit(step_minutes / 60.0)
    north = speed * last.cog_cos.cast("double") * hours
    east = speed * last.cog_sin.cast("double") * hours
    cos_lat = F.greatest(F.cos(F.radians(last.lat.cast("double"))), F.lit(1e-3))
    return _point(north / F.lit(PLANAR_KM_PER_DEG), east / (F.lit(PLANAR_KM_PER_DEG) * cos_lat))


def predictor(kind: str, step_minutes: float = 10.0, sog_unit: str = "kmh") -> Predictor:
    if kind == "naive":
        return naive_step
    if kind == "kinematic":
        return lambda hist: kinematic_step(hist, step_minutes, sog_unit)
    if kind == "persist":
        return lambda hist: _point(F.lit(0.0), F.lit(0.0))
    raise ValueError(f"Unknown baseline {kind!r}")


def cumulative_offsets(step: Column, n_steps: int) -> Column:
    """Offsets from the anchor after 1..n equal steps."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(n_steps)), lambda k: _point(step.lat * k, step.lon * k)
    )


def baseline_track(hist: Column, origin: Column, n_steps: int, step_of: Predictor) -> Column:
    return to_absolute(cumulative_offsets(step_of(hist), n_steps), origin)


def baseline_at(hist: Column, origin: Column, step: int, step_of: Predictor) -> Column:
    """Position at a 0-based step, without building the track."""
    d = step_of(hist)
    return _point(origin.lat + d.lat * (step + 1), origin.lon + d.lon * (step + 1))


def baseline_step_deltas(hist: Column, n_steps: int, step_of: Predictor) -> Column:
    return offsets_to_steps(cumulative_offsets(step_of(hist), n_steps))


def baseline_displacement(hist: Column, step: int, step_of: Predictor) -> Column:
    """Displacement from the anchor at a 0-based step (hour or chunk end)."""
    d = step_of(hist)
    return _point(d.lat * (step + 1), d.lon * (step + 1))


def forecasts(windows: DataFrame, models: dict[str, Predictor], n_steps: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per window and model with anchor, true track and predicted track."""
    base = windows.withColumn("anchor", anchor()).withColumn("true_track", as_points(F.slice("fut", F.lit(1), F.lit(n_steps))))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("model"), baseline_track(F.col("hist"), F.col("anchor"), n_steps, step_of).alias("pred_track"))
            for name, step_of in models.items()
        ]
    )
    return base.select(
        window_id().alias("window_id"), *keep, "anchor", "true_track", F.explode(rows).alias("_m")
    ).select("_m.model", "window_id", *keep, "anchor", "true_track", "_m.pred_track")


def apply_correction(windows: DataFrame, corrections: DataFrame, n_steps: int, step_of: Predictor) -> DataFrame:
    """Residual forecasts: baseline offset plus a given correction, as absolute positions.

    corrections: window_id and `correction`, an array of (lat, lon) offsets.
    """
    keyed = windows.withColumn("window_id", window_id()).join(corrections, "window_id")
    offsets = F.zip_with(
        cumulative_offsets(step_of(F.col("hist")), n_steps),
        F.col("correction"),
        lambda b, c: _point(b.lat + c.lat, b.lon + c.lon),
    )
    return keyed.withColumn("anchor", anchor()).withColumn("pred_track", to_absolute(offsets, F.col("anchor")))


def roll_forward(
    windows: DataFrame,
    *,
    n_chunks: int,
    steps_per_chunk: int,
    step_minutes: float,
    step_of: Predictor,
    sog_unit: str = "kmh",
) -> DataFrame:
    """Forecast chunk by chunk, feeding each chunk back as synthetic history rows.

    Each chunk is one projection over the shifted history; the chunk predictor sees
    only the history, so any Column function fits.
    """
    hours = step_minutes / 60.0

    def synthetic(last, move, s):
        lat_at = lambda k: last.lat.cast("double") + move.lat * (k / F.lit(steps_per_chunk))
        lon_at = lambda k: last.lon.cast("double") + move.lon * (k / F.lit(steps_per_chunk))

        def speed(k):
            dlat, dlon = lat_at(k) - lat_at(k - 1), lon_at(k) - lon_at(k - 1)
            north = dlat * F.lit(PLANAR_KM_PER_DEG)
            east = dlon * F.lit(PLANAR_KM_PER_DEG) * F.cos(F.radians(lat_at(k)))
            kmh = F.sqrt(north * north + east * east) / F.lit(hours)
            return kmh / F.lit(NM_TO_KM) if sog_unit == "as_reference" else kmh

        lat, lon = lat_at(s), lon_at(s)
        dlat, dlon = lat - lat_at(s - 1), lon - lon_at(s - 1)
        course = F.atan2(dlon * F.cos(F.radians(lat)), dlat)
        sog = speed(s)
        kmh = sog * F.lit(NM_TO_KM) if sog_unit == "as_reference" else sog
        before = F.when(s == 1, last.sog.cast("double")).otherwise(speed(s - 1))
        values = {
            "lat": lat,
            "lon": lon,
            "sog": sog,
            "cog_sin": F.sin(course),
            "cog_cos": F.cos(course),
            "heading_sin": F.sin(course),
            "heading_cos": F.cos(course),
            "heading_missing": F.lit(0.0),
            "dt_sec": F.lit(step_minutes * 60.0),
            "dlat": dlat,
            "dlon": dlon,
            "dsog": sog - before,
            "dcog": F.lit(0.0),
            "v_north_kmh": kmh * F.cos(course),
            "v_east_kmh": kmh * F.sin(course),
        }
        return F.struct(*[values[f].cast("float").alias(f) for f in FEATURES])

    steps = F.sequence(F.lit(1), F.lit(steps_per_chunk))
    out = windows.withColumn("anchor", anchor()).withColumns({"_h": F.col("hist"), "_pos": F.col("anchor")})
    tracks = []
    for chunk in range(n_chunks):
        unit = step_of(F.col("_h"))
        out = out.withColumn("_move", _point(unit.lat * F.lit(steps_per_chunk), unit.lon * F.lit(steps_per_chunk)))
        out = out.withColumns(
            {
                "_last": F.element_at("_h", -1),
                f"_track{chunk}": F.transform(
                    steps,
                    lambda s: _point(
                        F.col("_pos.lat") + F.col("_move.lat") * (s / F.lit(steps_per_chunk)),
                        F.col("_pos.lon") + F.col("_move.lon") * (s / F.lit(steps_per_chunk)),
                    ),
                ),
            }
        )
        tracks.append(f"_track{chunk}")
        if chunk + 1 < n_chunks:
            fresh = F.transform(steps, lambda s: synthetic(F.col("_last"), F.col("_move"), s))
            drop = F.least(F.lit(steps_per_chunk), F.size("_h"))
            out = out.withColumns(
                {
                    "_h": F.concat(F.slice("_h", drop + 1, F.size("_h") - drop), fresh),
                    "_pos": _point(F.col("_pos.lat") + F.col("_move.lat"), F.col("_pos.lon") + F.col("_move.lon")),
                }
            )
    return out.withColumn("pred_track", F.concat(*tracks)).drop("_h", "_pos", "_move", "_last", *tracks)


def fit_horizon_regression(
    windows: DataFrame, horizon_hours: float, step_minutes: float, future_steps: int, train: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Two linear fits (latitude and longitude offset at a horizon) on the scaled history.

    Returns every window with its true and predicted position at the horizon, and the columns of `keep` as they came.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from wakeline.operators.split import apply_scaler, fit_scaler
    from wakeline.sources.scratch import OVERLAPPING, materialize

    step = horizon_step(horizon_hours, step_minutes, future_steps)
    base = windows.withColumns(
        {"is_train": train, "window_id": window_id(), "anchor": anchor(), "truth": as_points("fut")[step]}
        | {f"_kept_{c}": F.col(c) for c in keep}
    )
    scaled = apply_scaler(base, fit_scaler(base.filter("is_train")))
    flat = F.flatten(F.transform("hist", lambda s: F.array(*[s[f] for f in FEATURES])))
    table = materialize(
        scaled.select(
            "window_id",
            "is_train",
            flat.alias("x"),
            "anchor",
            "truth",
            (F.col("truth.lat") - F.col("anchor.lat")).alias("dlat"),
            (F.col("truth.lon") - F.col("anchor.lon")).alias("dlon"),
            *[f"_kept_{c}" for c in keep],
        ),
        "regression",
        OVERLAPPING,
    )
    vectors = table.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    out = vectors
    for target in ("dlat", "dlon"):
        model = LinearRegression(featuresCol="features", labelCol=target, predictionCol=f"pred_{target}", solver="normal").fit(
            vectors.filter("is_train")
        )
        out = model.transform(out)
    return out.select(
        "window_id",
        "is_train",
        F.col("anchor"),
        F.col("truth.lat").alias("true_lat"),
        F.col("truth.lon").alias("true_lon"),
        (F.col("anchor.lat") + F.col("pred_dlat")).alias("pred_lat"),
        (F.col("anchor.lon") + F.col("pred_dlon")).alias("pred_lon"),
        *[F.col(f"_kept_{c}").alias(c) for c in keep],
    )
