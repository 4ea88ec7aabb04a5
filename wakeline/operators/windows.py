"""Fixed-length history/future windows as arrays, and the targets derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.constants import (
    EXPECTED_FUTURE_STEPS,
    EXPECTED_HISTORY_STEPS,
    FEATURE_ALIASES,
    FEATURES,
    FUTURE_HOURS,
    HISTORY_HOURS,
    TARGETS,
)
from wakeline.functions.geo import in_box
from wakeline.functions.ranking import seeded_hash
from wakeline.functions.series import consecutive, running_sum

KEYS = ("mmsi", "traj_id")
META = (
    "traj_id",
    "mmsi",
    "start_time",
    "split_time",
    "target_end_time",
    "history_steps",
    "future_steps",
    "resample_minutes",
)


def steps_for(hours: float, step_minutes: float) -> int:
    return int(round(hours * 60 / step_minutes))


def possible_starts(grid: DataFrame, total_steps: int, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Grid rows with their position, and whether a window may start there.

    With a cap, the starts of a trajectory are ordered by seeded hash and the first
    `cap` are kept. This happens before any array is built.
    """
    by_time = Window.partitionBy(*KEYS).orderBy("bin")
    whole = Window.partitionBy(*KEYS)
    out = grid.withColumn("pos", F.row_number().over(by_time) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    starts = F.col("pos") <= F.col("_n") - total_steps
    if cap:
        draw = Window.partitionBy(*KEYS, "_can").orderBy("_draw")
        out = (
            out.withColumn("_can", starts)
            .withColumn("_draw", seeded_hash(seed, "traj_id", F.col("pos").cast("string")))
            .withColumn("_rank", F.row_number().over(draw))
        )
        starts = F.col("_can") & (F.col("_rank") <= cap)
    return out.filter(F.col("_n") >= total_steps).withColumn("start", starts).drop("_n", "_can", "_draw", "_rank")


def build_windows(
    grid: DataFrame,
    *,
    history_hours: float = HISTORY_HOURS,
    future_hours: float = FUTURE_HOURS,
    resample_minutes: int = 10,
    cap: int | None = None,
    seed: int = 42,
    frame: tuple[float, float, float, float] | None = None,
    require_contiguous: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Every stride-1 window of each trajectory.

    Grid rows are grouped in blocks of positions, each with the first rows of the
    next block, so any window lies in one block. A block is collected once and its
    windows are slices of that array: the shuffle carries each grid row about once
    instead of once per window, and a long trajectory is spread over many tasks.
    """
    h, f = steps_for(history_hours, resample_minutes), steps_for(future_hours, resample_minutes)
    if h <= 0 or f <= 0:
        raise ValueError("history and future must each span at least one step")
    total = h + f
    size = block_rows or max(512, 4 * total)
    if size < total:
        raise ValueError("block_rows must hold at least one window")

    rows = possible_starts(grid, total, cap, seed)
    block = F.floor(F.col("pos") / F.lit(size)).cast("int")
    in_overlap = (F.col("pos") % size < total - 1) & (F.col("pos") >= size)
    blocks = F.when(in_overlap, F.array(block, block - 1)).otherwise(F.array(block))
    step = F.struct(*[F.col(c).cast("float").alias(c) for c in FEATURES])
    collected = (
        rows.withColumn("_block", F.explode(blocks))
        .withColumn("start", F.col("start") & (F.col("_block") == block))
        .select(*KEYS, "_block", F.struct("pos", "timestamp", "start", step.alias("x")).alias("_row"))
        .repartition(*KEYS, "_block")
        .groupBy(*KEYS, "_block")
        .agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    )
    arrays = collected.select(
        *KEYS,
        F.col("_rows.timestamp").alias("_ts"),
        F.col("_rows.x").alias("_x"),
        F.filter(
            F.transform(F.col("_rows"), lambda r, i: F.when(r.start, i)), lambda i: i.isNotNull()
        ).alias("_starts"),
    ).withColumn("_y", F.transform("_x", lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon"))))
    one = arrays.select(*KEYS, "_ts", "_x", "_y", F.explode("_starts").alias("_i"))
    at = lambda k: F.element_at(F.col("_ts"), F.col("_i") + F.lit(k))
    out = one.select(
        "traj_id",
        "mmsi",
        at(1).alias("start_time"),
        at(h).alias("split_time"),
        at(total).alias("target_end_time"),
        F.lit(h).alias("history_steps"),
        F.lit(f).alias("future_steps"),
        F.lit(resample_minutes).alias("resample_minutes"),
        F.slice("_x", F.col("_i") + 1, F.lit(h)).alias("hist"),
        F.slice("_y", F.col("_i") + F.lit(h + 1), F.lit(f)).alias("fut"),
    )
    if require_contiguous:
        span = (F.unix_micros(F.col("target_end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp")))
        out = out.filter(span == (total - 1) * resample_minutes * 60_000_000)
    if frame is not None:
        out = future_in_frame(out, frame)
    return out


def future_in_frame(windows: DataFrame, frame: tuple[float, float, float, float]) -> DataFrame:
    """Drop windows whose future leaves the box."""
    return windows.filter(F.forall("fut", lambda p: in_box(p.lat, p.lon, frame)))


def window_id(start: Column | None = None) -> Column:
    """Stable text key of a window: trajectory and start second."""
    start = start if start is not None else F.col("start_time")
    return F.concat_ws("@", F.col("traj_id"), F.unix_seconds(start.cast("timestamp")).cast("string"))


def to_wide(windows: DataFrame, history_steps: int, future_steps: int) -> DataFrame:
    """Export form: one column per step and feature. Only for writing, never for analysis."""
    x = [
        F.col("hist")[t][name].alias(f"x_t{t:03d}_{name}") for t in range(history_steps) for name in FEATURES
    ]
    y = [F.col("fut")[t][name].alias(f"y_t{t:03d}_{name}") for t in range(future_steps) for name in TARGETS]
    meta = [c for c in windows.columns if c not in ("hist", "fut")]
    return windows.select(*meta, *x, *y)


def from_wide(wide: DataFrame) -> DataFrame:
    """Wide columns back to arrays; old feature names are accepted."""
    h, f = shape_from_columns(wide.columns)
    names = feature_columns(wide.columns)
    hist = F.array(
        *[
            F.struct(*[F.col(f"x_t{t:03d}_{names[n]}").cast("float").alias(n) for n in FEATURES if n in names])
            for t in range(h)
        ]
    )
    fut = F.array(
        *[F.struct(*[F.col(f"y_t{t:03d}_{n}").cast("float").alias(n) for n in TARGETS]) for t in range(f)]
    )
    meta = [c for c in wide.columns if not STEP_COLUMN.match(c)]
    return wide.select(*meta, hist.alias("hist"), fut.alias("fut"))


STEP_COLUMN = re.compile(r"^([xy])_t(\d+)_(.+)$")


def shape_from_columns(columns: list[str]) -> tuple[int, int]:
    """History and future length of a wide table, from its column names."""
    last = {"x": -1, "y": -1}
    for c in columns:
        m = STEP_COLUMN.match(c)
        if m:
            last[m.group(1)] = max(last[m.group(1)], int(m.group(2)))
    if min(last.values()) < 0:
        raise ValueError("No x_t… / y_t… step columns")
    return last["x"] + 1, last["y"] + 1


def feature_columns(columns: list[str]) -> dict[str, str]:
    """Feature name -> name used in the columns, through the alias table."""
    present = {m.group(3) for m in map(STEP_COLUMN.match, columns) if m and m.group(1) == "x"} or set(columns)
    out = {}
    for name in FEATURES:
        if name in present:
            out[name] = name
        elif FEATURE_ALIASES.get(name) in present:
            out[name] = FEATURE_ALIASES[name]
    return out


def window_shape(windows: DataFrame) -> DataFrame:
    """Distinct window shapes found in the arrays, with how many windows have each."""
    return windows.groupBy(F.size("hist").alias("history_steps"), F.size("fut").alias("future_steps")).agg(
        F.count(F.lit(1)).alias("n_windows")
    )


def check_parameters(
    windows: DataFrame,
    history_steps: int = EXPECTED_HISTORY_STEPS,
    future_steps: int = EXPECTED_FUTURE_STEPS,
) -> DataFrame:
    """Per source, the range of window parameters and whether they differ from the task."""
    agg = windows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("history_steps").alias("min_history_steps"),
        F.max("history_steps").alias("max_history_steps"),
        F.min("future_steps").alias("min_future_steps"),
        F.max("future_steps").alias("max_future_steps"),
    )
    same = (
        (F.col("min_history_steps") == history_steps)
        & (F.col("max_history_steps") == history_steps)
        & (F.col("min_future_steps") == future_steps)
        & (F.col("max_future_steps") == future_steps)
    )
    return agg.withColumn("mismatch", ~same)


def select_hours(windows: DataFrame, history_hours: float, future_hours: float, step_minutes: float) -> DataFrame:
    """The newest `history_hours` of the history and the first `future_hours` of the future.

    Windows shorter than asked fail the job, as silent truncation would change results.
    """
    h, f = max(1, steps_for(history_hours, step_minutes)), max(1, steps_for(future_hours, step_minutes))
    short = (F.size("hist") < h) | (F.size("fut") < f)
    checked = F.when(short, F.raise_error(F.lit(f"a window holds fewer than {h}/{f} steps")).cast("int")).otherwise(
        F.lit(h)
    )
    return (
        windows.withColumn("_h", checked)
        .withColumn("hist", F.slice("hist", F.size("hist") - F.col("_h") + 1, F.col("_h")))
        .withColumn("fut", F.slice("fut", F.lit(1), F.lit(f)))
        .withColumn("history_steps", F.lit(h))
        .withColumn("future_steps", F.lit(f))
        .drop("_h")
    )


def horizon_step(hours: float, step_minutes: float, future_steps: int) -> int:
    """0-based step that ends `hours` ahead, clamped to the future."""
    return max(1, min(steps_for(hours, step_minutes), future_steps)) - 1


def anchor() -> Column:
    """Last history position as a struct of doubles."""
    last = F.element_at("hist", -1)
    return F.struct(last.lat.cast("double").alias("lat"), last.lon.cast("double").alias("lon"))


def as_points(arr) -> Column:
    """Array of (lat, lon) doubles from any array of position structs."""
    return F.transform(arr, lambda p: F.struct(p.lat.cast("double").alias("lat"), p.lon.cast("double").alias("lon")))


def _minus(a, b) -> Column:
    return F.struct((a.lat - b.lat).alias("lat"), (a.lon - b.lon).alias("lon"))


def anchor_offsets(points: Column, origin: Column) -> Column:
    return F.transform(points, lambda p: _minus(p, origin))


def step_deltas(points: Column, origin: Column) -> Column:
    """Displacement of each step from the one before; the first from the anchor."""
    return consecutive(F.concat(F.array(origin), points), lambda a, b: _minus(b, a))


def offsets_to_steps(offsets: Column) -> Column:
    return step_deltas(offsets, F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")))


def steps_to_offsets(deltas: Column) -> Column:
    lat = running_sum(F.transform(deltas, lambda p: p.lat))
    lon = running_sum(F.transform(deltas, lambda p: p.lon))
    return F.zip_with(lat, lon, lambda a, b: F.struct(a.alias("lat"), b.alias("lon")))


def to_absolute(deltas: Column, origin: Column, mode: str = "anchor_offset") -> Column:
    if mode not in ("anchor_offset", "step_delta"):
        raise ValueError(f"Unknown target mode {mode!r}")
    offsets = steps_to_offsets(deltas) if mode == "step_delta" else deltas
    return F.transform(
        offsets, lambda p: F.struct((p.lat + origin.lat).alias("lat"), (p.lon + origin.lon).alias("lon"))
    )


def displacement_at(points: Column, origin: Column, step: int) -> Column:
    """Offset from the anchor at a 0-based step (also the end of a chunk)."""
    return _minus(F.element_at(points, step + 1), origin)


def possible_windows(
    duration_hours: Column, history_hours: float, future_hours: float, resample_minutes: int
) -> Column:
    """Windows a trajectory of this length could give on a full grid."""
    slack = (duration_hours - F.lit(history_hours + future_hours)) / F.lit(resample_minutes / 60.0)
    return F.greatest(F.floor(slack + 1), F.lit(0)).cast("bigint")


def cap_per_trajectory(windows: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """Cap windows that already exist; builders should pass `cap` instead."""
    keyed = windows.withColumn("_h", seeded_hash(seed, "traj_id", F.unix_seconds(F.col("start_time").cast("timestamp")).cast("string")))
    w = Window.partitionBy("traj_id").orderBy("_h")
    return keyed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_h", "_r")
