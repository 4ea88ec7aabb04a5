"""Group splits, exact seeded samples and feature scaling.

Choices follow seeded hash order (functions.ranking): rows are kept by comparing
their hash with a cut, so exact counts need no shuffle of the rows themselves.
Samplers first write the keys and flags they rank, and rank those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.constants import FEATURES
from wakeline.functions.ranking import hash_cut, ordered_rank, seeded_hash
from wakeline.operators.motion import maneuver_score, motion_buckets
from wakeline.sources.scratch import materialize


def split_groups(
    windows: DataFrame,
    *,
    by: str = "traj_id",
    test_fraction: float = 0.2,
    val_fraction: float = 0.1,
    seed: int = 42,
    always_val: bool = False,
) -> DataFrame:
    """Adds `split`: whole groups go to test, val or train in exact numbers.

    n_test = max(1, int(n f)); n_val likewise, or 0 when its fraction is 0
    (`always_val` keeps at least one, as when coasts are combined).
    """
    ids = materialize(windows.select(by).distinct().select(seeded_hash(seed, by).alias("_h")), "split")
    n = ids.agg(F.count(F.lit(1))).scalar()
    part = lambda f: F.greatest(F.lit(1), F.floor(n * F.lit(float(f))))
    n_test = part(test_fraction)
    n_val = part(val_fraction) if (val_fraction > 0 or always_val) else F.lit(0)
    test_cut, val_cut = hash_cut(ids, n_test), hash_cut(ids, n_test + n_val)
    h = seeded_hash(seed, by)
    return windows.withColumn(
        "split",
        F.when(h <= test_cut, F.lit("test")).when(h <= val_cut, F.lit("val")).otherwise(F.lit("train")),
    )


def sample_exact(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer) in seeded hash order; keys identify a row."""
    hashes = materialize(df.select(seeded_hash(seed, *keys).alias("_h")), "sample")
    return df.filter(seeded_hash(seed, *keys) <= hash_cut(hashes, n))


def sample_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The fast approximate form: one pass, no ranking; rows whose hash, as a number from 0 to 1, is below the fraction."""
    number = F.conv(F.substring(seeded_hash(seed, *keys), 1, 12), 16, 10).cast("double")
    return df.filter(number < F.lit(float(fraction) * 16.0**12))


def sample_blocks(df: DataFrame, block: str, n: int, seed: int = 42) -> DataFrame:
    """Whole blocks of rows, in just the number expected to cover n rows."""
    per_block = materialize(
        df.groupBy(block).agg(F.count(F.lit(1)).alias("c")).select(seeded_hash(seed, block).alias("_h"), "c"), "blocks"
    )
    totals = per_block.agg(F.count(F.lit(1)).alias("blocks"), F.sum("c").alias("rows"))
    wanted = F.ceil(F.col("blocks") * F.least(F.lit(1.0), F.lit(n) / F.col("rows")))
    k = totals.select(F.greatest(F.lit(1), F.least(F.col("blocks"), wanted))).scalar()
    return df.filter(seeded_hash(seed, block) <= hash_cut(per_block.select("_h"), k))


def _top_up(keyed: DataFrame, chosen: Column, n: int) -> Column:
    """Chosen rows, plus the first others in hash order until there are n."""
    have = keyed.agg(F.coalesce(F.sum(chosen.cast("int")), F.lit(0))).scalar()
    rest = hash_cut(keyed.filter(~chosen).select("_h"), F.lit(n) - have)
    return chosen | (F.col("_h") <= rest)


def _finish(windows: DataFrame, keyed: DataFrame, pick: Column, keys: Sequence[str]) -> DataFrame:
    picked = keyed.filter(pick).select(*keys)
    return windows.join(picked, list(keys), "left_semi")


def sample_maneuver_biased(
    windows: DataFrame,
    n: int,
    *,
    maneuver_fraction: float = 0.3,
    seed: int = 42,
    keys: Sequence[str] = ("traj_id", "start_time"),
) -> DataFrame:
    """A share of the sample from the windows with the largest maneuver score.

    The pool holds four times that share; the rest of the sample comes from below
    the pool, and any shortfall from what is left. Exactly min(n, rows) rows.
    """
    n_maneuver = int(round(n * maneuver_fraction))
    pool_size = max(4 * n_maneuver, n_maneuver)
    scored = windows.select(*keys, (-maneuver_score()).alias("_neg"))
    ranked = ordered_rank(scored, "_neg", list(keys), seed, "_pos")
    keyed = materialize(
        ranked.select(*keys, seeded_hash(seed, *keys).alias("_h"), (F.col("_pos") <= pool_size).alias("_pool")),
        "maneuver",
    )
    pool = F.col("_pool")
    cut_pool = hash_cut(keyed.filter(pool).select("_h"), n_maneuver)
    cut_rest = hash_cut(keyed.filter(~pool).select("_h"), n - n_maneuver)
    chosen = (pool & (F.col("_h") <= cut_pool)) | (~pool & (F.col("_h") <= cut_rest))
    return _finish(windows, keyed, _top_up(keyed, chosen, n), keys)


def sample_motion_stratified(
    windows: DataFrame,
    n: int,
    *,
    straight_fraction: float = 0.15,
    other_fraction: float = 0.15,
    seed: int = 42,
    keys: Sequence[str] = ("traj_id", "start_time"),
) -> DataFrame:
    """Quotas for straight and other windows, the remainder uniform.

    A bucket smaller than its quota gives all its rows (drawing with replacement
    and then keeping distinct rows cannot give more). Empty buckets leave a
    uniform sample.
    """
    flags = motion_buckets(windows).select(*keys, seeded_hash(seed, *keys).alias("_h"), "straight", "other")
    keyed = materialize(flags, "strata")
    quota = lambda f: int(round(n * f))
    cut = lambda name, f: hash_cut(keyed.filter(F.col(name)).select("_h"), quota(f))
    chosen = (F.col("straight") & (F.col("_h") <= cut("straight", straight_fraction))) | (
        F.col("other") & (F.col("_h") <= cut("other", other_fraction))
    )
    return _finish(windows, keyed, _top_up(keyed, chosen, n), keys)


def split_then_sample(windows: DataFrame, n_train: int | None, *, mode: str = "uniform", seed: int = 42, **split_args) -> DataFrame:
    """Split by group, then sample the training part only."""
    labelled = split_groups(windows, seed=seed, **split_args)
    train = labelled.filter("split = 'train'")
    if n_train:
        pick = {
            "uniform": lambda: sample_exact(train, n_train, ("traj_id", "start_time"), seed),
            "maneuver": lambda: sample_maneuver_biased(train, n_train, seed=seed),
            "stratified": lambda: sample_motion_stratified(train, n_train, seed=seed),
        }
        train = pick[mode]()
    return train.unionByName(labelled.filter("split <> 'train'"))


def audit_draw(flagged: DataFrame, flag: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Half of the draw from rows where `flag` is true (the odd one too), half where it is false."""
    keyed = materialize(flagged.select(seeded_hash(seed, *keys).alias("_h"), flag), "audit")
    cut = lambda cond, k: hash_cut(keyed.filter(cond).select("_h"), k)
    h = seeded_hash(seed, *keys)
    return flagged.filter(
        (F.col(flag) & (h <= cut(F.col(flag), n // 2 + n % 2))) | (~F.col(flag) & (h <= cut(~F.col(flag), n // 2)))
    )


def fit_scaler(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and population deviation of each feature over all steps of the training windows."""
    steps = train.select(F.explode("hist").alias("s"))
    aggs = []
    for f in features:
        value = F.col(f"s.{f}").cast("double")
        aggs += [F.avg(value).alias(f"mean_{f}"), F.stddev_pop(value).alias(f"scale_{f}")]
    return steps.agg(*aggs)


def apply_scaler(windows: DataFrame, scaler: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Standardised history; a feature without spread keeps scale 1. The scaler is one row."""
    keyed = windows.withColumn("_k", F.lit(1)).join(F.broadcast(scaler.withColumn("_k", F.lit(1))), "_k")

    def scaled(step):
        out = []
        for f in features:
            scale = F.when(F.col(f"scale_{f}") == 0, F.lit(1.0)).otherwise(F.col(f"scale_{f}"))
            out.append(((step[f].cast("double") - F.col(f"mean_{f}")) / scale).cast("float").alias(f))
        return F.struct(*out)

    return keyed.withColumn("hist", F.transform("hist", scaled)).select(*windows.columns)


def stored_scaler(spark, means: dict[str, float], scales: dict[str, float]) -> DataFrame:
    """A scaler row from saved values."""
    row = {f"mean_{k}": float(v) for k, v in means.items()} | {f"scale_{k}": float(v) for k, v in scales.items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])


def draw_report(sample: DataFrame, percentiles) -> DataFrame:
    """Size, score median and p90, and bucket counts of a training draw, as one row."""
    scored = motion_buckets(sample.withColumn("maneuver_score", maneuver_score()))
    slim = materialize(scored.select("maneuver_score", "straight", "maneuver", "anchored", "other"), "draw")
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"n_{c}")
    counts = slim.agg(
        F.count(F.lit(1)).alias("sample_size"), *[count(c) for c in ("straight", "maneuver", "anchored", "other")]
    )
    q = percentiles(slim, ["maneuver_score"], {"median": 0.5, "p90": 0.9}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(counts).join(F.broadcast(one(q)), "_k").drop("_k")
