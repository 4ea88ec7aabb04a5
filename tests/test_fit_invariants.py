"""The checks of the regression fit against plain sums, and what they write."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.catalog import modelling, registry
from wakeline.constants import FEATURES
from wakeline.plans import adapter as A
from wakeline.sources.scratch import shared_dir


def size(path: Path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_invariants_equal_plain_sums(spark):
    v = lambda name, k: (F.rand(seed=7 * FEATURES.index(name) + k) * 10 - 3).cast("float").alias(name)
    table = spark.range(300).select(
        (F.col("id") % 5 != 4).alias("is_train"),
        F.array(*[F.struct(*[v(f, k) for f in FEATURES]) for k in range(3)]).alias("hist"),
        *[(F.rand(seed=s) * 4).alias(c) for s, c in enumerate(("true_lat", "true_lon", "pred_lat", "pred_lon"), 900)],
    ).localCheckpoint()
    got = {r["target"]: r for r in modelling._fit_invariants(table).collect()}
    rows = table.toPandas()
    train = rows.is_train.to_numpy()
    x = np.array([[float(s[f]) for s in h for f in FEATURES] for h in rows["hist"]])[train]
    for t in ("lat", "lon"):
        r = (rows[f"true_{t}"] - rows[f"pred_{t}"]).to_numpy()[train]
        moments = np.abs((x * r[:, None]).mean(axis=0)) / (1 + np.abs(x).mean(axis=0))
        assert (got[t]["n_train"], got[t]["n_rest"]) == (240, 60)
        assert got[t]["train_mean_residual"] == pytest.approx(abs(r.mean()), abs=1e-5)
        assert got[t]["largest_moment"] == pytest.approx(moments.max(), abs=0.0051) and moments.max() > 0.02


def test_invariants_write_less_than_the_windows_alone_took(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 40) * 9000 + F.col("id") % 40)
    spark.range(12_000).select(
        F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("view").alias("event_type"),
        (F.rand(seed=5) * 90).alias("value"),
    ).coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    scratch = Path(shared_dir(spark).removeprefix("file://"))
    before = set(scratch.glob("wakeline-*"))
    found = registry.QUERIES["b06_regression_invariants"](spark, f"{tmp_path}/sf").collect()
    written = {p.name.split("-")[1]: size(p) for p in set(scratch.glob("wakeline-*")) - before}
    windows = A.stored_windows(spark, f"{tmp_path}/sf")
    windows.write.parquet(f"{tmp_path}/plain")
    assert {r["n_train"] + r["n_rest"] for r in found} == {windows.count()}
    assert windows.count() > 3000
    assert set(written) == {"segments", "windows", "regression"}
    assert written["windows"] < size(tmp_path / "plain") / 2
    assert written["regression"] < size(tmp_path / "plain") * 1.2
