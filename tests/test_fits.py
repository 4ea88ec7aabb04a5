"""Fitted models against a plain solution of the same problem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wakeline.catalog import registry
from wakeline.constants import FEATURES
from wakeline.operators import gates as X
from wakeline.operators.windows import window_id
from wakeline.plans import adapter as A

SF = "/root/testdata/sf0.001"


def test_regression_equals_least_squares(spark):
    got = registry.QUERIES["b06_horizon_regression"](spark, SF).toPandas().set_index("window_id").sort_index()
    windows = A.stored_windows(spark, SF)
    flat = F.flatten(F.transform("hist", lambda s: F.array(*[s[f].cast("double") for f in FEATURES])))
    last, at = F.element_at("hist", -1), F.element_at("fut", A.N)
    rows = windows.select(
        window_id().alias("window_id"), flat.alias("x"), last["lat"].alias("a"), last["lon"].alias("o"), at["lat"].alias("lat"), at["lon"].alias("lon")
    ).toPandas().set_index("window_id").sort_index()
    assert list(rows.index) == list(got.index)
    train = got.is_train.to_numpy() == 1
    assert train.any() and (~train).any()
    x = np.stack(rows.x)
    spread = x[train].std(axis=0)
    x = np.column_stack([(x - x[train].mean(axis=0)) / np.where(spread > 0, spread, 1), np.ones(len(x))])
    for target, base in (("lat", "a"), ("lon", "o")):
        y = (rows[target] - rows[base]).to_numpy()
        fit = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        # columns depend on each other, so fits may differ, but not in how well they do on their training rows
        rms = lambda pred: np.sqrt(np.mean((y[train] - pred[train]) ** 2))
        best, found = rms(x @ fit), rms(got[f"pred_{target}"].to_numpy() - rows[base].to_numpy())
        assert found <= best * 1.05 + 1e-3
    assert got.error_km.min() >= 0


def test_forest_names_the_feature_that_drives(spark):
    v = [F.rand(seed=i).alias(f"f{i}") for i in range(4)]
    table = spark.range(2000).select(*v).withColumn("w", F.col("f2") * 3 + F.col("f0") * 0.2)
    found = {r["feature"]: r["importance"] for r in X.forest_importance(table, ["f0", "f1", "f2", "f3"], ["w"]).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9
    assert found["f2"] > 0.8 and found["f2"] > found["f0"] > max(found["f1"], found["f3"])
