"""The forests of several labels, grown together, against one tree grown plainly."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import forest, gates as X

FEATURES = ["f0", "f1", "f2", "f3"]


def made(spark, n: int = 2000):
    v = [F.rand(seed=i).alias(f"f{i}") for i in range(3)]
    table = spark.range(n).select("id", *v, F.floor(F.rand(seed=9) * 3).cast("double").alias("f3"))
    return table.select(*FEATURES, (F.col("f2") * 3 + F.col("f3")).alias("w"), F.col("f1").alias("a"), (F.col("f0") - F.col("f1")).alias("b"))


def shares(found, label: str) -> list[float]:
    values = {(r["context"], r["feature"]): r["importance"] for r in found.collect()}
    return [values[label, f] for f in FEATURES]


def test_more_labels_take_no_more_passes(spark):
    table = made(spark)

    def jobs(labels):
        spark.sparkContext.setJobGroup(f"forest-{len(labels)}", "")
        X.forest_importance(table, FEATURES, labels, trees=5, depth=3)
        done = spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{len(labels)}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(done)

    assert jobs(["w", "a", "b"]) <= jobs(["w"])


def test_one_tree_equals_a_plain_one(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(forest, "materialize", lambda df, name: seen.setdefault(name, df.localCheckpoint()))
    got = shares(X.forest_importance(made(spark), FEATURES, ["w"], trees=1, depth=3, min_leaf=40), "w")
    rows = seen["forest"].toPandas()
    x, y = rows[FEATURES].to_numpy(), rows.w.to_numpy()
    times = forest.times_drawn(forest.row_draws(rows._row.to_numpy(), 42), 0).astype(float)
    cuts = forest.split_points(seen["forest"], FEATURES, ["w"])[0]
    assert list(cuts[3]) == [0.5, 1.5] and all(len(c) == 31 for c in cuts[:3])
    gains = np.zeros(4)

    def spread(on):
        mean = np.average(y[on], weights=times[on])
        return np.sum(times[on] * (y[on] - mean) ** 2)

    def grow(on, depth):
        best = (0.0, None, None, None)
        for f in range(4):
            for c in cuts[f]:
                left, right = on & (x[:, f] <= c), on & (x[:, f] > c)
                if min(times[left].sum(), times[right].sum()) >= 40:
                    gain = spread(on) - spread(left) - spread(right)
                    best = max(best, (gain, f, left, right), key=lambda b: b[0])
        gain, f, left, right = best
        if gain > 1e-9:
            gains[f] += gain
            if depth > 1:
                grow(left, depth - 1)
                grow(right, depth - 1)

    grow(times > 0, 3)
    assert got == pytest.approx(list(gains / gains.sum()), abs=1e-9)


def test_bags_draw_each_row_once_on_average():
    draws = forest.row_draws(np.arange(200_000), 42)
    for tree in (0, 1, 99):
        times = forest.times_drawn(draws, tree)
        assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    assert abs(np.corrcoef(forest.times_drawn(draws, 0), forest.times_drawn(draws, 1))[0, 1]) < 0.01


def test_levels_in_several_passes_give_the_same(spark, monkeypatch):
    table = made(spark).localCheckpoint()
    found = lambda: X.forest_importance(table, FEATURES, ["w", "a"], trees=6, depth=4)
    whole = shares(found(), "w") + shares(found(), "a")
    monkeypatch.setattr(forest, "COUNT_BYTES", 20_000)
    assert shares(found(), "w") + shares(found(), "a") == pytest.approx(whole, abs=1e-12)


def test_rows_without_a_feature_are_left_out_and_labels_needed(spark):
    table = made(spark)
    holes = table.unionByName(table.withColumns({"f1": F.lit(None).cast("double"), "w": F.lit(None).cast("double")}).limit(50))
    holes = holes.unionByName(table.withColumns({"f0": F.lit(float("nan")), "w": F.lit(1e9)}).limit(50))
    few = dict(trees=3, depth=3)
    near = shares(X.forest_importance(table, FEATURES, ["w"], **few), "w")
    assert shares(X.forest_importance(holes, FEATURES, ["w"], **few), "w") == pytest.approx(near, abs=0.15)
    with pytest.raises(Exception, match="must not be null"):
        X.forest_importance(table.withColumn("w", F.when(F.col("f0") > 0.5, F.col("w"))), FEATURES, ["w"], **few)


def test_a_constant_label_has_no_importances(spark):
    found = X.forest_importance(made(spark).withColumn("c", F.lit(7.3)), FEATURES, ["c"], trees=3, depth=3)
    assert shares(found, "c") == [0.0] * 4
