"""Exact distributed ranks and percentiles, with hot values and small groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import ranking as K


def numbers(spark, n=5000, hot=0.35):
    """Values of which a third are equal and some repeat."""
    v = F.when(F.col("id") % 100 < int(hot * 100), F.lit(7.0)).otherwise(F.sin(F.col("id").cast("double")) * 50 + F.col("id") % 13)
    return spark.range(n).select(F.col("id"), v.alias("v"), (F.col("id") % 3).cast("string").alias("g"))


def test_percentiles_match_numpy(spark):
    df = numbers(spark)
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 0.995, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in K.exact_percentiles(df, ["v"], probs, ["g"]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part.v, p), abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 25])
def test_percentiles_of_tiny_groups(spark, n):
    df = spark.range(n).select((F.col("id") * 1.5).alias("v"))
    got = {r["p"]: r["value"] for r in K.exact_percentiles(df, ["v"], [0.25, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(np.arange(n) * 1.5, p))


def test_percentiles_of_signs_scales_null_groups_and_infinities(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 400), rng.normal(0, 1e-300, 90), rng.normal(0, 1e300, 90), np.zeros(60), [-0.0, 5e-324, -5e-324]])
    near = 1.0 + np.arange(300) * 2.0**-52  # neighbouring doubles
    rows = [(None, float(x)) for x in v] + [("near", float(x)) for x in near] + [("one", 3.25), ("one", None), ("one", float("nan"))]
    rows += [("ends", float("-inf")), ("ends", -1.0), ("ends", 2.0), ("ends", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 1 / 3, 0.999, 1.0]
    got = {(r["g"], r["p"]): (r["n"], r["value"]) for r in K.exact_percentiles(df, ["v"], probs, ["g"]).collect()}
    for g, x in ((None, v), ("near", near), ("one", np.array([3.25]))):
        for p in probs:
            assert got[(g, p)][0] == len(x)
            assert got[(g, p)][1] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=0)
    assert [got[("ends", p)][1] for p in (0.0, 1 / 3, 1.0)] == [float("-inf"), -1.0, float("inf")]


def test_percentiles_shuffle_counts_and_reach_the_driver_only_as_results(spark):
    df = numbers(spark)
    stored = K.materialize(df, "percentiles")
    plan = K.exact_percentiles(stored, ["v"], [0.5], ["g"], stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower().replace("percentiles", "")
    assert K.exact_percentiles(stored.limit(0), ["v"], [0.5], ["g"]).collect() == []


def test_ordered_rank_with_hot_ties(spark):
    df = numbers(spark)
    got = K.ordered_rank(df, "v", ["id"]).toPandas()
    assert sorted(got["rank"]) == list(range(1, len(got) + 1))
    ordered = got.sort_values("rank")
    assert (ordered.v.diff().dropna() >= 0).all()
    assert np.allclose(got.rank_avg, got.v.rank(method="average"))
    ties = ordered[ordered.v == 7.0]
    assert list(ties.id) == sorted(ties.id, key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())


def test_average_ranks_of_many_columns(spark):
    df = numbers(spark).select("id", "v", (F.col("id") % 7).alias("few"), F.lit(1).alias("same"), F.cos(F.col("id").cast("double")).alias("w"))
    stored = K.materialize(df, "average-ranks")
    pdf = df.toPandas().sort_values("id")
    got = K.average_ranks(stored, ["v", "few", "same", "w"], "id").toPandas().sort_values("id")
    for c in ("v", "few", "same", "w"):
        assert np.allclose(got[c].to_numpy(), pdf[c].rank(method="average").to_numpy())


def test_average_ranks_use_the_same_exchanges_for_any_number_of_columns(spark):
    df = numbers(spark)
    stored = K.materialize(df.select("id", *[(F.col("v") * k).alias(f"c{k}") for k in range(1, 7)]), "average-ranks")
    plans = [K.average_ranks(stored, [f"c{k}" for k in range(1, n + 1)], "id")._jdf.queryExecution().executedPlan().toString() for n in (1, 6)]
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning")


def test_hash_rank_and_cut(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2 == 0).alias("even"))
    order = sorted((str(i) for i in range(3000)), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    ranked = {r["k"]: r["rank"] for r in K.hash_rank(df, ["k"], 42).collect()}
    assert [ranked[k] for k in order] == list(range(1, 3001))
    by = K.hash_rank(df, ["k"], 42, ["even"]).groupBy("even").agg(F.max("rank").alias("m")).collect()
    assert {r["m"] for r in by} == {1500}
    hashes = df.select(K.seeded_hash(42, "k").alias("_h"))
    for k, want in ((0, 0), (1, 1), (17, 17), (3000, 3000), (9999, 3000)):
        assert df.filter(K.seeded_hash(42, "k") <= K.hash_cut(hashes, k)).count() == want
    kept = {r["k"] for r in df.filter(K.seeded_hash(42, "k") <= K.hash_cut(hashes, 5)).collect()}
    assert kept == set(order[:5])
