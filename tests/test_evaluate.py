"""Metric definitions on small forecasts, run tables and picks."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import evaluate as E, gates as X, routes as V
from wakeline.sources import reports

TRACKS = "model string, window_id string, anchor struct<lat: double, lon: double>, true_track array<struct<lat: double, lon: double>>, pred_track array<struct<lat: double, lon: double>>"
KM = 1 / 111.19492664455873


def forecasts(spark, rows):
    return spark.createDataFrame(rows, TRACKS)


def test_exact_forecast(spark):
    t = [(1.0, 2.0), (1.5, 2.5)]
    f = forecasts(spark, [("m", "a", (0.5, 1.5), t, t), ("m", "b", (0.5, 1.5), [(2.0, 2.0), (3.0, 3.5)], [(2.0, 2.0), (3.0, 3.5)])])
    r = E.final_position_metrics(E.with_errors(f)).first()
    assert r["r2_lat"] == r["r2_lon"] == 1.0 and r["median_error_km"] == r["p95_error_km"] == r["rmse_lat"] == 0.0


def test_floor_and_path_conventions(spark):
    # One km north per step from the anchor; the forecast is 1 km too far everywhere.
    t = [(k * KM, 0.0) for k in (1, 2, 3)]
    p = [(k * KM, 0.0) for k in (2, 3, 4)]
    r = E.with_errors(forecasts(spark, [("m", "a", (0.0, 0.0), t, p)])).first()
    assert r["fde_km"] == pytest.approx(1.0) and r["ade_km"] == pytest.approx(1.0)
    assert r["displacement_km"] == 10.0 and r["true_path_km"] == 10.0
    assert r["nfde"] == pytest.approx(0.1) and r["nade"] == pytest.approx(0.1)
    raw = E.with_errors(forecasts(spark, [("m", "a", (0.0, 0.0), t, p)]), floor_km=0.0).first()
    assert raw["true_path_km"] == pytest.approx(2.0)  # the leg from the anchor is not part of it


def test_two_medians_of_step_errors_differ(spark):
    def row(i, errs):
        return ("m", str(i), (0.0, 0.0), [(0.0, 0.0)] * len(errs), [(e * KM, 0.0) for e in errs])

    data = [[0, 0, 9], [1, 1, 1], [2, 8, 8]]
    r = E.trajectory_metrics(E.with_errors(forecasts(spark, [row(i, e) for i, e in enumerate(data)]))).first()
    assert r["median_step_error_km"] == pytest.approx(np.median(data))
    assert r["median_window_ade_km"] == pytest.approx(np.median(np.mean(data, axis=1)))
    assert r["mean_ade_km"] == pytest.approx(np.mean(data)) and r["final_step_mean_error_km"] == pytest.approx(6.0)


def test_long_form_round_trip(spark):
    f = forecasts(spark, [("m", "a", (0.0, 0.0), [(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.0)])])
    assert E.from_predictions(E.to_predictions(f)).select(f.columns).collect() == f.collect()


def test_change_is_null_for_zero_base(spark):
    m = spark.createDataFrame([("a", 0.0, 2.0), ("b", 5.0, 3.0)], "model string, x double, y double")
    r = {x["metric"]: x["change_pct"] for x in E.percent_change(m, "a", "b", ["x", "y"]).collect()}
    assert r == {"x": None, "y": 50.0}


def test_rank_ties(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "model string, median_error_km double")
    assert {r["model"]: r["rank"] for r in E.rank_models(m).collect()} == {"a": 1, "b": 1, "c": 3}
    assert E.best_of(m).first()["model"] == "a"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (20.0,), (20.1,), (float("nan"),)], "v double")
    assert {r["bin"]: r["n"] for r in E.histogram(df, "v", 0.0, 20.0, 2).collect()} == {0: 2, 1: 2}


def test_metric_kinds(spark):
    names = {
        "Naive baseline (12.0 h)": "naive",
        "Kinematic baseline": "kinematic",
        "LSTM position (12.0 h ahead)": "model",
        "LSTM full predicted trajectory": "full",
        "LSTM position (12.0 h ahead) [straight, n=12]": "straight",
        "something else": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", E.metric_kind(F.col("n")).alias("k")).collect()} == names


def test_run_files(spark, tmp_path):
    doc = {"samples_train": 100, "training": {"best_val_loss": 0.5, "epochs_ran": 3}, "metrics": [{"model": "Naive baseline", "mean_error_km": 3.0, "median_error_km": 2.0}],
           "history": [{"epoch": e, "val_loss": v, "epoch_sec": 2.0} for e, v in enumerate((0.9, 0.5, 0.5))]}
    (tmp_path / "run_a").mkdir()
    (tmp_path / "run_a" / "metrics.json").write_text(json.dumps(doc, indent=1))
    runs = reports.read_run_metrics(spark, str(tmp_path / "*"))
    table = {r["run"]: r for r in E.compare_runs(runs, ["run_a", "run_b"], ["naive"]).collect()}
    assert table["run_a"]["best_epoch"] == 1 and table["run_a"]["naive_fde_km_median"] == 2.0 and not table["run_a"]["missing"]
    assert table["run_b"]["missing"]
    assert E.compute_costs(runs).first()["samples_per_sec"] == 50.0
    steps = [r["train_steps"] for r in E.training_history(runs, 72, curriculum=True).orderBy("epoch").collect()]
    assert steps == [36, 72, 72]


def test_sample_and_gate_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"y_true": [[[1, 2], [3, 4]]], "y_pred": [[[5, 6], [7, 8]]], "anchor": [[0, 1]]}, indent=1))
    rows = reports.read_forecast_samples(spark, str(tmp_path / "s.json"), "lstm").orderBy("step").collect()
    assert [(r["model"], r["true_lat"], r["pred_lon"], r["anchor_lon"]) for r in rows] == [("lstm", 1.0, 6.0, 1.0), ("lstm", 3.0, 8.0, 1.0)]
    (tmp_path / "g.json").write_text(json.dumps({"context_hours": [9, 12], "per_sample": [[0.25, 0.75], [0.5, 0.5]], "per_sample_vessel_class": [3, 0]}))
    w = reports.read_gate_weights(spark, str(tmp_path / "g.json")).orderBy("window_id").collect()
    assert [(r["window_id"], r["alpha"], r["vessel_class"]) for r in w] == [(0, [0.25, 0.75], 3), (1, [0.5, 0.5], 0)]


def test_gate_math(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([1.0, 0.0, 0.0],)], "alpha array<double>")
    rows = df.select(X.argmax(F.col("alpha")).alias("i"), X.entropy(F.col("alpha")).alias("h"), X.softmax(F.col("alpha")).alias("s")).collect()
    assert [r["i"] for r in rows] == [1, 0]
    assert rows[0]["h"] == pytest.approx(-sum(a * math.log(a + 1e-8) for a in (0.2, 0.5, 0.3)))
    assert sum(rows[0]["s"]) == pytest.approx(1.0)


def test_error_band_fallback(spark):
    rows = [(f"w{i:03d}", 1.0 + i / 100, 50.0 + i, 60.0) for i in range(90)]
    picks = V.picks_by_error_band(spark.createDataFrame(rows, "window_id string, err_km double, net_km double, path_km double")).collect()
    by = {}
    for r in picks:
        by.setdefault(r["band"], set()).add(r["window_id"])
    assert by == {"low": {"w088", "w089"}, "medium": {"w058", "w059"}, "high": {"w088", "w089"}}


def test_spread_picks_relaxes(spark):
    rows = [(f"w{i}", 3.0 + i, 6.0 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "window_id string, net_km double, path_km double")
    assert sorted(r["window_id"] for r in V.spread_picks(df, 4, 100.0, 100.0).collect()) == ["w2", "w4", "w7", "w9"]


def test_shape_picks_use_each_window_once(spark):
    rows = [(f"w{i:02d}", float(i * 4), 50.0 + i, 0.5 if i % 2 else 0.95, 30.0 if i % 2 else 1.0, 100.0 if i % 2 else 1.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "window_id string, err_km double, net_km double, directness double, cross_track_km double, turn_deg double, maneuver_score double")
    picks = V.picks_by_shape(df, 15).collect()
    assert len(picks) == 15 and len({r["window_id"] for r in picks}) == 15
