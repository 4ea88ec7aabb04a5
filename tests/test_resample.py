"""The gap-expansion fill against pandas on random tracks, and hand-made gaps."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from wakeline.constants import FEATURES
from wakeline.operators import resample as R

T0 = dt.datetime(2024, 1, 1)


def track(spark, offsets, types=None, traj="1_1"):
    rnd = random.Random(len(offsets))
    rows = [
        (T0 + dt.timedelta(seconds=s), 1, traj, types[i] if types else "70", *[float(rnd.random()) for _ in FEATURES])
        for i, s in enumerate(offsets)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, mmsi long, traj_id string, vessel_type string, " + ", ".join(f"{f} double" for f in FEATURES))


def with_pandas(df, minutes, limit):
    pdf = df.toPandas().sort_values("timestamp").drop_duplicates("timestamp").set_index("timestamp")
    num = pdf[list(FEATURES)].resample(f"{minutes}min").mean().interpolate(method="time", limit_direction="both", limit=limit)
    meta = pdf[["vessel_type"]].resample(f"{minutes}min").ffill().bfill()
    return pd.concat([meta, num], axis=1).dropna(subset=["lat", "lon"])


@pytest.mark.parametrize("seed,limit", [(1, 6), (2, 2), (3, 1), (4, 6)])
def test_against_pandas(spark, seed, limit):
    rnd = random.Random(seed)
    offsets, t = [], rnd.randrange(0, 600)
    for _ in range(60):
        t += rnd.choice([30, 300, 600, 1800, 4 * 3600])
        offsets.append(t)
    df = track(spark, offsets, [rnd.choice(["70", "80", "31"]) for _ in offsets])
    got = R.resample(df, 10, limit).toPandas().sort_values("timestamp").reset_index(drop=True)
    want = with_pandas(df, 10, limit).reset_index()
    assert list(got.timestamp) == list(want.timestamp)
    assert list(got.vessel_type) == list(want.vessel_type)
    np.testing.assert_allclose(got[list(FEATURES)], want[list(FEATURES)], rtol=1e-9)


@pytest.mark.parametrize("empty,rows", [(11, 13), (12, 14), (13, 14), (20, 14)])
def test_limit_counts_from_each_side(spark, empty, rows):
    df = track(spark, [0, 600 * (empty + 1)])
    assert R.resample(df, 10).count() == rows


def test_mean_in_bin_and_dedupe(spark):
    df = track(spark, [0, 60, 540])
    one = R.resample(df, 10).collect()
    assert len(one) == 1
    again = df.unionByName(df)
    assert R.dedupe_timestamps(again).count() == 3
    assert R.resample(again, 10, dedupe=True).first()["lat"] == pytest.approx(one[0]["lat"])


def test_step_must_divide_a_day(spark):
    with pytest.raises(ValueError):
        R.resample(track(spark, [0]), 7)
