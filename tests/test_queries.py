"""Registered queries against their SQL on the smallest data set.

A cross-section runs by default; WAKELINE_ALL_QUERIES=1 runs every query.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import compare, database, fetch  # noqa: E402
from wakeline.catalog import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
DEFAULT = [
    "a01_trajectory_audit", "a07_frame_stats", "a09_coast_counts", "a09_coast_export", "b02_kinematic", "c09_deduplicate", "e01_final_position", "e14_spearman",
    "e16_best_possible", "f06_course_change", "g06_long_segments", "l04_inland_fraction", "m05_smart_motion_metrics",
    "m12_motion_buckets", "p01_split_by_trajectory", "p05_sample_maneuver_biased", "r04_interpolate_with_holes",
    "s02_header_danish", "s15_incremental_segments", "u01_vessel_type_lookup", "v07_spread_picks", "w01_windows_over_holes", "w02_cap_per_trajectory",
]
NAMES = sorted(queries()) if os.environ.get("WAKELINE_ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = queries()[name](spark, SF).toArrow().to_pandas(integer_object_nulls=True)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert compare(got, fetch(con, sql)) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    # fitted models have no SQL form; tests and the invariants of the fits check them
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"e15_forest_importance", "b06_horizon_regression"}
