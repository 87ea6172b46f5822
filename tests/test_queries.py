"""Registered queries: every statement plans, and a cross-section gives equal rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.01"
SAMPLE = (
    "day_rank", "merge_tiers", "merge_columns", "daily_metrics", "scan_tier", "records", "rank_value", "doy_bands", "history_theta", "year_shuffle_test",
    "tail_labels", "block_split", "bilinear_lookup", "error_summary", "empirical_band", "rung_coverage", "knn_name", "land_snap", "snap_plan", "apply_plan",
    "unique_names", "flag_humans", "hits_over_time", "stream_daily", "stream_sessions", "stream_tier_upsert",
)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_statement_plans(duck):
    for name, sql in contract.oracle_sql().items():
        assert duck.sql(f"EXPLAIN {sql}").fetchall(), name
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal(spark, duck, name):
    assert differences(name, spark, FOLDER, duck) == []
