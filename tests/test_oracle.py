"""Each registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

PATH = "/root/testdata/sf0.001"
# Built from many jobs; the driver compares them at a larger size.
SLOW = {"feature_frame_pre_weekend", "feature_frame_post_practice", "leakage_audit", "leakage_found"}
SQL = entry.oracle_sql()
NAMES = sorted(n for n in SQL if os.environ.get("CUTLINE_ALL") or n not in SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, PATH), con, SQL[name]) == []


# With a limit of a few dozen rows nearly every key counts as large.
SPLIT = ["trailing_form", "trailing_group_form", "season_to_date", "venue_history", "cumulative_rank_lag", "running_number",
         "exact_median_by_venue", "position_prior", "class_history", "tie_fair_topk", "dense_cumulative", "surrogate_keys"]


@pytest.mark.parametrize("name", SPLIT)
def test_query_equals_sql_when_keys_are_split(spark, con, name):
    spark.conf.set("spark.cutline.spanRows", "40")
    try:
        assert compare(entry.queries()[name](spark, PATH), con, SQL[name]) == []
    finally:
        spark.conf.unset("spark.cutline.spanRows")


def test_entry_points_agree():
    assert set(SQL) <= set(entry.queries())
