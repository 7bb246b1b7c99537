"""Plans keep what they need at scale: no pairs without keys, filters and columns at the scan."""

import re

import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith("stream_") and n != "logistic_step"))
def test_no_join_without_keys(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["nearest_asof"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,click\)", plan) and "props" not in plan


def test_asof_shuffles_once(spark):
    plan = catalogue.QUERIES["nearest_asof"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # the distinct times of the right side, and the union by group
    assert len(re.findall(r"\bExchange\b", plan)) <= 3
