"""Scale properties of every registered query's physical plan."""

import re

import pytest

from growthlens.plans.registry import all_queries
from tests.conftest import SMALL

QUERIES = all_queries()
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
             "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas", "MapInPandas")
# window bounds that must reach the parquet scan
PUSHED = {
    "user_lifecycle": r"GreaterThanOrEqual\(ts,",
    "item_funnel_window": r"GreaterThanOrEqual\(ts,",
    "taoke_metrics": r"GreaterThanOrEqual\(o_orderdate,",
    "merchant_metrics": r"GreaterThanOrEqual\(o_orderdate,",
    "alert_refund_spike": r"GreaterThanOrEqual\(o_orderdate,",
    "item_candidates": r"StringContains\(p_name,",
}


def _plan(spark, name):
    return QUERIES[name].build(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udfs_or_cross_joins(spark, name):
    plan = _plan(spark, name)
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_window_filters_reach_the_scan(spark, name):
    plan = _plan(spark, name)
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*?(?:\]|\.\.\.)", plan))
    assert re.search(PUSHED[name], pushed), pushed


def test_dashboard_builds_its_parts_on_written_rollups(spark):
    assert "FileScan" not in _plan(spark, "merchant_dashboard")


def test_repurchase_and_overview_neither_join_nor_expand(spark):
    assert "Join" not in _plan(spark, "repurchase_7d")
    assert "Expand" not in _plan(spark, "behavior_overview")
