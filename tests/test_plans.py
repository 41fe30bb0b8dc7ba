"""Plan lint over every registered query: no cartesian products or nested-loop joins, no
Python UDF nodes, and bounded top-N-per-group plans."""
import pytest

from colloquy.plans import load_all
from tests.conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF_SMALL)) for name, (fn, _sql) in load_all().items()}


def test_no_cross_joins_or_python_udfs(plans):
    bad = {name: [f for f in FORBIDDEN if f in p] for name, p in plans.items()}
    assert {k: v for k, v in bad.items() if v} == {}


def test_top_n_per_group_is_bounded(plans):
    for name in ("w01_samples_per_call_type", "w01b_samples_per_category"):
        assert "WindowGroupLimit" in plans[name], name


def test_reports_prune_columns(spark):
    from colloquy.operators.records import enriched
    p = plan_of(enriched(spark, SF_SMALL).groupBy("call_type").count())
    scan = [line for line in p.split("\n") if "FileScan parquet" in line][0]
    assert "call_type" in scan and "issues" not in scan and "summary" not in scan
