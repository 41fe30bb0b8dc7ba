"""The 36 golden cases (56 expected keys) through the eval operator."""
import json
import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evals

CASES = os.path.join(os.path.dirname(__file__), "data", "eval_cases.json")


def case_rows(path=CASES):
    """Golden cases {tool: [{id, input, expected}]} -> one row per expected key."""
    with open(path) as f:
        data = json.load(f)
    return [(tool, c["id"], json.dumps(c["input"]), key, str(val).lower() if isinstance(val, bool) else str(val))
            for tool, cases in data.items() for c in cases for key, val in c["expected"].items()]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(case_rows(), "tool string, case_id string, input string, path string, expected string")


def test_all_golden_cases_pass(cases):
    res = evals.run_cases(cases)
    failed = res.filter(~F.col("passed")).select("case_id", "message").collect()
    assert failed == []
    assert res.count() == 56


def test_accuracy_rollup_and_gate(cases):
    acc = {r["tool"]: r for r in evals.accuracy(evals.run_cases(cases)).collect()}
    assert acc["TOTAL"]["cases"] == 36 and acc["TOTAL"]["accuracy"] == 1.0 and acc["TOTAL"]["gate_ok"]
    assert {t: acc[t]["cases"] for t in evals.TOOLS} == {
        "classify_call_type": 7, "classify_category": 9, "analyze_sentiment": 6, "extract_issues": 6,
        "route_escalation": 8}


def test_first_failure_and_unknown_tool(spark, cases):
    assert evals.first_failure(cases, "extract_issues").count() == 0
    broken = cases.withColumn("expected", F.when(F.col("case_id") == "ei_002", F.lit("p3")).otherwise(F.col("expected")))
    row = evals.first_failure(broken, "extract_issues").collect()
    assert row[0]["case_id"] == "ei_002"
    with pytest.raises(ValueError):
        evals.first_failure(cases, "no_such_tool")


def test_json_report(cases):
    rep = evals.report_json(evals.run_cases(cases)).collect()
    assert len(rep) == 1 and '"tool":"route_escalation"' in rep[0]["report"]
