"""Regression evaluation of the per-meeting tools against golden cases.

Cases are a DataFrame ``(tool, case_id, input JSON, path, expected)``, one row per
expected key.  Inputs are parsed with ``from_json`` and fed to the same Column
functions the pipeline uses; actual values are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import classify, issues, routing, sentiment
from colloquy.rules import DEFAULT_RULES, EVAL_PASS_THRESHOLD, RuleSet

TOOLS = ["classify_call_type", "classify_category", "analyze_sentiment", "extract_issues", "route_escalation"]
INPUT_SCHEMA = ("title string, topics array<string>, call_type string, upstream_score double, upstream_label string, "
                "summary_text string, key_moments_json string, category string, severity string, "
                "sentiment_score double, is_anomaly string")
MOMENTS = "array<struct<text:string,type:string>>"


def _actual(rules: RuleSet) -> Column:
    i = F.col("_in")
    ct = classify.call_type(i["title"], rules)
    topic = classify.topic_categories(i["topics"], rules)["primary"]
    s = sentiment.sentiment_columns(i["call_type"], i["upstream_score"], rules)
    moments = F.coalesce(F.from_json(i["key_moments_json"], MOMENTS), F.array().cast(MOMENTS))
    iss = issues.extract_issues(F.coalesce(i["summary_text"], F.lit("")), moments, rules)
    r = routing.route(i["category"], i["severity"], i["sentiment_score"], routing.as_bool(i["is_anomaly"]), rules)
    tool, path = F.col("tool"), F.col("path")
    cases = [
        ("classify_call_type", "call_type", ct),
        ("classify_category", "primary_category", topic),
        ("analyze_sentiment", "is_anomaly", s["is_anomaly"].cast("string")),
        ("analyze_sentiment", "label", i["upstream_label"]),
        ("extract_issues", "n_issues", F.size(iss).cast("string")),
        ("extract_issues", "issues[0].severity", F.get(iss, 0)["severity"]),
        ("route_escalation", "team", r["team"]),
        ("route_escalation", "pagerduty", r["pagerduty"].cast("string")),
        ("route_escalation", "requires_escalation", r["requires_escalation"].cast("string")),
    ]
    out = None
    for t, p, v in cases:
        cond = (tool == t) & (path == p)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def run_cases(cases: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """E-01: one row per expected key with actual value, pass flag and message."""
    unknown = cases.filter(~F.col("tool").isin(*TOOLS)).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown tool {unknown[0]['tool']!r}")
    df = cases.withColumn("_in", F.from_json("input", INPUT_SCHEMA)).withColumn("actual", _actual(rules))
    passed = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    return df.drop("_in").withColumn("passed", passed).withColumn(
        "message", F.when(~passed, F.concat(F.col("path"), F.lit(": expected "), F.col("expected"),
                                            F.lit(", got "), F.coalesce("actual", F.lit("null")))))


def accuracy(results: DataFrame, threshold: float = EVAL_PASS_THRESHOLD) -> DataFrame:
    """A-26: per tool and total (ROLLUP); a case passes when all its keys pass."""
    per_case = results.groupBy("tool", "case_id").agg(F.bool_and("passed").alias("passed"))
    acc = per_case.rollup("tool").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))
    return acc.select(F.coalesce("tool", F.lit("TOTAL")).alias("tool"), "cases", "passed",
                      (F.col("passed") / F.col("cases")).alias("accuracy"),
                      (F.col("passed") / F.col("cases") >= threshold).alias("gate_ok"))


def first_failure(cases: DataFrame, tool: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """E-02: run one tool's cases; the first failing key by case id (empty when all pass)."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    r = run_cases(cases.filter(F.col("tool") == tool), rules)
    return r.filter(~F.col("passed")).orderBy("case_id", "path").limit(1)


def report_json(results: DataFrame) -> DataFrame:
    """S-17: one JSON report row: per tool its counts, accuracy and cases (the golden set is
    small; grouping per tool first keeps it one aggregation pipeline, no join)."""
    per_tool = results.groupBy("tool").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"),
        F.sort_array(F.collect_list(F.struct("case_id", "path", "expected", "actual", "passed"))).alias("cases"))
    per_tool = per_tool.withColumn("accuracy", F.col("passed") / F.col("checks"))
    return per_tool.agg(F.sort_array(F.collect_list(F.struct("tool", "checks", "passed", "accuracy", "cases"))).alias("summary")) \
        .select(F.to_json(F.struct("summary")).alias("report"))
