"""Per-meeting operators (classification, scoring, issues, routing, accounts, flags)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import flags as flags_mod
from colloquy.operators.records import enriched
from colloquy.plans import register
from colloquy.plans.sqlgen import with_enriched


def avg_h(sum_h, n):
    """Mean of hundredths -> value rounded half-up to 2 decimals (exact in both engines)."""
    return F.floor(F.try_divide(sum_h, n) + F.lit(0.5)) / F.lit(100)


# --- A-11 / flagship: sentiment vs baseline per call type ------------------------------------
def sentiment_vs_baseline(spark, sf):
    e = enriched(spark, sf)
    valid = F.col("score_h") > 0
    g = e.groupBy("call_type").agg(
        F.count(F.when(valid, 1)).alias("n"),
        F.sum(F.when(valid, F.col("score_h"))).alias("sum_h"),
        F.max(F.col("baseline")).alias("baseline"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"))
    base_h = F.round(F.col("baseline") * 100)
    return g.select(
        "call_type", "n", "baseline",
        avg_h(F.col("sum_h"), F.col("n")).alias("avg_sentiment"),
        (F.floor(F.try_divide(F.col("sum_h"), F.col("n")) - base_h + F.lit(0.5)) / F.lit(100)).alias("delta"),
        "anomalies")


register("a11_sentiment_vs_baseline", with_enriched("""
SELECT call_type, count(CASE WHEN score_h > 0 THEN 1 END) AS n, max(baseline) AS baseline,
       floor(sum(CASE WHEN score_h > 0 THEN score_h END) / count(CASE WHEN score_h > 0 THEN 1 END) + 0.5) / 100 AS avg_sentiment,
       floor(sum(CASE WHEN score_h > 0 THEN score_h END) / count(CASE WHEN score_h > 0 THEN 1 END) - round(max(baseline) * 100) + 0.5) / 100 AS delta,
       count_if(is_anomaly) AS anomalies
FROM enriched GROUP BY call_type"""))(sentiment_vs_baseline)


# --- Per-meeting projections: every domain operator, all meetings -----------------------------
ISSUES_FLAT_SPARK = lambda: F.array_join(F.transform(F.col("issues"), lambda i: F.concat_ws(":", i["severity"], i["type"], i["title"])), " | ")
ISSUES_FLAT_SQL = "array_to_string(list_transform(issues, lambda i: concat_ws(':', i.severity, i.type, i.title)), ' | ')"


def _projection(name: str, spark_cols: dict, sql_cols: dict, spark_filter=None, sql_filter: str | None = None):
    def build(spark, sf):
        e = enriched(spark, sf)
        if spark_filter is not None:
            e = e.filter(spark_filter())
        return e.select(F.col("meeting_id"), *[(F.col(v) if isinstance(v, str) else v()).alias(k)
                                                for k, v in spark_cols.items()])
    sel = ", ".join(f"{v} AS {k}" for k, v in sql_cols.items())
    where = f" WHERE {sql_filter}" if sql_filter else ""
    register(name, with_enriched(f"SELECT meeting_id, {sel} FROM enriched{where}"))(build)


def _same(*cols):
    return {c: c for c in cols}


_projection("d04_extract_issues", {"n_issues": "n_issues", "issues_flat": ISSUES_FLAT_SPARK},
            {"n_issues": "n_issues", "issues_flat": ISSUES_FLAT_SQL})
_projection("d05_top_severity", _same("severity"), _same("severity"))
_projection("d06_call_type", _same("title", "call_type"), _same("title", "call_type"))
_projection("d07_category", _same("category", "category_level"), _same("category", "category_level"))
_projection("d08_topic_categories", _same("topic_category", "topic_categories_all"),
            _same("topic_category", "topic_categories_all"))
_projection("d09_l3_disagreement", _same("category", "l3_category"), _same("category", "l3_category"),
            lambda: F.col("l3_category") != F.col("category"), "l3_category <> category")
_projection("d10_sentiment", _same("call_type", "sentiment_score", "sentiment_label", "baseline", "z_score", "is_anomaly"),
            _same("call_type", "sentiment_score", "sentiment_label", "baseline", "z_score", "is_anomaly"))
_projection("d11_route", _same("escalation_team", "escalation_priority", "has_pagerduty", "requires_escalation"),
            _same("escalation_team", "escalation_priority", "has_pagerduty", "requires_escalation"))
_projection("d12_notebook_team", _same("notebook_team"), _same("notebook_team"))
_projection("d13_account_name", _same("account_name"), _same("account_name"))
_projection("d14_account_from_title", _same("title_account"), _same("title_account"))
_projection("d15_company", _same("company"), _same("company"))
_projection("d16_company_simple", _same("company_simple"), _same("company_simple"))
_projection("d17_feature_gap_rule", _same("feature_gap"), _same("feature_gap"))
_projection("d18_moment_flags", _same("has_churn_signal", "has_feature_gap", "has_praise", "n_key_moments"),
            _same("has_churn_signal", "has_feature_gap", "has_praise", "n_key_moments"))
_projection("d19_outage_related", _same("outage_related"), _same("outage_related"))
_RECORD_SPARK = {**_same("title", "call_type", "category", "sentiment_score", "sentiment_label", "is_anomaly", "z_score",
                         "n_issues", "escalation_team", "escalation_priority", "has_pagerduty", "processed_bucket",
                         "account_name", "feature_gap", "month"),
                 "issues_flat": ISSUES_FLAT_SPARK,
                 "processed_at": lambda: F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss")}
_RECORD_SQL = {**{k: k for k in _RECORD_SPARK if k not in ("issues_flat", "processed_at")},
               "issues_flat": ISSUES_FLAT_SQL, "processed_at": "strftime(processed_at, '%Y-%m-%d %H:%M:%S')"}
_projection("d21_records", _RECORD_SPARK, _RECORD_SQL)
_projection("p12_truncations",
            {"summary_500": "summary_short",
             "first_moments": lambda: F.array_join(F.transform(F.slice("key_moments", 1, 5), lambda m: m["text"]), " / "),
             "title_80": lambda: F.substring(F.coalesce("title", F.lit("")), 1, 80),
             "title_40": lambda: F.substring(F.coalesce("title", F.lit("")), 1, 40),
             "title_65": lambda: F.substring(F.coalesce("title", F.lit("")), 1, 65)},
            {"summary_500": "summary_short",
             "first_moments": "array_to_string(list_transform(key_moments[1:5], lambda m: m.text), ' / ')",
             "title_80": "substr(coalesce(title, ''), 1, 80)", "title_40": "substr(coalesce(title, ''), 1, 40)",
             "title_65": "substr(coalesce(title, ''), 1, 65)"})
_projection("p13_churn_flag",
            {"churn_flag_v1": lambda: flags_mod.churn_risk_flag(F.col("call_type"), F.col("sentiment_score"), F.col("is_anomaly"), 3.5, True),
             "churn_flag_v2": lambda: flags_mod.churn_risk_flag(F.col("call_type"), F.col("sentiment_score"), F.col("is_anomaly"), 3.0, False)},
            {"churn_flag_v1": "CASE WHEN coalesce(call_type = 'external' AND sentiment_score < 3.5 AND is_anomaly, false) THEN 'At Risk' ELSE 'Healthy' END",
             "churn_flag_v2": "CASE WHEN coalesce(call_type = 'external' AND sentiment_score < 3.0, false) THEN 'At Risk' ELSE 'Healthy' END"})
_projection("p14_account_fallback",
            {"account": lambda: F.coalesce(F.nullif("account_name", F.lit("")), "title_account"),
             "account_or_title": lambda: F.coalesce(F.nullif(F.coalesce(F.nullif("account_name", F.lit("")), "title_account"), F.lit("")),
                                            F.substring(F.coalesce("title", F.lit("")), 1, 40))},
            {"account": "coalesce(nullif(account_name, ''), title_account)",
             "account_or_title": "coalesce(nullif(coalesce(nullif(account_name, ''), title_account), ''), substr(coalesce(title, ''), 1, 40))"})

# --- Filters ----------------------------------------------------------------------------------
_projection("p02_anomalies", _same("z_score"), _same("z_score"), lambda: F.col("is_anomaly"), "is_anomaly")
_projection("p03_escalated", _same("escalation_priority"), _same("escalation_priority"),
            lambda: F.col("escalation_priority").isin("p0", "p1"), "escalation_priority IN ('p0', 'p1')")
_projection("p04_valid_score", _same("sentiment_score"), _same("sentiment_score"),
            lambda: F.col("sentiment_score") > 0, "sentiment_score > 0")
_projection("p05_external_low_score", _same("sentiment_score", "company_simple"), _same("sentiment_score", "company_simple"),
            lambda: (F.col("call_type") == "external") & (F.col("sentiment_score") > 0) & (F.col("sentiment_score") < 3.0),
            "call_type = 'external' AND sentiment_score > 0 AND sentiment_score < 3.0")
_projection("p08_month_account_mask", _same("company", "sentiment_score"), _same("company", "sentiment_score"),
            lambda: (F.col("month") == "1998-03") & (F.col("sentiment_score") > 0) & F.col("company").isNotNull(),
            "month = '1998-03' AND sentiment_score > 0 AND company IS NOT NULL")
_projection("p09_visual_filter", _same("category", "call_type"), _same("category", "call_type"),
            lambda: F.col("category").isNotNull() & F.col("category").isin("Incident Response", "Technical Support"),
            "category IS NOT NULL AND category IN ('Incident Response', 'Technical Support')")
_projection("p10_title_contains", _same("title"), _same("title"),
            lambda: F.coalesce(F.col("title"), F.lit("")).contains("War Room"), "contains(coalesce(title, ''), 'War Room')")
_projection("p11_outage_filter", _same("title", "sentiment_score"), _same("title", "sentiment_score"),
            lambda: F.col("outage_related") & (F.col("sentiment_score") > 0), "outage_related AND sentiment_score > 0")
