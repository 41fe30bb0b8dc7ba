"""Reports (A-*), windows (W-*), top-k (T-*) and rule-table joins (J-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import reports as R
from colloquy.operators.records import enriched
from colloquy.plans import register
from colloquy.plans.sqlgen import q, with_enriched
from colloquy.rules import CALL_TYPES, DEFAULT_RULES
from colloquy.sources.meetings import COMPETITOR_SEGMENT, competitor_accounts

MONTH = "1998-03"        # "the incident month" parameter of the account reports
BASE_MONTH = "1998-02"   # its baseline month
NOW = "2001-08-01 00:00:00"


def mh(sum_expr: str, n_expr: str, places: int = 2) -> str:
    scale = 10 ** (places - 2)
    return f"floor(({sum_expr}) * {scale} / nullif({n_expr}, 0) + 0.5) / {10 ** places}"


def rt(num: str, den: str, places: int) -> str:
    return f"floor(({num}) * {10 ** places} / nullif({den}, 0) + 0.5) / {10 ** places}"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


ACCOUNT_SQL = "coalesce(nullif(account_name, ''), title_account)"
ISSUES3_SQL = "array_to_string(list_transform(issues[1:3], lambda i: concat_ws(': ', upper(i.severity), i.title)), '; ')"
COMPETITORS_SQL = f"competitors AS (SELECT DISTINCT c_name AS account FROM customer WHERE c_mktsegment = {q(COMPETITOR_SEGMENT)})"


def _reg(name, sql, fn):
    register(name, sql)(fn)


# A-01
_reg("a01_kpis", with_enriched(f"""
SELECT count(*) AS total_meetings, count_if(is_anomaly) AS anomalies_flagged,
       coalesce({mh("sum(CASE WHEN coalesce(score_h, 0) <> 0 THEN score_h END)", "count(CASE WHEN coalesce(score_h, 0) <> 0 THEN 1 END)")}, 0.0) AS avg_sentiment,
       count_if(escalation_priority IN ('p0', 'p1')) AS meetings_escalated, count_if(feature_gap) AS feature_gaps
FROM enriched"""), lambda spark, sf: R.kpis(enriched(spark, sf)))


def _domain_sql(column: str, domain: list, name: str) -> str:
    dom = " UNION ALL ".join(f"SELECT {q(v)} AS {name}, {i} AS ord" for i, v in enumerate(domain))
    return with_enriched(f"""
SELECT {name}, n, {rt("n * 100", "sum(n) OVER ()", 1)} AS pct, CAST(sum(n) OVER () AS BIGINT) AS total
FROM (SELECT d.{name}, coalesce(c.n, 0) AS n FROM ({dom}) d
      LEFT JOIN (SELECT {column} AS {name}, count(*) AS n FROM enriched GROUP BY 1) c ON c.{name} = d.{name})""")


# A-02 (call types), A-07 (labels over the feedback label domain), A-24 (severities)
_reg("a02_call_type_distribution", _domain_sql("call_type", CALL_TYPES, "call_type"),
     lambda spark, sf: R.domain_counts(enriched(spark, sf), "call_type", CALL_TYPES, "call_type"))
LABELS = ["positive", "mixed-positive", "mixed", "mixed-negative", "negative"]
_reg("a07_label_counts_fixed_order", _domain_sql("sentiment_label", LABELS, "sentiment_label"),
     lambda spark, sf: R.domain_counts(enriched(spark, sf), "sentiment_label", LABELS, "sentiment_label"))
_reg("a24_severity_distribution", _domain_sql("severity", R.SEVERITIES, "severity"),
     lambda spark, sf: R.domain_counts(enriched(spark, sf), "severity", R.SEVERITIES, "severity"))

# A-03 anomalies (D-22 evidence, T-01 order)
EVIDENCE_SQL = ("CASE WHEN issues[1] IS NOT NULL THEN concat(printf('Sentiment %.1f/5 (%s) — z-score %+.2fσ from %s baseline', "
                "coalesce(sentiment_score, 0.0), coalesce(sentiment_label, ''), coalesce(z_score, 0.0), coalesce(call_type, '')), "
                "'. Top issue (', upper(coalesce(issues[1].severity, '')), '): ', coalesce(issues[1].title, '')) "
                "ELSE printf('Sentiment %.1f/5 (%s) — z-score %+.2fσ from %s baseline', coalesce(sentiment_score, 0.0), "
                "coalesce(sentiment_label, ''), coalesce(z_score, 0.0), coalesce(call_type, '')) END")
_reg("a03_anomaly_report", with_enriched(f"""
SELECT meeting_id, title, {ACCOUNT_SQL} AS account, call_type, category, coalesce(sentiment_score, 0.0) AS sentiment,
       sentiment_label, coalesce(z_score, 0.0) AS z_score, month, escalation_team AS escalation,
       escalation_priority AS priority, {EVIDENCE_SQL} AS evidence, {ISSUES3_SQL} AS issues
FROM enriched WHERE is_anomaly ORDER BY z_score, meeting_id"""), lambda spark, sf: R.anomaly_report(enriched(spark, sf)))

# A-04 escalations (D-23 reasoning, T-02 order)
_Z = "coalesce(z_score, 0.0)"
_ISSUE_PART = ("CASE WHEN issues[1] IS NOT NULL THEN concat(upper(coalesce(issues[1].severity, escalation_priority)), "
               "' signal: \"', coalesce(issues[1].title, ''), '\"') END")
_Z_PART = (f"CASE WHEN abs({_Z}) > 1.5 THEN printf('sentiment %.1f/5 (%+.2fσ %s baseline)', coalesce(sentiment_score, 0.0), "
           f"{_Z}, CASE WHEN {_Z} < 0 THEN 'below' ELSE 'above' END) END")
REASONING_SQL = (f"concat(CASE WHEN ({_ISSUE_PART}) IS NULL AND ({_Z_PART}) IS NULL THEN concat('category ', coalesce(category, ''), "
                 f"' matched escalation rule') ELSE concat_ws('. ', {_ISSUE_PART}, {_Z_PART}) END, ' → routed to ', "
                 f"coalesce(escalation_team, ''), ' team', CASE WHEN has_pagerduty THEN ' (PagerDuty fired)' ELSE '' END)")
_reg("a04_escalation_report", with_enriched(f"""
SELECT meeting_id, title, {ACCOUNT_SQL} AS account, call_type, category, coalesce(sentiment_score, 0.0) AS sentiment,
       {_Z} AS z_score, escalation_priority AS priority, escalation_team AS team, has_pagerduty AS pagerduty,
       is_anomaly, month, {REASONING_SQL} AS reasoning, {ISSUES3_SQL} AS issues
FROM enriched WHERE escalation_priority IN ('p0', 'p1')
ORDER BY CASE WHEN escalation_priority = 'p0' THEN 0 ELSE 1 END, z_score DESC, meeting_id"""),
     lambda spark, sf: R.escalation_report(enriched(spark, sf)))


# A-05 trends (+ P-07 call type and last-N-days filter)
def _trend_where(call_type: str, days: int) -> str:
    where = []
    if call_type:
        where.append(f"call_type = {q(call_type)}")
    if days:
        where.append(f"processed_at >= TIMESTAMP '{NOW}' - INTERVAL {days} DAY")
    return ("WHERE " + " AND ".join(where)) if where else ""


def _trend_sql(call_type: str, days: int, score: str = "coalesce(score_h, 0)") -> str:
    return with_enriched(f"""
SELECT {q(call_type or 'all')} AS call_type, count(*) AS n_meetings,
       {mh(f"sum({score})", f"count({score})", 3)} AS avg_sentiment,
       min({score}) / 100 AS min_sentiment, max({score}) / 100 AS max_sentiment,
       count_if(is_anomaly) AS anomaly_count, {rt("count_if(is_anomaly)", "count(*)", 3)} AS anomaly_rate
FROM enriched {_trend_where(call_type, days)}""")


def _trend_labels_sql(call_type: str, days: int) -> str:
    return with_enriched(f"""
SELECT coalesce(sentiment_label, 'unknown') AS sentiment_label, count(*) AS n FROM enriched {_trend_where(call_type, days)} GROUP BY 1""")


_reg("a05_sentiment_trends", _trend_sql("", 0), lambda spark, sf: R.sentiment_trends(enriched(spark, sf)))
_reg("p07_trends_type_last_days", _trend_sql("external", 365),
     lambda spark, sf: R.sentiment_trends(enriched(spark, sf), "external", 365, NOW))
_reg("a05b_trend_labels", _trend_labels_sql("external", 365),
     lambda spark, sf: R.trend_labels(enriched(spark, sf), "external", 365, NOW))
_reg("a05c_trends_scored_only", _trend_sql("", 0, "score_h"),
     lambda spark, sf: R.sentiment_trends(enriched(spark, sf), missing_as_zero=False))
_reg("a06_label_distribution", with_enriched(
    "SELECT coalesce(sentiment_label, 'unknown') AS sentiment_label, count(*) AS n FROM enriched GROUP BY 1"),
     lambda spark, sf: R.label_distribution(enriched(spark, sf)))

# A-08 month x call type pivot
_PIVOT_CT = ", ".join(f"count_if(call_type = {q(c)}) AS {c}" for c in CALL_TYPES)
_reg("a08_month_by_call_type", with_enriched(f"SELECT month, {_PIVOT_CT} FROM enriched GROUP BY month"),
     lambda spark, sf: R.month_by_call_type(enriched(spark, sf)))
# A-09 call type x category pivot
_CATS = DEFAULT_RULES.categories + ["Other"]
_reg("a09_call_type_by_category", with_enriched(
    "SELECT call_type, " + ", ".join(f"count_if(category = {q(c)}) AS {R.slug(c)}" for c in _CATS)
    + " FROM enriched GROUP BY call_type"), lambda spark, sf: R.call_type_by_category(enriched(spark, sf)))
# A-10 category summary
_reg("a10_category_summary", with_enriched(f"""
SELECT category, count(*) AS n,
       {mh("sum(CASE WHEN score_h > 0 THEN score_h END)", "count(CASE WHEN score_h > 0 THEN 1 END)")} AS mean_sentiment
FROM enriched GROUP BY category"""), lambda spark, sf: R.category_summary(enriched(spark, sf)))
# W-01 three samples per group
_reg("w01_samples_per_call_type", with_enriched("""
SELECT call_type, meeting_id, title, rn FROM (
  SELECT call_type, meeting_id, title, row_number() OVER (PARTITION BY call_type ORDER BY meeting_id) AS rn FROM enriched)
WHERE rn <= 3"""), lambda spark, sf: R.first_n_per_group(enriched(spark, sf), "call_type", 3))
_reg("w01b_samples_per_category", with_enriched("""
SELECT category, meeting_id, title, rn FROM (
  SELECT category, meeting_id, title, row_number() OVER (PARTITION BY category ORDER BY meeting_id) AS rn FROM enriched)
WHERE rn <= 3"""), lambda spark, sf: R.first_n_per_group(enriched(spark, sf), "category", 3))

# A-12 .. A-14, W-02
_reg("a12_monthly_by_type", with_enriched(f"""
SELECT month, call_type, {mh("sum(score_h)", "count(*)")} AS mean, count(*) AS n, {r6("stddev_samp(score_h) / 100")} AS std
FROM enriched WHERE score_h > 0 GROUP BY month, call_type"""), lambda spark, sf: R.monthly_by_type(enriched(spark, sf)))
_reg("a13_monthly_ci", with_enriched(f"""
SELECT month, n, {r6("sum_h / n / 100")} AS mean, {r6("sd_h / 100 / sqrt(n)")} AS se,
       {r6("sum_h / n / 100 - 1.96 * (sd_h / 100 / sqrt(n))")} AS ci_low, {r6("sum_h / n / 100 + 1.96 * (sd_h / 100 / sqrt(n))")} AS ci_high
FROM (SELECT month, sum(score_h) AS sum_h, count(*) AS n, stddev_samp(score_h) AS sd_h FROM enriched WHERE score_h > 0 GROUP BY month)"""),
     lambda spark, sf: R.monthly_overall(enriched(spark, sf)))
_reg("a14_month_over_month", with_enriched(f"""
SELECT month, prev_month, {r6("(m_h - pm_h) / 100")} AS delta,
       {r6("abs(m_h - pm_h) / nullif(sqrt(var_h / n + pvar_h / pn), 0)")} AS z
FROM (SELECT month, m_h, n, var_h, lag(month) OVER w AS prev_month, lag(m_h) OVER w AS pm_h, lag(n) OVER w AS pn,
             lag(var_h) OVER w AS pvar_h
      FROM (SELECT month, sum(score_h) / count(*) AS m_h, count(*) AS n, var_samp(score_h) AS var_h
            FROM enriched WHERE score_h > 0 GROUP BY month)
      WINDOW w AS (ORDER BY month))
WHERE prev_month IS NOT NULL"""), lambda spark, sf: R.month_over_month(enriched(spark, sf)))

# A-15 account impact (J-05 baseline join, J-09 competitor flag, U-01 sorted distinct sets)
_ACCT = f"""
SELECT g.company, {mh("g.sum_h", "g.n")} AS mean, g.n, g.min_h / 100 AS min, g.call_types, g.categories,
       {r6("b.base_h / 100")} AS base_mean, {r6("(g.sum_h / g.n - b.base_h) / 100")} AS delta_vs_base,
       coalesce(c.account IS NOT NULL, false) AS competitive
FROM (SELECT company, sum(score_h) AS sum_h, count(*) AS n, min(score_h) AS min_h,
             array_to_string(list_sort(list_distinct(list(call_type))), ', ') AS call_types,
             array_to_string(list_sort(list_distinct(list(category))), ', ') AS categories
      FROM enriched WHERE month = '{MONTH}' AND score_h > 0 AND company IS NOT NULL GROUP BY company) g
LEFT JOIN (SELECT company, sum(score_h) / count(*) AS base_h FROM enriched
           WHERE month = '{BASE_MONTH}' AND score_h > 0 AND company IS NOT NULL GROUP BY company) b ON b.company = g.company
LEFT JOIN competitors c ON c.account = g.company"""
_reg("a15_account_impact", with_enriched(_ACCT, COMPETITORS_SQL),
     lambda spark, sf: R.account_impact(enriched(spark, sf), MONTH, BASE_MONTH, competitor_accounts(spark, sf)))
_reg("t07_worst_accounts", with_enriched(f"SELECT * FROM ({_ACCT}) ORDER BY mean, company LIMIT 12", COMPETITORS_SQL),
     lambda spark, sf: R.account_impact(enriched(spark, sf), MONTH, BASE_MONTH, competitor_accounts(spark, sf))
     .orderBy("mean", "company").limit(12))


def _breakdown_sql(by: str) -> str:
    return with_enriched(f"""
SELECT {by}, {mh("sum(score_h)", "count(*)")} AS mean, count(*) AS n, count_if(score_h < 300) AS n_below_3
FROM enriched WHERE month = '{MONTH}' AND score_h > 0 AND company IS NOT NULL GROUP BY {by} ORDER BY mean, {by}""")


_reg("a16_month_by_call_type", _breakdown_sql("call_type"),
     lambda spark, sf: R.month_breakdown(enriched(spark, sf), MONTH, "call_type"))
_reg("a16b_month_by_category", _breakdown_sql("category"),
     lambda spark, sf: R.month_breakdown(enriched(spark, sf), MONTH, "category"))

# A-17 churn radar (D-20 risk score, J-06 baseline lookup)
_RISK = ("(CASE WHEN score_h < 250 THEN 40 WHEN score_h < 300 THEN 25 WHEN score_h < 350 THEN 10 ELSE 0 END"
         " + coalesce(CASE WHEN base_h - score_h IS NOT NULL THEN CASE WHEN base_h - score_h >= 150 THEN 30"
         " WHEN base_h - score_h >= 100 THEN 20 WHEN base_h - score_h >= 50 THEN 10 ELSE 0 END END, 0)"
         " + CASE WHEN competitive_threat THEN 30 ELSE 0 END)")
_RADAR = f"""
SELECT meeting_id, company, sentiment_score, z_score, competitive_threat, has_churn_signal, {_RISK} AS risk_score
FROM (SELECT r.*, b.base_h, coalesce(c.account IS NOT NULL, false) AS competitive_threat
      FROM (SELECT *, company_simple AS company_x FROM enriched
            WHERE call_type = 'external' AND score_h > 0 AND score_h < 300) r
      LEFT JOIN (SELECT company_simple AS company, sum(score_h) / count(*) AS base_h FROM enriched
                 WHERE month = '{BASE_MONTH}' AND score_h > 0 GROUP BY company_simple) b ON b.company = r.company_x
      LEFT JOIN competitors c ON c.account = r.company_x)"""
_RADAR = _RADAR.replace("SELECT meeting_id, company,", "SELECT meeting_id, company_x AS company,")
_reg("a17_churn_radar", with_enriched(f"SELECT * FROM ({_RADAR}) ORDER BY risk_score DESC, meeting_id", COMPETITORS_SQL),
     lambda spark, sf: R.churn_radar(enriched(spark, sf), BASE_MONTH, competitor_accounts(spark, sf)))
_reg("a17b_churn_counts", with_enriched(
    f"SELECT count(*) AS below_threshold, count_if(competitive_threat) AS competitive, count_if(has_churn_signal) AS churn_signal FROM ({_RADAR})",
    COMPETITORS_SQL),
     lambda spark, sf: R.churn_counts(R.churn_radar(enriched(spark, sf), BASE_MONTH, competitor_accounts(spark, sf))))
_reg("t07b_worst_churn_rows", with_enriched(f"SELECT * FROM ({_RADAR}) ORDER BY sentiment_score, meeting_id LIMIT 8", COMPETITORS_SQL),
     lambda spark, sf: R.churn_radar(enriched(spark, sf), BASE_MONTH, competitor_accounts(spark, sf))
     .orderBy("sentiment_score", "meeting_id").limit(8))

# A-18 blast radius
_reg("a18_blast_radius_monthly", with_enriched(
    f"SELECT month, {_PIVOT_CT} FROM enriched WHERE outage_related AND score_h > 0 GROUP BY month"),
     lambda spark, sf: R.blast_radius_monthly(enriched(spark, sf)))
_reg("a18b_blast_radius_summary", with_enriched(f"""
SELECT count_if(outage_related AND score_h > 0) AS n_outage, count(*) AS total,
       {rt("count_if(outage_related AND score_h > 0) * 100", "count(*)", 1)} AS share_pct FROM enriched"""),
     lambda spark, sf: R.blast_radius_summary(enriched(spark, sf)))
_reg("a18c_blast_radius_mean_by_month", with_enriched(f"""
SELECT month, count(*) AS n, {mh("sum(score_h)", "count(*)")} AS mean FROM enriched
WHERE outage_related AND score_h > 0 GROUP BY month"""), lambda spark, sf: R.blast_radius_mean_by_month(enriched(spark, sf)))

# A-19 / A-20 feature gaps
_reg("a19_feature_gap_topics", with_enriched("""
SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM enriched WHERE has_feature_gap)
GROUP BY topic HAVING count(*) >= 2 ORDER BY n DESC, topic LIMIT 15"""), lambda spark, sf: R.feature_gap_topics(enriched(spark, sf)))
_reg("a20_feature_gap_rate", with_enriched(f"""
SELECT call_type, category, {r6("gaps / n")} AS rate FROM (
  SELECT call_type, category, count_if(has_feature_gap) AS gaps, count(*) AS n FROM enriched GROUP BY call_type, category) g
WHERE category IN (SELECT category FROM enriched GROUP BY category HAVING count_if(has_feature_gap) > 0)"""),
     lambda spark, sf: R.feature_gap_rate(enriched(spark, sf)))

# A-21 .. A-25
_reg("a21_escalations_by_team", with_enriched("""
SELECT escalation_team AS team, escalation_priority AS priority, count(*) AS n FROM enriched
WHERE escalation_priority IN ('p0', 'p1') GROUP BY 1, 2"""), lambda spark, sf: R.escalations_by_team(enriched(spark, sf)))
_reg("a22_score_histogram", with_enriched("""
SELECT v.call_type, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((score_h - lo) * 12 / (hi - lo)), 11) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM enriched v JOIN (SELECT call_type, min(score_h) AS lo, max(score_h) AS hi FROM enriched WHERE score_h > 0 GROUP BY call_type) e
  ON e.call_type = v.call_type
WHERE score_h > 0 GROUP BY 1, 2"""), lambda spark, sf: R.score_histogram(enriched(spark, sf)))
_reg("a23_box_stats", with_enriched(f"""
SELECT call_type, {r6("q1 / 100")} AS q1, {r6("med / 100")} AS median, {r6("q3 / 100")} AS q3, {r6("(q3 - q1) / 100")} AS iqr,
       min(CASE WHEN inside THEN score_h END) / 100 AS whisker_low, max(CASE WHEN inside THEN score_h END) / 100 AS whisker_high,
       count_if(NOT inside) AS n_outliers
FROM (SELECT v.call_type, score_h, q1, med, q3,
             score_h >= q1 - 1.5 * (q3 - q1) AND score_h <= q3 + 1.5 * (q3 - q1) AS inside
      FROM enriched v JOIN (SELECT call_type, quantile_cont(score_h, 0.25) AS q1, quantile_cont(score_h, 0.5) AS med,
                                   quantile_cont(score_h, 0.75) AS q3 FROM enriched WHERE score_h > 0 GROUP BY call_type) q
        ON q.call_type = v.call_type WHERE score_h > 0)
GROUP BY call_type, q1, med, q3"""), lambda spark, sf: R.box_stats(enriched(spark, sf)))
_reg("a25_summary_cards", with_enriched(f"""
SELECT count(*) AS total, count_if(is_anomaly) AS anomalies,
       count_if(call_type = 'external' AND score_h > 0 AND score_h < 300) AS at_risk,
       {rt("count_if(outage_related AND score_h > 0) * 100", "count(*)", 1)} AS blast_share_pct,
       count_if(has_feature_gap) AS feature_gaps FROM enriched"""), lambda spark, sf: R.summary_cards(enriched(spark, sf)))

# T-03 / P-06 anomalies with |z| >= min_z, optional call type; T-05 most negative five
_reg("p06_anomalies_min_z", with_enriched("""
SELECT meeting_id, title, call_type, category, coalesce(sentiment_score, 0.0) AS sentiment_score, z_score, sentiment_label,
       escalation_team FROM enriched
WHERE is_anomaly AND abs(coalesce(z_score, 0.0)) >= 2.0 AND call_type = 'support' ORDER BY abs(z_score) DESC, meeting_id"""),
     lambda spark, sf: R.anomalies_min_z(enriched(spark, sf), 2.0, "support"))
_reg("t05_most_negative_anomalies", with_enriched("""
SELECT meeting_id, title, z_score FROM enriched WHERE is_anomaly AND z_score < 0 ORDER BY z_score, meeting_id LIMIT 5"""),
     lambda spark, sf: R.most_negative_anomalies(enriched(spark, sf), 5))
_reg("t05b_positive_anomalies", with_enriched("""
SELECT meeting_id, title, z_score FROM enriched WHERE is_anomaly AND z_score > 0"""),
     lambda spark, sf: enriched(spark, sf).filter(F.col("is_anomaly") & (F.col("z_score") > 0))
     .select("meeting_id", "title", "z_score"))
