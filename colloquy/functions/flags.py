"""Boolean flags and scores derived per meeting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.classify import any_keyword
from colloquy.functions.sentiment import MICRO
from colloquy.rules import (DEFAULT_RULES, RISK_COMPETITOR_POINTS, RISK_DROP_BANDS, RISK_SCORE_BANDS,
                            RuleSet)


def feature_gap_rule(category: Column, title: Column, issues: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Category is the product-feedback one, or a gap keyword in title + issue titles."""
    titles = F.coalesce(issues, F.array().cast("array<struct<title:string,severity:string,type:string>>"))["title"]
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.array_join(titles, " ", "")))
    return F.coalesce(category == F.lit(rules.feature_gap_category), F.lit(False)) | any_keyword(text, rules.feature_gap_keywords)


def has_moment(key_moments: Column, moment_type: str) -> Column:
    return F.coalesce(F.array_contains(key_moments["type"], F.lit(moment_type)), F.lit(False))


def outage_related(title: Column, topics: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    tl = F.lower(F.coalesce(title, F.lit("")))
    ts = F.lower(F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "))
    return any_keyword(tl, rules.outage_keywords) | any_keyword(ts, rules.outage_keywords)


def churn_risk_flag(call_type: Column, score: Column, is_anomaly: Column, max_score: float = 3.0,
                    require_anomaly: bool = False) -> Column:
    """'At Risk' / 'Healthy' (dashboard calculated field, both published variants)."""
    cond = (call_type == F.lit("external")) & (score < F.lit(max_score))
    if require_anomaly:
        cond = cond & F.coalesce(is_anomaly, F.lit(False))
    return F.when(F.coalesce(cond, F.lit(False)), F.lit("At Risk")).otherwise(F.lit("Healthy"))


def risk_score(score: Column, base_mean: Column, competitor: Column) -> Column:
    """0-100 churn risk from millionths: current score band + drop vs baseline mean + competitor.

    ``base_mean`` is the baseline month's mean in millionths (double, may be NULL)."""
    def bands(x: Column, table, lower_is_worse: bool) -> Column:
        out = None
        for limit, pts in table:
            lim = F.lit(round(limit * MICRO))
            cond = (x < lim) if lower_is_worse else (x >= lim)
            out = F.when(cond, F.lit(pts)) if out is None else out.when(cond, F.lit(pts))
        return out.otherwise(F.lit(0))
    drop = base_mean - score
    return (bands(score, RISK_SCORE_BANDS, True)
            + F.coalesce(F.when(drop.isNotNull(), bands(drop, RISK_DROP_BANDS, False)), F.lit(0))
            + F.when(F.coalesce(competitor, F.lit(False)), F.lit(RISK_COMPETITOR_POINTS)).otherwise(F.lit(0)))
