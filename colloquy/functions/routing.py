"""Escalation routing: (category, severity) rule, then fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import DEFAULT_RULES, RuleSet


def rule_team(category: Column, severity: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    out = None
    for cat, sev, team in rules.escalation_rules:
        cond = (category == F.lit(cat)) & (severity == F.lit(sev))
        out = F.when(cond, F.lit(team)) if out is None else out.when(cond, F.lit(team))
    return out


def is_pager(severity: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return F.coalesce(severity.isin(*rules.pager_severities), F.lit(False))


def route(category: Column, severity: Column, score: Column, is_anomaly: Column,
          rules: RuleSet = DEFAULT_RULES) -> dict:
    """Named Columns team, priority, pagerduty, requires_escalation."""
    anomaly = F.coalesce(is_anomaly, F.lit(False))
    pager = is_pager(severity, rules)
    fallback = (F.when(anomaly & F.coalesce(score < F.lit(2.5), F.lit(False)), F.lit("cs"))
                .when(pager, F.lit("engineering"))
                .otherwise(F.lit("support")))
    return {
        "team": F.coalesce(rule_team(category, severity, rules), fallback),
        "priority": F.coalesce(F.nullif(severity, F.lit("")), F.lit("p3")),
        "pagerduty": pager,
        "requires_escalation": pager | anomaly,
    }


def notebook_team(category: Column, severity: Column, score: Column, is_anomaly: Column,
                  rules: RuleSet = DEFAULT_RULES) -> Column:
    """Team only when anomalous or pager severity, else NULL."""
    r = route(category, severity, score, is_anomaly, rules)
    return F.when(F.coalesce(is_anomaly, F.lit(False)) | is_pager(severity, rules), r["team"])


def as_bool(x: Column) -> Column:
    """Boolean coercion: strings 'true', '1', 'yes' (any case, not trimmed) are true, NULL is false."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes"), F.lit(False))
