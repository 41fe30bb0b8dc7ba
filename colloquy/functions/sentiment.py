"""Sentiment vs per-call-type baseline (z-score, anomaly flag).

Scores, baselines and the deviation are integer millionths, so the rounding of z is exact and
identical across engines: z_h = floor(diff * 100 / std + 0.5), z = z_h / 100.  Reports that
average scores work on integer hundredths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import DEFAULT_RULES, RuleSet


def hundredths(x: Column) -> Column:
    """Double with at most two decimals -> exact integer hundredths."""
    return F.round(x * 100).cast("bigint")


MICRO = 1_000_000


def micros(x: Column) -> Column:
    """Double with at most six decimals -> exact integer millionths."""
    return F.round(x * MICRO).cast("bigint")


def round_half_up(x: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p — the same bits in every engine."""
    scale = 10 ** places
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def baseline_micros(call_type: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    out = None
    for ct, base in rules.baselines:
        cond = call_type == F.lit(ct)
        out = F.when(cond, F.lit(round(base * MICRO))) if out is None else out.when(cond, F.lit(round(base * MICRO)))
    return out.otherwise(F.lit(round(rules.default_baseline * MICRO)))


def sentiment_columns(call_type: Column, score: Column, rules: RuleSet = DEFAULT_RULES) -> dict:
    """Returns named Columns: baseline, z_score, is_anomaly (NULL score -> z NULL, not anomalous)."""
    base = baseline_micros(call_type, rules)
    z = F.floor((micros(score) - base) * F.lit(100) / F.lit(round(rules.std_dev * MICRO)) + F.lit(0.5)) / F.lit(100)
    return {
        "baseline": base / F.lit(MICRO),
        "z_score": z,
        "is_anomaly": F.coalesce(F.abs(z) > F.lit(rules.z_threshold), F.lit(False)),
    }
