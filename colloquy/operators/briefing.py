"""D-26: the dashboard briefing as a DataFrame of lines (section, ord, line).

Each section is its own small query (a one-row aggregate, the call-type domain,
or a top-N list capped as the feature requires: 20 anomalies, 15 p0, 15 p1), and
the sections are unioned — nothing is assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import reports as R
from colloquy.rules import CALL_TYPES

CALL_TYPE_LABELS = {"support": "Support Cases", "external": "External (Customer)", "internal": "Internal"}


def _lines(df: DataFrame, section: int, line, order_cols) -> DataFrame:
    w = Window.orderBy(*order_cols)  # over a capped list (<= 20 rows)
    return df.select(F.lit(section).alias("section"), F.row_number().over(w).alias("ord"), line.alias("line"))


def briefing_lines(e: DataFrame) -> DataFrame:
    k = R.kpis(e)
    pct = lambda n: F.coalesce(F.round(F.try_divide(F.col(n) * 100, F.col("total_meetings"))).cast("bigint"), F.lit(0))
    kpi = k.select(F.lit(1).alias("section"), F.lit(1).alias("ord"), F.concat_ws(
        "\n", F.lit("── KPI SUMMARY ──"),
        F.format_string("Total Meetings Processed:  %d", "total_meetings"),
        F.format_string("Anomalies Flagged:         %d (%d%% of all meetings)", F.col("anomalies_flagged"), pct("anomalies_flagged")),
        F.format_string("Average Sentiment Score:   %s/5.0", F.col("avg_sentiment").cast("string")),
        F.format_string("Meetings Escalated P0/P1:  %d (%d%% of all meetings)", F.col("meetings_escalated"), pct("meetings_escalated")),
        F.format_string("Feature Gaps Identified:   %d", "feature_gaps")).alias("line"))
    dist = R.domain_counts(e, "call_type", CALL_TYPES, "call_type")
    label = F.coalesce(*[F.when(F.col("call_type") == c, F.lit(l)) for c, l in CALL_TYPE_LABELS.items()], F.col("call_type"))
    dist_lines = dist.select(F.lit(2).alias("section"),
                             F.coalesce(*[F.when(F.col("call_type") == c, F.lit(i + 1)) for i, c in enumerate(CALL_TYPES)]).alias("ord"),
                             F.format_string("  %s: %d meetings (%s%%)", label, F.col("n"), F.col("pct").cast("string")).alias("line"))
    an = R.anomaly_report(e).limit(20)
    an_lines = _lines(an, 3, F.format_string("  [%s] %s | %s | %s | %s | %s", F.upper("priority"), "account", "call_type",
                                            "category", "month", "evidence"), ["z_score", "meeting_id"])
    esc = R.escalation_report(e)
    out = kpi.unionByName(dist_lines).unionByName(an_lines)
    for sec, pri in ((4, "p0"), (5, "p1")):
        top = esc.filter(F.col("priority") == pri).orderBy(F.col("z_score").desc(), "meeting_id").limit(15)
        line = F.concat(F.format_string("  %s | %s | %s | %s", "account", "category", "month", "reasoning"),
                        F.when(F.col("pagerduty"), F.lit(" [PagerDuty fired]")).otherwise(F.lit("")))
        out = out.unionByName(_lines(top, sec, line, [F.col("z_score").desc(), "meeting_id"]))
    return out
