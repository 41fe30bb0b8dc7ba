"""Dashboard visuals (V-*): one registration per row of the visual table."""

from __future__ import annotations

from colloquy.operators import visuals as V
from colloquy.operators.records import enriched
from colloquy.plans import register
from colloquy.plans.sqlgen import with_enriched
from colloquy.sources.tables import table


def _make(v: V.Visual):
    def build(spark, sf):
        return V.render(enriched(spark, sf), v)
    register(f"{v.vid}_{v.name}", with_enriched(V.grouped_metric_sql(v.dims, v.measures, v.filter, sort=v.sort)))(build)


for _v in V.VISUALS:
    _make(_v)

register("v05_severity_heatmap", with_enriched(
    "SELECT category, " + ", ".join(f"count_if(escalation_priority = '{s}') AS {s}" for s in ["p0", "p1", "p2", "p3"])
    + " FROM enriched GROUP BY category"))(lambda spark, sf: V.severity_heatmap(enriched(spark, sf)))
PIVOT_MONTHS = V.months("1995-01", "2001-12")
register("v23b_sentiment_matrix", with_enriched("SELECT category, " + ", ".join(
    f"floor(sum(score_h) FILTER (month = '{m}') * 10000 / nullif(count(score_h) FILTER (month = '{m}'), 0) + 0.5) / 1000000 AS \"{m}\""
    for m in PIVOT_MONTHS) + " FROM enriched GROUP BY category"))(
    lambda spark, sf: V.sentiment_pivot(enriched(spark, sf), PIVOT_MONTHS))
register("v08_anomaly_scatter", with_enriched("SELECT meeting_id, sentiment_score, z_score, call_type FROM enriched"))(
    lambda spark, sf: V.anomaly_scatter(enriched(spark, sf)))
register("v20_anomaly_scatter_sized", with_enriched(
    "SELECT meeting_id, sentiment_score, z_score, call_type, is_anomaly FROM enriched"))(
    lambda spark, sf: V.anomaly_scatter(enriched(spark, sf), True))
register("v02b_events_daily_trend", """
SELECT strftime(ts, '%Y-%m-%d') AS date,
       floor(sum(CAST(round(value * 100) AS BIGINT)) * 10000 / nullif(count(value), 0) + 0.5) / 1000000 AS avg_value,
       count(*) AS n
FROM events GROUP BY 1""")(lambda spark, sf: V.events_daily_trend(table(spark, sf, "events")))
