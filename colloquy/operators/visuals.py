"""Dashboard visuals as one parametrised group-by.

Each visual is a row of ``VISUALS``: dimensions, measures, an optional filter.
``grouped_metric`` turns a row into filter -> groupBy(dims).agg(measures); the
per-visual logic is data.  Averages are exact (integer hundredths, half-up to
6 decimals) so BI numbers match any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.flags import churn_risk_flag

MONTH = "1998-03"


def _avg_h(h: Column) -> Column:
    return F.floor(F.try_divide(F.sum(h) * F.lit(10000), F.count(h)) + F.lit(0.5)) / F.lit(1_000_000)


# measure name -> (Spark aggregate builder, DuckDB aggregate SQL)
MEASURES = {
    "n": (lambda: F.count(F.lit(1)), "count(*)"),
    "avg_sentiment": (lambda: _avg_h(F.col("score_h")),
                      "floor(sum(score_h) * 10000 / nullif(count(score_h), 0) + 0.5) / 1000000"),
    "avg_z": (lambda: _avg_h(F.round(F.col("z_score") * 100).cast("bigint")),
              "floor(sum(CAST(round(z_score * 100) AS BIGINT)) * 10000 / nullif(count(z_score), 0) + 0.5) / 1000000"),
    "anomalies": (lambda: F.count_if(F.col("is_anomaly")), "count_if(is_anomaly)"),
    "pagerduty": (lambda: F.count_if(F.col("has_pagerduty")), "count_if(has_pagerduty)"),
    "issues": (lambda: F.sum("n_issues").cast("bigint"), "CAST(sum(n_issues) AS BIGINT)"),
}

# derived dimension name -> (Spark column builder, DuckDB expression)
DIMENSIONS = {
    "date": (lambda: F.date_format("start_time", "yyyy-MM-dd"), "strftime(start_time, '%Y-%m-%d')"),
    "churn_flag_v1": (lambda: churn_risk_flag(F.col("call_type"), F.col("sentiment_score"), F.col("is_anomaly"), 3.5, True),
                      "CASE WHEN coalesce(call_type = 'external' AND sentiment_score < 3.5 AND is_anomaly, false) "
                      "THEN 'At Risk' ELSE 'Healthy' END"),
    "churn_flag_v2": (lambda: churn_risk_flag(F.col("call_type"), F.col("sentiment_score"), F.col("is_anomaly"), 3.0, False),
                      "CASE WHEN coalesce(call_type = 'external' AND sentiment_score < 3.0, false) THEN 'At Risk' ELSE 'Healthy' END"),
}

# filter name -> (Spark predicate builder, DuckDB predicate)
FILTERS = {
    "external": (lambda: F.col("call_type") == "external", "call_type = 'external'"),
    "external_month": (lambda: (F.col("call_type") == "external") & (F.col("month") == MONTH),
                       f"call_type = 'external' AND month = '{MONTH}'"),
    "feature_gap": (lambda: F.col("feature_gap"), "feature_gap"),
    "incident": (lambda: F.col("category").isNotNull() & (F.col("category") == "Incident Response"),
                 "category IS NOT NULL AND category = 'Incident Response'"),
}


@dataclass(frozen=True)
class Visual:
    vid: str
    name: str
    dims: tuple
    measures: tuple
    filter: str | None = None
    sort: tuple = ()  # (field, "asc" or "desc"); the dimensions break ties, nulls come last


VISUALS = [
    Visual("v01", "call_type_pie", ("call_type",), ("n",)),
    Visual("v02", "sentiment_trend", ("date",), ("avg_sentiment",)),
    Visual("v03", "category_bar", ("category",), ("n",)),
    Visual("v04", "escalation_routing", ("call_type", "escalation_team"), ("n",)),
    Visual("v06", "anomaly_kpi", (), ("anomalies",)),
    Visual("v07", "monthly_sentiment", ("month", "call_type"), ("avg_sentiment",), sort=("month", "asc")),
    Visual("v09", "churn_risk_table", ("account_name", "churn_flag_v1"), ("avg_sentiment", "avg_z", "anomalies"), "external", sort=("avg_sentiment", "asc")),
    Visual("v10", "feature_gap_bar", ("category",), ("n",), "feature_gap", sort=("n", "desc")),
    Visual("v11", "blast_radius_bar", ("month", "call_type"), ("n",), "incident", sort=("month", "asc")),
    Visual("v12", "kpi_cards", (), ("n", "anomalies", "avg_sentiment", "pagerduty")),
    Visual("v13", "call_type_donut", ("call_type",), ("n",)),
    Visual("v14", "call_type_by_month", ("month", "call_type"), ("n",)),
    Visual("v15", "sentiment_label_bar", ("sentiment_label",), ("n",), sort=("n", "desc")),
    Visual("v16", "category_bar_v2", ("category",), ("n",), sort=("n", "desc")),
    Visual("v17", "category_by_call_type", ("call_type", "category"), ("n",)),
    Visual("v18", "sentiment_by_category", ("category",), ("avg_sentiment",), sort=("avg_sentiment", "asc")),
    Visual("v19", "monthly_sentiment_line", ("month", "call_type"), ("avg_sentiment",), sort=("month", "asc")),
    Visual("v21", "zscore_by_call_type", ("call_type",), ("avg_z",), sort=("avg_z", "asc")),
    Visual("v22", "anomaly_by_month", ("month", "call_type"), ("anomalies",)),
    Visual("v23", "sentiment_pivot", ("category", "month"), ("avg_sentiment",)),
    Visual("v24", "churn_risk_bar", ("account_name",), ("avg_sentiment",), "external", sort=("avg_sentiment", "asc")),
    Visual("v25", "month_accounts_bar", ("account_name",), ("avg_sentiment",), "external_month", sort=("avg_sentiment", "asc")),
    Visual("v26", "account_volume_bar", ("account_name",), ("n",), "external", sort=("n", "desc")),
    Visual("v27", "churn_risk_pie", ("churn_flag_v2",), ("n",)),
    Visual("v28", "external_category_bar", ("category", "month"), ("n",)),
    Visual("v28b", "external_category_bar_filtered", ("category", "month"), ("n",), "external"),
    Visual("v29", "escalation_team_bar", ("escalation_team",), ("n",)),
    Visual("v30", "severity_bar", ("escalation_priority",), ("n",)),
    Visual("v31", "escalation_call_type_bar", ("escalation_team", "call_type"), ("n",)),
    Visual("v32", "blast_radius_bar_v2", ("month", "call_type"), ("n",), "incident"),
    Visual("v33", "feature_gap_bar_v2", ("category",), ("n",), "feature_gap", sort=("n", "desc")),
    Visual("v34", "issues_by_call_type", ("call_type", "escalation_priority"), ("issues",)),
]


def _dim(d: str) -> Column:
    return DIMENSIONS[d][0]().alias(d) if d in DIMENSIONS else F.col(d)


def grouped_metric(df: DataFrame, dims, measures, filter_name: str | None = None, sort: tuple = ()) -> DataFrame:
    """filter -> groupBy(dims) -> agg(measures) -> orderBy(sort, dims); an empty ``dims`` is a global aggregate."""
    if filter_name:
        df = df.filter(FILTERS[filter_name][0]())
    aggs = [MEASURES[m][0]().alias(m) for m in measures]
    if not dims:
        return df.agg(*aggs)
    out = df.groupBy(*[_dim(d) for d in dims]).agg(*aggs)
    if not sort:
        return out
    first = F.col(sort[0])
    return out.orderBy(first.desc_nulls_last() if sort[1] == "desc" else first.asc_nulls_last(),
                       *[F.col(d).asc_nulls_last() for d in dims])


def grouped_metric_sql(dims, measures, filter_name: str | None = None, source: str = "enriched", sort: tuple = ()) -> str:
    sel_dims = [f"{DIMENSIONS[d][1]} AS {d}" if d in DIMENSIONS else d for d in dims]
    sel = ", ".join(sel_dims + [f"{MEASURES[m][1]} AS {m}" for m in measures])
    where = f" WHERE {FILTERS[filter_name][1]}" if filter_name else ""
    group = (" GROUP BY " + ", ".join(str(i + 1) for i in range(len(dims)))) if dims else ""
    order = (f" ORDER BY {sort[0]} {sort[1]} NULLS LAST, " + ", ".join(f"{d} NULLS LAST" for d in dims)) if sort else ""
    return f"SELECT {sel} FROM {source}{where}{group}{order}"


def render(df: DataFrame, v: Visual) -> DataFrame:
    return grouped_metric(df, v.dims, v.measures, v.filter, v.sort)


def months(first: str, last: str) -> list[str]:
    """The months ``YYYY-MM`` from ``first`` to ``last``."""
    (y0, m0), (y1, m1) = ([int(x) for x in m.split("-")] for m in (first, last))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(y0 * 12 + m0 - 1, y1 * 12 + m1)]


def sentiment_pivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """V-23: category x month matrix of the average score; the month list is explicit, so no job looks for it."""
    return df.groupBy("category").pivot("month", columns).agg(MEASURES["avg_sentiment"][0]())


def severity_heatmap(df: DataFrame) -> DataFrame:
    """V-05: category x severity pivot with an explicit value list (no extra distinct job)."""
    sev = ["p0", "p1", "p2", "p3"]
    return df.groupBy("category").pivot("escalation_priority", sev).count().na.fill(0, sev)


def anomaly_scatter(df: DataFrame, with_flag: bool = False) -> DataFrame:
    """V-08 / V-20: plain projection."""
    cols = ["meeting_id", "sentiment_score", "z_score", "call_type"] + (["is_anomaly"] if with_flag else [])
    return df.select(*cols)


def events_daily_trend(events: DataFrame) -> DataFrame:
    """V-02 on the events stream table: daily average value (exact, via hundredths)."""
    return (events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"))
            .agg(_avg_h(F.round(F.col("value") * 100).cast("bigint")).alias("avg_value"),
                 F.count(F.lit(1)).alias("n")))
