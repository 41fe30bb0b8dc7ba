"""Analytics reports over enriched meetings / records.

Every report is a DataFrame -> DataFrame function.  Means are computed from
integer hundredths (``score_h``) and rounded half-up with ``floor(x + 0.5)`` so
results are exact and engine-independent.  Aggregations use Spark's partial
(map-side) aggregation; windows are only used where partitions are bounded
(per-key top-N with WindowGroupLimit, or over already-aggregated rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.sentiment import micros
from colloquy.rules import CALL_TYPES, DEFAULT_RULES, RuleSet

SEVERITIES = ["p0", "p1", "p2", "p3"]


# --- exact rounding helpers ---------------------------------------------------------------------
def mean_h(sum_h: Column, n: Column, places: int = 2) -> Column:
    """sum of hundredths / n -> mean rounded half-up to ``places`` decimals (NULL when n = 0)."""
    scale = 10 ** (places - 2)
    return F.floor(F.try_divide(sum_h * F.lit(scale), n) + F.lit(0.5)) / F.lit(10 ** places)


def ratio(num: Column, den: Column, places: int) -> Column:
    """num / den rounded half-up to ``places`` decimals."""
    return F.floor(F.try_divide(num * F.lit(10 ** places), den) + F.lit(0.5)) / F.lit(10 ** places)


def round6(x: Column) -> Column:
    return F.floor(x * F.lit(1_000_000) + F.lit(0.5)) / F.lit(1_000_000)


def valid_score() -> Column:
    return F.col("score_h") > 0


def account_col() -> Column:
    return F.coalesce(F.nullif(F.col("account_name"), F.lit("")), F.col("title_account"))


def issues_top3() -> Column:
    return F.array_join(F.transform(F.slice(F.col("issues"), 1, 3),
                                    lambda i: F.concat_ws(": ", F.upper(i["severity"]), i["title"])), "; ")


# --- A-01 KPIs ----------------------------------------------------------------------------------
def kpis(e: DataFrame) -> DataFrame:
    nz = F.coalesce(F.col("score_h"), F.lit(0)) != 0
    return e.agg(
        F.count(F.lit(1)).alias("total_meetings"),
        F.count_if(F.col("is_anomaly")).alias("anomalies_flagged"),
        F.coalesce(mean_h(F.sum(F.when(nz, F.col("score_h"))), F.count(F.when(nz, 1))), F.lit(0.0)).alias("avg_sentiment"),
        F.count_if(F.col("escalation_priority").isin("p0", "p1")).alias("meetings_escalated"),
        F.count_if(F.col("feature_gap")).alias("feature_gaps"))


# --- A-02 / A-07 domain-filled counts ----------------------------------------------------------
def domain_counts(e: DataFrame, column: str, domain: list, name: str) -> DataFrame:
    """Counts over a fixed value domain, zero-filled, with share of total (1 dp).

    Counts are partially aggregated before the shuffle; the domain side is rule data
    (a handful of rows), and the final window runs over at most len(domain) rows."""
    spark = e.sparkSession
    dom = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{name} string, ord int")
    counts = e.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    out = dom.join(counts, name, "left").select(name, "ord", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over <= len(domain) rows
    return out.select(name, "n", ratio(F.col("n") * F.lit(100), total, 1).alias("pct"),
                      total.alias("total")).orderBy("ord")


# --- A-03 anomalies -----------------------------------------------------------------------------
def evidence(score: Column, label: Column, z: Column, call_type: Column, issues: Column) -> Column:
    top = F.get(issues, 0)
    base = F.format_string("Sentiment %.1f/5 (%s) — z-score %+.2fσ from %s baseline",
                           F.coalesce(score, F.lit(0.0)), F.coalesce(label, F.lit("")),
                           F.coalesce(z, F.lit(0.0)), F.coalesce(call_type, F.lit("")))
    return F.when(top.isNotNull(), F.concat(base, F.lit(". Top issue ("), F.upper(F.coalesce(top["severity"], F.lit(""))),
                                            F.lit("): "), F.coalesce(top["title"], F.lit("")))).otherwise(base)


def anomaly_report(e: DataFrame) -> DataFrame:
    return (e.filter(F.col("is_anomaly"))
            .select("meeting_id", "title", account_col().alias("account"), "call_type", "category",
                    F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment"), "sentiment_label",
                    F.coalesce("z_score", F.lit(0.0)).alias("z_score"), "month",
                    F.col("escalation_team").alias("escalation"), F.col("escalation_priority").alias("priority"),
                    evidence(F.col("sentiment_score"), F.col("sentiment_label"), F.col("z_score"), F.col("call_type"),
                             F.col("issues")).alias("evidence"),
                    issues_top3().alias("issues"))
            .orderBy("z_score", "meeting_id"))


# --- A-04 escalations ---------------------------------------------------------------------------
def reasoning(issues: Column, priority: Column, z: Column, score: Column, category: Column, team: Column,
              pager: Column) -> Column:
    top = F.get(issues, 0)
    zz = F.coalesce(z, F.lit(0.0))
    sev_label = F.upper(F.coalesce(top["severity"], priority))
    issue_part = F.when(top.isNotNull(), F.concat(sev_label, F.lit(' signal: "'), F.coalesce(top["title"], F.lit("")), F.lit('"')))
    z_part = F.when(F.abs(zz) > 1.5, F.format_string("sentiment %.1f/5 (%+.2fσ %s baseline)", F.coalesce(score, F.lit(0.0)), zz,
                                                     F.when(zz < 0, F.lit("below")).otherwise(F.lit("above"))))
    rule_part = F.concat(F.lit("category "), F.coalesce(category, F.lit("")), F.lit(" matched escalation rule"))
    parts = F.when(issue_part.isNull() & z_part.isNull(), rule_part).otherwise(F.concat_ws(". ", issue_part, z_part))
    return F.concat(parts, F.lit(" → routed to "), F.coalesce(team, F.lit("")), F.lit(" team"),
                    F.when(pager, F.lit(" (PagerDuty fired)")).otherwise(F.lit("")))


def escalation_report(e: DataFrame) -> DataFrame:
    return (e.filter(F.col("escalation_priority").isin("p0", "p1"))
            .select("meeting_id", "title", account_col().alias("account"), "call_type", "category",
                    F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment"),
                    F.coalesce("z_score", F.lit(0.0)).alias("z_score"),
                    F.col("escalation_priority").alias("priority"), F.col("escalation_team").alias("team"),
                    F.col("has_pagerduty").alias("pagerduty"), "is_anomaly", "month",
                    reasoning(F.col("issues"), F.col("escalation_priority"), F.col("z_score"), F.col("sentiment_score"),
                              F.col("category"), F.col("escalation_team"), F.col("has_pagerduty")).alias("reasoning"),
                    issues_top3().alias("issues"))
            .orderBy(F.when(F.col("priority") == "p0", 0).otherwise(1), F.col("z_score").desc(), "meeting_id"))


# --- A-05 / A-06 trends -------------------------------------------------------------------------
def _trend_rows(e: DataFrame, call_type: str, days: int, now: str | None) -> DataFrame:
    """``now`` is a parameter (never the wall clock) of the last-N-days filter."""
    df = e
    if call_type:
        df = df.filter(F.col("call_type") == call_type)
    if days > 0:
        if now is None:
            raise ValueError("days > 0 needs an explicit now")
        df = df.filter(F.col("processed_at") >= F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))
    return df


def trend_labels(e: DataFrame, call_type: str = "", days: int = 0, now: str | None = None) -> DataFrame:
    """Label counts of the rows that a trend summary covers."""
    return label_distribution(_trend_rows(e, call_type, days, now))


def sentiment_trends(e: DataFrame, call_type: str = "", days: int = 0, now: str | None = None, missing_as_zero: bool = True) -> DataFrame:
    """Trend summary.  A missing score counts as 0 in the averages and the minimum, or is skipped."""
    df = _trend_rows(e, call_type, days, now)
    sh = F.coalesce(F.col("score_h"), F.lit(0)) if missing_as_zero else F.col("score_h")
    return df.agg(
        F.lit(call_type or "all").alias("call_type"),
        F.count(F.lit(1)).alias("n_meetings"),
        mean_h(F.sum(sh), F.count(sh), 3).alias("avg_sentiment"),
        (F.min(sh) / 100).alias("min_sentiment"),
        (F.max(sh) / 100).alias("max_sentiment"),
        F.count_if(F.col("is_anomaly")).alias("anomaly_count"),
        ratio(F.count_if(F.col("is_anomaly")), F.count(F.lit(1)), 3).alias("anomaly_rate"))


def label_distribution(e: DataFrame) -> DataFrame:
    return e.groupBy(F.coalesce("sentiment_label", F.lit("unknown")).alias("sentiment_label")).agg(
        F.count(F.lit(1)).alias("n"))


# --- A-08 / A-09 pivots -------------------------------------------------------------------------
def month_by_call_type(e: DataFrame) -> DataFrame:
    return e.groupBy("month").pivot("call_type", CALL_TYPES).count().na.fill(0, CALL_TYPES)


def slug(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name.lower()).strip("_").replace("___", "_")


def call_type_by_category(e: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    cats = rules.categories + ["Other"]
    p = e.groupBy("call_type").pivot("category", cats).count().na.fill(0, cats)
    return p.select("call_type", *[F.col(f"`{c}`").alias(slug(c)) for c in cats])


# --- A-10 / W-01 --------------------------------------------------------------------------------
def category_summary(e: DataFrame) -> DataFrame:
    return e.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        mean_h(F.sum(F.when(valid_score(), F.col("score_h"))), F.count(F.when(valid_score(), 1))).alias("mean_sentiment"))


def first_n_per_group(e: DataFrame, group: str, n: int = 3, order: str = "meeting_id",
                      cols: tuple = ("meeting_id", "title")) -> DataFrame:
    """row_number() <= n per group; planned as WindowGroupLimit (partial limit before the shuffle)."""
    w = Window.partitionBy(group).orderBy(order)
    keep = [group] + [c for c in cols if c != group]
    out = (e.select(*keep, *([order] if order not in keep else []))
           .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n))
    return out.select(*keep, F.col("rn").cast("bigint").alias("rn"))


# --- A-12 .. A-14 monthly statistics -------------------------------------------------------------
def monthly_by_type(e: DataFrame) -> DataFrame:
    v = e.filter(valid_score())
    return v.groupBy("month", "call_type").agg(
        mean_h(F.sum("score_h"), F.count(F.lit(1))).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        round6(F.stddev_samp("score_h") / 100).alias("std"))


def monthly_overall(e: DataFrame) -> DataFrame:
    v = e.filter(valid_score())
    g = v.groupBy("month").agg(F.sum("score_h").alias("sum_h"), F.count(F.lit(1)).alias("n"),
                               F.stddev_samp("score_h").alias("sd_h"))
    mean = F.col("sum_h") / F.col("n") / 100
    se = F.col("sd_h") / 100 / F.sqrt(F.col("n"))
    return g.select("month", "n", round6(mean).alias("mean"), round6(se).alias("se"),
                    round6(mean - F.lit(1.96) * se).alias("ci_low"), round6(mean + F.lit(1.96) * se).alias("ci_high"))


def month_over_month(e: DataFrame) -> DataFrame:
    """W-02 + A-14: consecutive-month delta of means and two-sample z.

    The window runs over one row per month (already aggregated), so a single
    partition is bounded by the number of months."""
    v = e.filter(valid_score())
    g = v.groupBy("month").agg(F.sum("score_h").alias("sum_h"), F.count(F.lit(1)).alias("n"),
                               F.var_samp("score_h").alias("var_h"))
    w = Window.orderBy("month")
    g = g.select("month", (F.col("sum_h") / F.col("n")).alias("m_h"), "n", "var_h",
                 F.lag("month").over(w).alias("prev_month"),
                 F.lag(F.col("sum_h") / F.col("n")).over(w).alias("pm_h"),
                 F.lag("n").over(w).alias("pn"), F.lag("var_h").over(w).alias("pvar_h"))
    se_h = F.sqrt(F.col("var_h") / F.col("n") + F.col("pvar_h") / F.col("pn"))
    return g.filter(F.col("prev_month").isNotNull()).select(
        "month", "prev_month", round6((F.col("m_h") - F.col("pm_h")) / 100).alias("delta"),
        round6(F.try_divide(F.abs(F.col("m_h") - F.col("pm_h")), se_h)).alias("z"))


# --- A-15 / A-16 account impact ------------------------------------------------------------------
def account_impact(e: DataFrame, month: str, base_month: str, competitors: DataFrame) -> DataFrame:
    """Per company in ``month``: mean, n, min, distinct call types / categories, delta vs
    ``base_month`` mean, competitor flag.  ``competitors`` has one column ``account``;
    it grows with the customer table, so the join is left to AQE (no blind broadcast)."""
    m = e.filter((F.col("month") == month) & valid_score() & F.col("company").isNotNull())
    b = (e.filter((F.col("month") == base_month) & valid_score() & F.col("company").isNotNull())
         .groupBy("company").agg((F.sum("score_h") / F.count(F.lit(1))).alias("base_h")))
    g = m.groupBy("company").agg(
        F.sum("score_h").alias("sum_h"), F.count(F.lit(1)).alias("n"), F.min("score_h").alias("min_h"),
        F.array_join(F.array_sort(F.collect_set("call_type")), ", ").alias("call_types"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
    comp = competitors.select(F.col("account").alias("company"), F.lit(True).alias("competitive"))
    return (g.join(b, "company", "left").join(comp, "company", "left")
            .select("company", mean_h(F.col("sum_h"), F.col("n")).alias("mean"), "n", (F.col("min_h") / 100).alias("min"),
                    "call_types", "categories",
                    round6(F.col("base_h") / 100).alias("base_mean"),
                    round6((F.col("sum_h") / F.col("n") - F.col("base_h")) / 100).alias("delta_vs_base"),
                    F.coalesce("competitive", F.lit(False)).alias("competitive")))


def below_3() -> Column:
    """The raw score decides, not its hundredths: 2.996 is below 3."""
    return F.col("sentiment_score") < 3.0


def month_breakdown(e: DataFrame, month: str, by: str) -> DataFrame:
    m = e.filter((F.col("month") == month) & valid_score() & F.col("company").isNotNull())
    return m.groupBy(by).agg(mean_h(F.sum("score_h"), F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"),
                             F.count_if(below_3()).alias("n_below_3")).orderBy("mean", by)


# --- A-17 churn radar ---------------------------------------------------------------------------
def churn_radar(e: DataFrame, base_month: str, competitors: DataFrame) -> DataFrame:
    from colloquy.functions.flags import risk_score
    at_risk = (e.filter((F.col("call_type") == "external") & valid_score() & below_3())
               .withColumn("company", F.col("company_simple")))
    base = (e.filter((F.col("month") == base_month) & valid_score())
            .groupBy(F.col("company_simple").alias("company"))
            .agg((F.sum(micros(F.col("sentiment_score"))) / F.count(F.lit(1))).alias("base_u")))
    comp = competitors.select(F.col("account").alias("company"), F.lit(True).alias("competitive_threat"))
    # the two small sides first, so that a company with many meetings is joined (and split) once
    j = at_risk.join(base.join(comp, "company", "full"), "company", "left")
    ct = F.coalesce("competitive_threat", F.lit(False))
    return j.select("meeting_id", "company", "sentiment_score", "z_score", ct.alias("competitive_threat"),
                    "has_churn_signal", risk_score(micros(F.col("sentiment_score")), F.col("base_u"), ct).alias("risk_score")).orderBy(
                        F.desc("risk_score"), "meeting_id")


def churn_counts(radar: DataFrame) -> DataFrame:
    return radar.agg(F.count(F.lit(1)).alias("below_threshold"),
                     F.count_if(F.col("competitive_threat")).alias("competitive"),
                     F.count_if(F.col("has_churn_signal")).alias("churn_signal"))


# --- A-18 blast radius --------------------------------------------------------------------------
def blast_radius_monthly(e: DataFrame) -> DataFrame:
    o = e.filter(F.col("outage_related") & valid_score())
    return month_by_call_type(o)


def blast_radius_summary(e: DataFrame) -> DataFrame:
    outage = F.col("outage_related") & valid_score()
    return e.agg(F.count_if(outage).alias("n_outage"), F.count(F.lit(1)).alias("total"),
                 ratio(F.count_if(outage) * F.lit(100), F.count(F.lit(1)), 1).alias("share_pct"))


def blast_radius_mean_by_month(e: DataFrame) -> DataFrame:
    o = e.filter(F.col("outage_related") & valid_score())
    return o.groupBy("month").agg(F.count(F.lit(1)).alias("n"), mean_h(F.sum("score_h"), F.count(F.lit(1))).alias("mean"))


# --- A-19 / A-20 feature gaps -------------------------------------------------------------------
def feature_gap_topics(e: DataFrame, min_count: int = 2, top: int = 15) -> DataFrame:
    t = e.filter(F.col("has_feature_gap")).select(F.explode("topics").alias("topic"))
    return (t.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
            .orderBy(F.col("n").desc(), "topic").limit(top))


def feature_gap_rate(e: DataFrame) -> DataFrame:
    """Rate per (call type, category); categories without any gap are dropped on the long
    form (a join against per-category totals, both sides tiny after aggregation)."""
    g = e.groupBy("call_type", "category").agg(
        F.count_if(F.col("has_feature_gap")).alias("gaps"), F.count(F.lit(1)).alias("n"))
    keep = g.groupBy("category").agg(F.sum("gaps").alias("cat_gaps")).filter(F.col("cat_gaps") > 0)
    return g.join(keep, "category", "left_semi").select("call_type", "category",
                                                        round6(F.col("gaps") / F.col("n")).alias("rate"))


# --- A-21 .. A-25 -------------------------------------------------------------------------------
def escalations_by_team(e: DataFrame) -> DataFrame:
    return (e.filter(F.col("escalation_priority").isin("p0", "p1"))
            .groupBy(F.col("escalation_team").alias("team"), F.col("escalation_priority").alias("priority"))
            .agg(F.count(F.lit(1)).alias("n")))


def score_histogram(e: DataFrame, bins: int = 12) -> DataFrame:
    """12 equal-width bins between each call type's min and max (last bin closed).
    Edges come from a per-type aggregate (one row per call type: bounded, broadcast)."""
    v = e.filter(valid_score())
    edges = v.groupBy("call_type").agg(F.min("score_h").alias("lo"), F.max("score_h").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("score_h") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)) + 1)
    return (v.join(F.broadcast(edges), "call_type").groupBy("call_type", b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def box_stats(e: DataFrame) -> DataFrame:
    """Quartiles (linear interpolation) and 1.5 IQR whiskers per call type.  The exact
    percentile buffers value -> count maps; on integer hundredths that map has at most
    a few hundred entries per group, whatever the row count."""
    v = e.filter(valid_score())
    q = v.groupBy("call_type").agg(F.percentile("score_h", [0.25, 0.5, 0.75]).alias("qs"))
    q = q.select("call_type", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("med"), F.col("qs")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    j = v.select("call_type", "score_h").join(F.broadcast(q), "call_type")
    inside = (F.col("score_h") >= lo) & (F.col("score_h") <= hi)
    return j.groupBy("call_type", "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col("score_h"))).alias("wl"), F.max(F.when(inside, F.col("score_h"))).alias("wh"),
        F.count_if(~inside).alias("n_outliers")).select(
        "call_type", round6(F.col("q1") / 100).alias("q1"), round6(F.col("med") / 100).alias("median"),
        round6(F.col("q3") / 100).alias("q3"), round6((F.col("q3") - F.col("q1")) / 100).alias("iqr"),
        (F.col("wl") / 100).alias("whisker_low"), (F.col("wh") / 100).alias("whisker_high"), "n_outliers")


def summary_cards(e: DataFrame) -> DataFrame:
    outage = F.col("outage_related") & valid_score()
    at_risk = (F.col("call_type") == "external") & valid_score() & below_3()
    return e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_anomaly")).alias("anomalies"),
                 F.count_if(at_risk).alias("at_risk"),
                 ratio(F.count_if(outage) * F.lit(100), F.count(F.lit(1)), 1).alias("blast_share_pct"),
                 F.count_if(F.col("has_feature_gap")).alias("feature_gaps"))


# --- T-* top-k ----------------------------------------------------------------------------------
def most_negative_anomalies(e: DataFrame, k: int = 5) -> DataFrame:
    return (e.filter(F.col("is_anomaly") & (F.col("z_score") < 0))
            .select("meeting_id", "title", "z_score").orderBy("z_score", "meeting_id").limit(k))


def anomalies_min_z(e: DataFrame, min_z: float = 1.5, call_type: str = "") -> DataFrame:
    df = e.filter(F.col("is_anomaly") & (F.abs(F.coalesce("z_score", F.lit(0.0))) >= min_z))
    if call_type:
        df = df.filter(F.col("call_type") == call_type)
    return (df.select("meeting_id", "title", "call_type", "category", F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
                      "z_score", "sentiment_label", "escalation_team")
            .orderBy(F.abs("z_score").desc(), "meeting_id"))
