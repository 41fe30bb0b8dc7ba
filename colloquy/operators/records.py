"""meetings_raw -> enriched meetings -> records (one row per meeting).

The whole write path (classify -> score -> issues -> route -> record) is one
projection over the meetings DataFrame: no shuffle, no UDF, one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import accounts, classify, flags, issues, routing, sentiment
from colloquy.operators.redaction import MATCH_COLUMN, sanitize, vault_rows
from colloquy.rules import DEFAULT_RULES, OTHER_CATEGORY, SUMMARY_MAX_CHARS, RuleSet
from colloquy.sources.meetings import meetings_raw, n_tasks

RECORD_COLUMNS = ["meeting_id", "title", "call_type", "category", "sentiment_score", "sentiment_label",
                  "is_anomaly", "z_score", "n_issues", "issues", "escalation_team", "escalation_priority",
                  "has_pagerduty", "processed_at", "processed_bucket", "account_name", "feature_gap", "month"]


_EXPR_CACHE: dict = {}


def _stages(rules: RuleSet, spark: SparkSession) -> list:
    """The enrichment as a list of column dicts, one per projection stage.

    Expressions are unresolved Columns, independent of any DataFrame, so they are built
    once per (rule set, SparkContext) and reused: assembling the rule chains costs
    thousands of driver-to-JVM calls."""
    key = (repr(rules), spark.sparkContext.applicationId)
    if key in _EXPR_CACHE:
        return _EXPR_CACHE[key]
    sev = [s for s, _ in rules.severity_words]
    words = issues.first_words(F.col("_ctext"), rules)
    wcols = {s: F.col(f"_w_{s}") for s in sev}
    s_cols = sentiment.sentiment_columns(F.col("call_type"), F.col("sentiment_score"), rules)
    r = routing.route(F.col("category"), F.col("severity"), F.col("sentiment_score"), F.col("is_anomaly"), rules)
    l3 = F.get("_hits", 0)  # the first category in taxonomy order
    stages = [
        {
            "call_type": classify.call_type(F.col("title"), rules),
            "_l1": classify.title_level(F.col("title"), rules),
            "_hits": classify.taxonomy_hits(classify.all_topics(F.col("topics")), rules),
            "_ctext": issues.combined_text(F.col("summary"), F.col("key_moments")),
            "month": F.date_format(F.col("start_time"), "yyyy-MM"),
            "score_h": sentiment.hundredths(F.col("sentiment_score")),
        },
        {
            "_l2": F.when(F.col("_l1").isNull(), classify.taxonomy_level(classify.primary_topic(F.col("topics")), rules)),
            **{f"_w_{s}": words[s] for s in sev},
        },
        {
            "category": F.coalesce("_l1", "_l2", l3, F.lit(OTHER_CATEGORY)),
            "category_level": (F.when(F.col("_l1").isNotNull(), F.lit(1)).when(F.col("_l2").isNotNull(), F.lit(2))
                               .when(l3.isNotNull(), F.lit(3)).otherwise(F.lit(0))),
            "l3_category": F.coalesce(l3, F.lit(OTHER_CATEGORY)),
            "topic_category": F.coalesce(l3, F.lit(OTHER_CATEGORY)),
            "topic_categories_all": F.when(l3.isNotNull(), F.array_join("_hits", "|")).otherwise(F.lit(OTHER_CATEGORY)),
            "issues": issues.issues_from_words(wcols, F.col("key_moments"), rules),
            "severity": issues.severity_from_words(wcols, rules),
            "baseline": s_cols["baseline"], "z_score": s_cols["z_score"], "is_anomaly": s_cols["is_anomaly"],
        },
        {"n_issues": F.size("issues")},
        {"escalation_team": r["team"], "escalation_priority": r["priority"],
         "has_pagerduty": r["pagerduty"], "requires_escalation": r["requires_escalation"]},
        {
            "notebook_team": F.when(F.col("is_anomaly") | F.col("has_pagerduty"), F.col("escalation_team")),
            "account_name": accounts.account_name(F.col("title"), F.col("call_type"), rules),
            "title_account": accounts.account_from_title(F.col("title"), rules),
            "company": accounts.company(F.col("title"), F.col("call_type")),
            "company_simple": accounts.company_simple(F.col("title")),
            "feature_gap": flags.feature_gap_rule(F.col("category"), F.col("title"), F.col("issues"), rules),
            "has_churn_signal": flags.has_moment(F.col("key_moments"), "churn_signal"),
            "has_feature_gap": flags.has_moment(F.col("key_moments"), "feature_gap"),
            "has_praise": flags.has_moment(F.col("key_moments"), "praise"),
            "outage_related": flags.outage_related(F.col("title"), F.col("topics"), rules),
            "n_attendees": F.size(F.coalesce("attendees", F.array().cast("array<string>"))),
            "n_actions": F.size(F.coalesce("action_items", F.array().cast("array<string>"))),
            "summary_short": F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_MAX_CHARS),
            "processed_at": F.col("start_time"),
            "processed_bucket": F.lit("processed"),
        },
    ]
    _EXPR_CACHE[key] = stages
    return stages


def enrich(meetings: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Adds every derived per-meeting column (records fields + notebook fields).

    Staged so each rule chain is evaluated once per row; intermediate columns
    start with an underscore and are dropped at the end."""
    df = meetings
    if "n_key_moments" not in df.columns:  # a source that lists every moment
        df = df.withColumn("n_key_moments", F.size("key_moments"))
    for stage in _stages(rules, meetings.sparkSession):
        df = df.withColumns(stage)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


MEETING_INPUTS = ("orders", "customer", "lineitem")


def build_sanitized(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Meetings with every string leaf redacted, their replacement counts and matches.

    The adapter deals the meetings out by id: redaction has as many tasks as there are shuffle
    partitions at least, and a task as many meetings as ``MEETINGS_PER_TASK`` says at most."""
    return sanitize(meetings_raw(spark, sf_dir), rules)


def build_enriched(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The full write path from the driver tables (no materialisation): every string leaf is
    redacted first, and classification reads the sanitized meeting only."""
    return enrich(build_sanitized(spark, sf_dir, rules).drop(MATCH_COLUMN), rules)


def _gold(spark: SparkSession, sf_dir: str, name: str, rules: RuleSet, build, **layout) -> DataFrame:
    from colloquy.operators.gold import gold_table
    return gold_table(spark, name, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in MEETING_INPUTS], repr(rules), build,
                      tasks=lambda: n_tasks(spark, sf_dir), **layout)


def _stored(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """The stored write path: sanitized meetings, their matches and every derived column, written once
    by the tasks that redacted them (read again, many files would go to one task and its sort)."""
    return _gold(spark, sf_dir, "enriched", rules, lambda: enrich(build_sanitized(spark, sf_dir, rules), rules),
                 sort_by=["call_type", "month"], bloom=["meeting_id"])


def sanitized(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The stored result of the one redaction pass; records and vault are both read from it."""
    stored = _stored(spark, sf_dir, rules)
    return stored.select(*stored.columns[:stored.columns.index(MATCH_COLUMN) + 1])  # what enrich adds stands behind


def enriched(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Enriched meetings as the stored (gold) table: built once per input fingerprint and
    rule set, then every report scans parquet (column pruning + row-group skipping)."""
    return _stored(spark, sf_dir, rules).drop(MATCH_COLUMN)


def vault(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The stored vault: the original behind every placeholder of every meeting, one row each."""
    return _gold(spark, sf_dir, "vault", rules, lambda: vault_rows(sanitized(spark, sf_dir, rules)), sort_by=["source_id"], bloom=["source_id"])


def records(spark: SparkSession, sf_dir: str, rules: RuleSet = DEFAULT_RULES, extra: list | None = None) -> DataFrame:
    """The stored record (18 fields) plus any requested enriched columns."""
    return enriched(spark, sf_dir, rules).select(*RECORD_COLUMNS, *(extra or []))
