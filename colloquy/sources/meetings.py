"""Adapter: driver tables (orders, customer, lineitem) -> ``meetings_raw``.

One meeting per order, built deterministically from keys so that the same
definition can be written in SQL for the DuckDB oracle (plans/sqlgen.py renders
these very templates).  K = o_orderkey, C = c_name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.tables import table

# Meeting title by K % 16.
TITLE_TEMPLATES = [
    "Support Case #{K} - {C} API Timeout",
    "Support Case: billing dispute",
    "support case #{K} in lower case",
    "Aegis / {C} - Multi-Year Renewal",
    "Aegis / {C}",
    "Aegis / {C} - Business Review",
    "URGENT: War Room {K}",
    "Win/Loss Analysis - {C}",
    "SOC 2 Audit Prep",
    "Identity Module Setup - {C}",
    "Roadmap Review",
    "Sprint Planning {K}",
    "Aegis / {C} - Weekly Sync",
    "Weekly Sync",
    "Detect Reliability - 30-Day Review",
    "",
]
# Topics by K % 7.
TOPIC_SETS = [
    ["renewal", "pricing"],
    ["general chat", "outage"],
    ["saml setup"],
    ["latency spike", "compliance"],
    [],
    ["misc", "people"],
    ["roadmap", "gap"],
]
# Summary by K % 9; {K4} = last four digits of K, zero padded.
SUMMARY_TEMPLATES = [
    "Customer reported an outage affecting the analytics dashboards.",
    "The sync service is degraded and nightly jobs keep failing.",
    "Reports load slow and show an intermittent error.",
    "Customer asked a question about the invoice layout.",
    "A minor bug in the export was found; a request for clarification followed.",
    "Friendly check-in; the team shared plans for next quarter.",
    "Follow up by phone at 415-555-{K4} about the rollout.",
    "Send the notes to user{K}@example.com before the review.",
    "The customer was blocked after a critical download failure.",
]
# Key moment text by l_partkey % 8, type by l_linenumber % 4.
MOMENT_TEXTS = [
    "Customer is evaluating a competitor after repeated issues",
    "Asked for a roadmap item: custom report templates",
    "Dashboard was down for two hours",
    "Team praised the new onboarding flow",
    "Nightly sync failing since Monday",
    "Export is slow on large tenants",
    "Minor question on SSO settings",
    "Data loss reported in the audit log",
]
MOMENT_TYPES = ["churn_signal", "feature_gap", "praise", "incident"]
ACTION_ITEMS = ["Send recap", "Open ticket", "Schedule follow-up"]
# Sentiment label by score hundredths: (upper bound exclusive, label); NULL score -> NULL label.
LABEL_BANDS = [(200, "negative"), (275, "mixed-negative"), (325, "mixed"), (400, "mixed-positive"), (10 ** 9, "positive")]
COMPETITOR_SEGMENT = "MACHINERY"
NULL_SCORE_MODULUS = 97
MOMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
#: Meetings of one task, so that its memory does not grow with the input.
MEETINGS_PER_TASK = 50_000


def template_parts(template: str) -> list:
    """'a{K}b' -> ['a', ('K',), 'b'] (literal strings and placeholders)."""
    out = []
    for piece in re.split(r"(\{[A-Z0-9]+\})", template):
        if not piece:
            continue
        out.append((piece[1:-1],) if piece.startswith("{") else piece)
    return out


def _render(template: str, values: dict) -> Column:
    parts = [values[p[0]] if isinstance(p, tuple) else F.lit(p) for p in template_parts(template)]
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _pick(index: Column, options: list) -> Column:
    out = None
    for i, v in enumerate(options):
        out = F.when(index == F.lit(i), v) if out is None else out.when(index == F.lit(i), v)
    return out


def score_hundredths(k: Column) -> Column:
    return F.when(k % NULL_SCORE_MODULUS != 0, F.lit(100) + ((k * 37) % 41) * 10)


def n_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the meetings are dealt to: the shuffle partitions, more if a task would get more than
    ``MEETINGS_PER_TASK`` of them (row counts come from the files' footers)."""
    rows = max(table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "lineitem").count() // 4)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MEETINGS_PER_TASK))


def key_moments(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """All line items per order -> the distinct moments in order of first appearance, and how
    many line items there are.

    Every line item counts.  Repeats of a (text, type) are combined map-side to their first
    place and their number, so an order holding a large share of all lines ships one row per
    distinct moment and map partition, and its list is bounded by the moments' domain.  The first two
    columns of ``MOMENT_ORDER`` order the moments: a moment is a function of them, so two that agree there
    are one.  Only these columns are shuffled, texts come last; the orders are dealt to ``n`` tasks."""
    first = MOMENT_ORDER[:2]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *first)
    distinct = (li.groupBy("l_orderkey", (F.col("l_partkey") % len(MOMENT_TEXTS)).alias("t"), (F.col("l_linenumber") % len(MOMENT_TYPES)).alias("y"))
                .agg(F.min(F.struct(*first)).alias("first"), F.count(F.lit(1)).alias("n")))
    narrow = distinct.select("l_orderkey", "first", "t", "y", "n").repartition(n or n_tasks(spark, sf_dir), "l_orderkey")

    def value(values: list, i: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    return (narrow.groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list(F.struct("first", "t", "y"))).alias("m"), F.sum("n").alias("n"))
            .select(F.col("l_orderkey").alias("km_orderkey"), F.col("n").cast("int").alias("n_moments"),
                    F.transform("m", lambda x: F.struct(value(MOMENT_TEXTS, x["t"]).alias("text"),
                                                        value(MOMENT_TYPES, x["y"]).alias("type"))).alias("key_moments")))


_EXPR_CACHE: dict = {}


def _meeting_columns(spark: SparkSession) -> list:
    """The adapter's output projection (built once per SparkContext: the template CASE
    chains take many driver-to-JVM calls to assemble)."""
    key = spark.sparkContext.applicationId
    if key in _EXPR_CACHE:
        return _EXPR_CACHE[key]
    k = F.col("o_orderkey")
    vals = {"K": k.cast("string"), "C": F.col("c_name"),
            "K4": F.lpad((k % 10000).cast("string"), 4, "0")}
    score_h = score_hundredths(k)
    label = None
    for bound, name in LABEL_BANDS:
        label = F.when(score_h < bound, F.lit(name)) if label is None else label.when(score_h < bound, F.lit(name))
    topics = _pick(k % len(TOPIC_SETS),
                   [F.array(*[F.lit(t) for t in ts]) if ts else F.array().cast("array<string>") for ts in TOPIC_SETS])
    attendees = F.slice(F.array(F.col("c_name"), F.lit("host@aegis.com"),
                                F.concat(F.lit("guest"), k.cast("string"), F.lit("@example.org")),
                                F.lit("eng@aegiscloud.com")), 1, (F.lit(1) + k % 4).cast("int"))
    cols = [
        k.cast("string").alias("meeting_id"),
        k.alias("k"),
        _pick(k % len(TITLE_TEMPLATES), [_render(t, vals) for t in TITLE_TEMPLATES]).alias("title"),
        F.col("o_orderdate").alias("start_time"),
        (F.lit(15) + (k % 8) * 5).cast("double").alias("duration_min"),
        attendees.alias("attendees"),
        (score_h / F.lit(100)).alias("sentiment_score"),
        label.alias("sentiment_label"),
        topics.alias("topics"),
        _pick(k % len(SUMMARY_TEMPLATES), [_render(t, vals) for t in SUMMARY_TEMPLATES]).alias("summary"),
        F.coalesce(F.col("key_moments"), F.array().cast("array<struct<text:string,type:string>>")).alias("key_moments"),
        F.coalesce("n_moments", F.lit(0)).alias("n_key_moments"),
        F.slice(F.array(*[F.lit(a) for a in ACTION_ITEMS]), 1, (k % 4).cast("int")).alias("action_items"),
        F.col("c_name").alias("account"),
        F.col("c_mktsegment").alias("segment"),
    ]
    _EXPR_CACHE[key] = cols
    return cols


def meetings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meetings_raw schema plus ``k`` (order key), ``account`` (c_name), ``segment``.

    Orders with their customer and key moments are dealt out by order while they are narrow; everything
    longer is made in the tasks that then hold them."""
    n = n_tasks(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    km = key_moments(spark, sf_dir, n)
    return (o.join(c, o.o_custkey == c.c_custkey, "inner").repartition(n, "o_orderkey")
            .join(km, o.o_orderkey == km.km_orderkey, "left")
            .select(*_meeting_columns(spark)))


def competitor_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor set (account names) — customers of one market segment."""
    return (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == COMPETITOR_SEGMENT)
            .select(F.col("c_name").alias("account")).distinct())
