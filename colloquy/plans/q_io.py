"""Rule-table joins, lookups, sinks, snapshots and feedback (J-*, S-*, D-28, W-05).

Scenarios are derived from the driver tables: "already stored" = meetings before a
cut-off month, re-processing = anomalous meetings, feedback = low-confidence
classifications and mixed-tone anomalies, invalid feedback = unclassifiable or
untitled meetings, unknown ids = suffixed ids of audit meetings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import routing
from colloquy.operators import feedback as FB
from colloquy.operators import sinks as SK
from colloquy.operators.records import RECORD_COLUMNS, enriched
from colloquy.plans import register
from colloquy.plans.q_reports import COMPETITORS_SQL
from colloquy.plans.sqlgen import q, with_enriched
from colloquy.rules import DEFAULT_RULES
from colloquy.sources.meetings import competitor_accounts

STORED_BEFORE = "1998-01"
LOOKUP_ID = "42"
TS = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "'%Y-%m-%d %H:%M:%S'"


def _ts(c) -> F.Column:
    return F.date_format(c, TS)


def _plus_days(n: int) -> F.Column:
    return F.timestamp_add("DAY", F.lit(n), F.col("start_time"))


# --- J-02 / J-03: rule lookups as joins against rule tables --------------------------------------
def baseline_join(spark, sf):
    """Rule table (3 rows, fixed by the RuleSet) broadcast; unknown call type -> default."""
    e = enriched(spark, sf).select("meeting_id", "call_type")
    rules = spark.createDataFrame(DEFAULT_RULES.baselines, "call_type string, rule_baseline double")
    return (e.join(F.broadcast(rules), "call_type", "left")
            .select("meeting_id", "call_type",
                    F.coalesce("rule_baseline", F.lit(DEFAULT_RULES.default_baseline)).alias("baseline")))


_BASE_VALUES = ", ".join(f"({q(c)}, CAST({b} AS DOUBLE))" for c, b in DEFAULT_RULES.baselines)
register("j02_baseline_rule_join", with_enriched(f"""
SELECT e.meeting_id, e.call_type, coalesce(b.rule_baseline, {DEFAULT_RULES.default_baseline}) AS baseline
FROM enriched e LEFT JOIN (VALUES {_BASE_VALUES}) b(call_type, rule_baseline) ON b.call_type = e.call_type"""))(baseline_join)


def route_join(spark, sf):
    """(category, severity) -> team via a broadcast rule table (6 rows), then the fallbacks."""
    e = enriched(spark, sf).select("meeting_id", "category", "severity", "sentiment_score", "is_anomaly")
    rules = spark.createDataFrame(DEFAULT_RULES.escalation_rules, "category string, severity string, rule_team string")
    j = e.join(F.broadcast(rules), ["category", "severity"], "left")
    pager = routing.is_pager(F.col("severity"))
    fallback = (F.when(F.col("is_anomaly") & F.coalesce(F.col("sentiment_score") < 2.5, F.lit(False)), F.lit("cs"))
                .when(pager, F.lit("engineering")).otherwise(F.lit("support")))
    return j.select("meeting_id", F.coalesce("rule_team", fallback).alias("team"))


_ROUTE_VALUES = ", ".join(f"({q(c)}, {q(s)}, {q(t)})" for c, s, t in DEFAULT_RULES.escalation_rules)
register("j03_route_rule_join", with_enriched(f"""
SELECT e.meeting_id, coalesce(r.rule_team, CASE WHEN e.is_anomaly AND coalesce(e.sentiment_score < 2.5, false) THEN 'cs'
       WHEN coalesce(e.severity IN ('p0', 'p1'), false) THEN 'engineering' ELSE 'support' END) AS team
FROM enriched e LEFT JOIN (VALUES {_ROUTE_VALUES}) r(category, severity, rule_team)
  ON r.category = e.category AND r.severity = e.severity"""))(route_join)


def competitor_flag(spark, sf):
    """J-09: membership flag against the competitor set (derived from customers, so it
    grows with the data: a plain left join, AQE may broadcast it after measuring)."""
    comp = competitor_accounts(spark, sf).withColumn("is_competitor", F.lit(True))
    e = enriched(spark, sf).select("meeting_id", "account")
    return e.join(comp, "account", "left").select("meeting_id", "account",
                                                  F.coalesce("is_competitor", F.lit(False)).alias("is_competitor"))


register("j09_competitor_flag", with_enriched("""
SELECT e.meeting_id, e.account, c.account IS NOT NULL AS is_competitor
FROM enriched e LEFT JOIN competitors c ON c.account = e.account""", COMPETITORS_SQL))(competitor_flag)


# --- S-04 / S-05 / S-06 scans and lookups --------------------------------------------------------
def get_meeting(e: DataFrame, meeting_id: str) -> DataFrame:
    """S-05: point lookup (a pushed-down equality filter)."""
    return e.filter(F.col("meeting_id") == meeting_id)


def require_meeting(e: DataFrame, meeting_id: str):
    rows = get_meeting(e, meeting_id).limit(2).collect()
    if not rows:
        raise KeyError(f"Meeting {meeting_id!r} not found")
    return rows[0]


register("s05_point_lookup", with_enriched(
    f"SELECT meeting_id, title, call_type, category, z_score FROM enriched WHERE meeting_id = '{LOOKUP_ID}'"))(
    lambda spark, sf: get_meeting(enriched(spark, sf), LOOKUP_ID).select("meeting_id", "title", "call_type", "category", "z_score"))
register("s04_full_scan_projection", with_enriched(
    "SELECT meeting_id, sentiment_score, is_anomaly, has_pagerduty, escalation_priority, feature_gap FROM enriched"))(
    lambda spark, sf: enriched(spark, sf).select("meeting_id", "sentiment_score", "is_anomaly", "has_pagerduty",
                                                 "escalation_priority", "feature_gap"))
register("s06_index_query_samples", with_enriched("""
SELECT meeting_id, title, category FROM enriched WHERE call_type = 'support' ORDER BY meeting_id LIMIT 3"""))(
    lambda spark, sf: enriched(spark, sf).filter(F.col("call_type") == "support")
    .select("meeting_id", "title", "category").orderBy("meeting_id").limit(3))
register("s06b_index_query_count", with_enriched("SELECT count(*) AS n FROM enriched WHERE call_type = 'support'"))(
    lambda spark, sf: enriched(spark, sf).filter(F.col("call_type") == "support").agg(F.count(F.lit(1)).alias("n")))


# --- S-08 idempotent insert ------------------------------------------------------------------
def insert_status(spark, sf):
    e = enriched(spark, sf)
    target = e.filter(F.col("month") < STORED_BEFORE).select(*RECORD_COLUMNS)
    return SK.insert_status(e.select(*RECORD_COLUMNS), target).select("meeting_id", "status")


register("s08_insert_if_absent", with_enriched(f"""
SELECT meeting_id, CASE WHEN month < '{STORED_BEFORE}' THEN 'duplicate' ELSE 'saved' END AS status FROM enriched"""))(insert_status)


# --- S-09 / S-10 lineage upsert and delete -------------------------------------------------------
def _lineage_runs(e: DataFrame) -> DataFrame:
    run1 = SK.lineage_events(e, "ingestion", F.col("start_time")).unionByName(
        SK.lineage_events(e, "analysis", F.timestamp_add("HOUR", F.lit(1), F.col("start_time"))))
    rerun = SK.lineage_events(e.filter(F.col("is_anomaly")), "analysis", _plus_days(1), "reprocessed")
    return run1.unionByName(rerun)


def lineage_upsert(spark, sf):
    latest = SK.latest_per_key(_lineage_runs(enriched(spark, sf)), ["meeting_id", "stage"], "timestamp")
    return latest.select("meeting_id", "stage", _ts("timestamp").alias("timestamp"), "status")


_LINEAGE_SQL = """
lineage AS (
  SELECT meeting_id, 'ingestion' AS stage, start_time AS ts, 'complete' AS status FROM enriched
  UNION ALL SELECT meeting_id, 'analysis', start_time + INTERVAL 1 HOUR, 'complete' FROM enriched
  UNION ALL SELECT meeting_id, 'analysis', start_time + INTERVAL 1 DAY, 'reprocessed' FROM enriched WHERE is_anomaly)"""
register("s09_lineage_upsert", with_enriched(f"""
SELECT meeting_id, stage, strftime(arg_max(ts, ts), {TS_SQL}) AS timestamp, arg_max(status, ts) AS status
FROM lineage GROUP BY meeting_id, stage""", _LINEAGE_SQL))(lineage_upsert)


def delete_meetings(spark, sf):
    e = enriched(spark, sf)
    keys = e.filter(F.coalesce(F.col("title"), F.lit("")) == "").select("meeting_id")
    return SK.delete_keys(_lineage_runs(e), keys).select("meeting_id", "stage", "status")


register("s10_delete_meeting", with_enriched("""
SELECT meeting_id, stage, status FROM lineage
WHERE meeting_id NOT IN (SELECT meeting_id FROM enriched WHERE coalesce(title, '') = '')""", _LINEAGE_SQL))(delete_meetings)


# --- S-12 / S-14 export and latest snapshot ------------------------------------------------------


def export_rows(spark, sf):
    return SK.export_rows(enriched(spark, sf), "2026-12-01").withColumn("date", F.col("date").cast("string"))


def _export_sql_col(f) -> str:
    if f.name == "processed_at":
        return "strftime(processed_at, '%Y-%m-%dT%H:%M:%S') AS processed_at"
    if f.dataType.simpleString() == "double":
        return f"round({f.name}, 6) AS {f.name}"
    return f.name


_EXPORT_SQL = ", ".join(_export_sql_col(f) for f in SK.EXPORT_SCHEMA.fields)
register("s12_export_rows", with_enriched(f"SELECT {_EXPORT_SQL}, '2026-12-01' AS date FROM enriched"))(export_rows)


def latest_snapshot(spark, sf):
    e = enriched(spark, sf)
    snaps = SK.export_rows(e.filter(F.col("month") < "2000-01"), "2026-11-30").unionByName(SK.export_rows(e, "2026-12-01"))
    return SK.latest_snapshot(snaps).select("meeting_id", F.col("date").cast("string").alias("date"))


register("s14_latest_snapshot", with_enriched("""
SELECT meeting_id, date FROM (
  SELECT meeting_id, '2026-11-30' AS date FROM enriched WHERE month < '2000-01'
  UNION ALL SELECT meeting_id, '2026-12-01' FROM enriched)
WHERE date = (SELECT max(d) FROM (SELECT '2026-12-01' AS d UNION ALL SELECT '2026-11-30'))"""))(latest_snapshot)

register("s15_escalation_notices", with_enriched("""
SELECT meeting_id, title, category, escalation_team AS team, escalation_priority AS priority,
       concat('Escalation: ', meeting_id) AS subject FROM enriched WHERE has_pagerduty"""))(
    lambda spark, sf: SK.escalation_notices(enriched(spark, sf)))
register("s16_pipeline_counters", with_enriched("SELECT call_type, count(*) AS processed FROM enriched GROUP BY call_type"))(
    lambda spark, sf: SK.pipeline_counters(enriched(spark, sf)))


# --- Feedback: D-28 validation, J-07 accept, W-05 latest, J-08 apply -----------------------------
def feedback_submissions(e: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")

    def sub(df, mid, days, cat, ct, label, note):
        return df.select(mid.alias("meeting_id"), _plus_days(days).alias("submitted_at"), cat.alias("corrected_category"),
                         ct.alias("corrected_call_type"), label.alias("corrected_sentiment_label"), F.lit(note).alias("notes"))

    low_conf = e.filter(F.col("category_level") == 3)
    return (sub(low_conf, F.col("meeting_id"), 2, F.col("topic_category"), null, null, "reclassified")
            .unionByName(sub(low_conf.filter(F.col("is_anomaly")), F.col("meeting_id"), 5, F.lit("Other"), null, null, "second look"))
            .unionByName(sub(e.filter(F.col("is_anomaly") & (F.col("sentiment_label") == "mixed")), F.col("meeting_id"), 3,
                             null, null, F.lit("negative"), "tone"))
            .unionByName(sub(e.filter((F.col("category_level") == 0) & (F.col("call_type") == "internal")), F.col("meeting_id"),
                             1, null, F.lit("unknown"), null, "bad type"))
            .unionByName(sub(e.filter(F.coalesce(F.col("title"), F.lit("")) == ""), F.col("meeting_id"), 4, null, null, null, "empty"))
            .unionByName(sub(e.filter(F.col("category") == "Compliance & Audit"), F.concat(F.col("meeting_id"), F.lit("-x")), 1,
                             F.lit("Other"), null, null, "unknown id")))


_FEEDBACK_SQL = """
feedback AS (
  SELECT meeting_id, start_time + INTERVAL 2 DAY AS submitted_at, topic_category AS corrected_category,
         NULL::VARCHAR AS corrected_call_type, NULL::VARCHAR AS corrected_sentiment_label, 'reclassified' AS notes
  FROM enriched WHERE category_level = 3
  UNION ALL SELECT meeting_id, start_time + INTERVAL 5 DAY, 'Other', NULL, NULL, 'second look' FROM enriched WHERE category_level = 3 AND is_anomaly
  UNION ALL SELECT meeting_id, start_time + INTERVAL 3 DAY, NULL, NULL, 'negative', 'tone' FROM enriched WHERE is_anomaly AND sentiment_label = 'mixed'
  UNION ALL SELECT meeting_id, start_time + INTERVAL 1 DAY, NULL, 'unknown', NULL, 'bad type' FROM enriched WHERE category_level = 0 AND call_type = 'internal'
  UNION ALL SELECT meeting_id, start_time + INTERVAL 4 DAY, NULL, NULL, NULL, 'empty' FROM enriched WHERE coalesce(title, '') = ''
  UNION ALL SELECT meeting_id || '-x', start_time + INTERVAL 1 DAY, 'Other', NULL, NULL, 'unknown id' FROM enriched WHERE category = 'Compliance & Audit'),
validated AS (
  SELECT *, CASE WHEN coalesce(meeting_id, '') = '' THEN 'meeting_id is required'
    WHEN coalesce(corrected_call_type, '') <> '' AND corrected_call_type NOT IN ('support', 'external', 'internal')
      THEN 'corrected_call_type must be one of [''external'', ''internal'', ''support'']'
    WHEN coalesce(corrected_sentiment_label, '') <> '' AND corrected_sentiment_label NOT IN ('positive', 'mixed-positive', 'mixed', 'mixed-negative', 'negative')
      THEN 'corrected_sentiment_label must be one of [''mixed'', ''mixed-negative'', ''mixed-positive'', ''negative'', ''positive'']'
    WHEN coalesce(corrected_category, '') = '' AND coalesce(corrected_call_type, '') = '' AND coalesce(corrected_sentiment_label, '') = ''
      THEN 'at least one correction field is required' END AS error
  FROM feedback),
accepted AS (
  SELECT v.meeting_id, v.submitted_at, v.corrected_category, v.corrected_call_type, v.corrected_sentiment_label, v.notes,
         e.category AS original_category, e.call_type AS original_call_type, e.title,
         coalesce(v.error, CASE WHEN e.meeting_id IS NULL THEN 'meeting ' || v.meeting_id || ' not found' END) AS error
  FROM validated v LEFT JOIN enriched e ON e.meeting_id = v.meeting_id),
latest AS (
  SELECT meeting_id, max({'t': submitted_at, 'v': corrected_category}) FILTER (WHERE coalesce(corrected_category, '') <> '').v AS corrected_category,
         max({'t': submitted_at, 'v': corrected_call_type}) FILTER (WHERE coalesce(corrected_call_type, '') <> '').v AS corrected_call_type,
         max({'t': submitted_at, 'v': corrected_sentiment_label}) FILTER (WHERE coalesce(corrected_sentiment_label, '') <> '').v AS corrected_sentiment_label, max(submitted_at) AS submitted_at
  FROM accepted WHERE error IS NULL GROUP BY meeting_id)"""


def _accepted(spark, sf):
    e = enriched(spark, sf)
    return FB.accept(feedback_submissions(e), e)


register("d28_feedback_validation", with_enriched(
    f"SELECT meeting_id, notes, strftime(submitted_at, {TS_SQL}) AS submitted_at, error FROM validated", _FEEDBACK_SQL))(
    lambda spark, sf: feedback_submissions(enriched(spark, sf)).withColumn("error", FB.validation_error())
    .select("meeting_id", "notes", _ts("submitted_at").alias("submitted_at"), "error"))
register("j07_feedback_accept", with_enriched(f"""
SELECT meeting_id, strftime(submitted_at, {TS_SQL}) AS submitted_at, original_category, original_call_type, error
FROM accepted""", _FEEDBACK_SQL))(
    lambda spark, sf: _accepted(spark, sf).select("meeting_id", _ts("submitted_at").alias("submitted_at"),
                                                  "original_category", "original_call_type", "error"))
register("w05_latest_feedback", with_enriched(f"""
SELECT meeting_id, corrected_category, corrected_call_type, corrected_sentiment_label,
       strftime(submitted_at, {TS_SQL}) AS submitted_at FROM latest""", _FEEDBACK_SQL))(
    lambda spark, sf: FB.latest_corrections(_accepted(spark, sf)).withColumn("submitted_at", _ts("submitted_at")))
register("j08_apply_corrections", with_enriched("""
SELECT e.meeting_id, coalesce(nullif(l.corrected_category, ''), e.category) AS category,
       coalesce(nullif(l.corrected_call_type, ''), e.call_type) AS call_type,
       coalesce(nullif(l.corrected_sentiment_label, ''), e.sentiment_label) AS sentiment_label,
       l.submitted_at IS NOT NULL AS corrected
FROM enriched e LEFT JOIN latest l ON l.meeting_id = e.meeting_id""", _FEEDBACK_SQL))(
    lambda spark, sf: FB.apply_corrections(
        enriched(spark, sf).select("meeting_id", "category", "call_type", "sentiment_label"),
        FB.latest_corrections(_accepted(spark, sf))))


# --- S-02 / S-03: ids from object keys, trigger-file filter; J-01: six-part key join -------------
from colloquy.sources.raw_json import PARTS, meeting_id_from_path  # noqa: E402


def object_keys(e: DataFrame) -> DataFrame:
    """Every meeting's six raw part keys plus its processed output key (derived from the data)."""
    keys = F.array(*[F.concat(F.lit("raw/"), F.col("meeting_id"), F.lit(f"/{p}.json")) for p in PARTS],
                   F.concat(F.lit("processed/"), F.col("meeting_id"), F.lit("/sanitized.json")))
    return e.select(F.explode(keys).alias("key"))


def trigger_ids(spark, sf):
    """S-03 prefix + suffix filter (raw/ ... meeting-info.json), then S-02 id from the key."""
    k = object_keys(enriched(spark, sf))
    trig = k.filter(F.col("key").startswith("raw/") & F.col("key").endswith("meeting-info.json"))
    return trig.select("key", meeting_id_from_path(F.col("key")).alias("meeting_id"))


_KEYS_SQL = ("keys AS (SELECT unnest([" + ", ".join(f"concat('raw/', meeting_id, '/{p}.json')" for p in PARTS)
             + ", concat('processed/', meeting_id, '/sanitized.json')]) AS key FROM enriched)")
register("s03_trigger_key_filter", with_enriched("""
SELECT key, CASE WHEN len(string_split(key, '/')) >= 2 THEN string_split(key, '/')[-2] ELSE key END AS meeting_id
FROM keys WHERE starts_with(key, 'raw/') AND ends_with(key, 'meeting-info.json')""", _KEYS_SQL))(trigger_ids)
register("s02_meeting_id_from_key", with_enriched("""
SELECT key, CASE WHEN len(string_split(key, '/')) >= 2 THEN string_split(key, '/')[-2] ELSE key END AS meeting_id
FROM keys""", _KEYS_SQL))(
    lambda spark, sf: object_keys(enriched(spark, sf)).select("key", meeting_id_from_path(F.col("key")).alias("meeting_id")))


def six_part_join(spark, sf):
    """J-01: six per-meeting parts joined 1:1 on the id, left outer from meeting-info; a part
    missing for a meeting is NULL.  Parts are derived from the data (a part exists when the
    meeting has the content it would hold)."""
    e = enriched(spark, sf)
    info = e.select("meeting_id", "title")
    parts = {
        "summary": e.filter(F.col("sentiment_score").isNotNull()).select("meeting_id", F.col("summary_short").alias("summary")),
        "transcript": e.filter(F.col("n_key_moments") > 0).select("meeting_id", F.col("n_key_moments").alias("transcript")),
        "speaker_meta": e.filter(F.col("n_attendees") > 1).select("meeting_id", F.col("n_attendees").alias("speaker_meta")),
        "speakers": e.filter(F.col("n_attendees") > 2).select("meeting_id", F.col("account").alias("speakers")),
        "events": e.filter(F.col("n_actions") > 0).select("meeting_id", F.col("n_actions").alias("events")),
    }
    j = info
    for p in parts.values():
        j = j.join(p, "meeting_id", "left")
    loaded = sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(1))
    return j.select("meeting_id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in parts], loaded.alias("files_loaded"))


register("j01_six_part_join", with_enriched("""
SELECT i.meeting_id, s.meeting_id IS NOT NULL AS has_summary, t.meeting_id IS NOT NULL AS has_transcript,
       m.meeting_id IS NOT NULL AS has_speaker_meta, p.meeting_id IS NOT NULL AS has_speakers, v.meeting_id IS NOT NULL AS has_events,
       1 + CAST(s.meeting_id IS NOT NULL AS INTEGER) + CAST(t.meeting_id IS NOT NULL AS INTEGER) + CAST(m.meeting_id IS NOT NULL AS INTEGER)
         + CAST(p.meeting_id IS NOT NULL AS INTEGER) + CAST(v.meeting_id IS NOT NULL AS INTEGER) AS files_loaded
FROM enriched i
LEFT JOIN (SELECT meeting_id FROM enriched WHERE sentiment_score IS NOT NULL) s ON s.meeting_id = i.meeting_id
LEFT JOIN (SELECT meeting_id FROM enriched WHERE n_key_moments > 0) t ON t.meeting_id = i.meeting_id
LEFT JOIN (SELECT meeting_id FROM enriched WHERE n_attendees > 1) m ON m.meeting_id = i.meeting_id
LEFT JOIN (SELECT meeting_id FROM enriched WHERE n_attendees > 2) p ON p.meeting_id = i.meeting_id
LEFT JOIN (SELECT meeting_id FROM enriched WHERE n_actions > 0) v ON v.meeting_id = i.meeting_id"""))(six_part_join)
