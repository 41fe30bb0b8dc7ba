"""As-of joins and trailing frames (J-07 against the record version of the time, event frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import timeline as TL
from colloquy.operators.records import enriched
from colloquy.plans import register
from colloquy.plans.sqlgen import with_enriched
from colloquy.sources.tables import table


def feedback_as_of(spark, sf) -> DataFrame:
    """Feedback on every meeting, up to two days after it, with the version of the record that was
    valid then: anomalies are processed again after a day."""
    e = enriched(spark, sf)
    first = e.select("meeting_id", F.col("start_time").alias("valid_from"), F.lit(1).alias("version"), F.col("call_type").alias("seen_type"))
    second = e.where("is_anomaly").select("meeting_id", F.timestamp_add("DAY", F.lit(1), F.col("start_time")).alias("valid_from"),
                                          F.lit(2).alias("version"), F.concat("call_type", F.lit("*")).alias("seen_type"))
    feedback = e.select("meeting_id", F.timestamp_add("HOUR", (F.col("k") % 49 - 1).cast("int"), F.col("start_time")).alias("submitted"))
    out = TL.asof_join(feedback, first.unionByName(second), ["meeting_id"], "submitted", "valid_from", ["version", "seen_type"])
    return out.select("meeting_id", "version", "seen_type")


register("j07b_feedback_as_of_version", with_enriched("""
SELECT f.meeting_id, v.version, v.seen_type
FROM (SELECT meeting_id, start_time + INTERVAL 1 HOUR * (k % 49 - 1) AS submitted FROM enriched) f
ASOF LEFT JOIN (SELECT meeting_id, start_time AS valid_from, 1 AS version, call_type AS seen_type FROM enriched
                UNION ALL SELECT meeting_id, start_time + INTERVAL 1 DAY, 2, call_type || '*' FROM enriched WHERE is_anomaly) v
ON f.meeting_id = v.meeting_id AND f.submitted >= v.valid_from"""))(feedback_as_of)


def error_after_view(spark, sf) -> DataFrame:
    """Every error event with the last view of its user."""
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return TL.asof_join(errors, views, ["user_id"], "ts", "view_ts", ["view_id"], order=["view_id"]).select("event_id", "user_id", "view_id")


register("j16_error_after_view", """
SELECT e.event_id, e.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")(error_after_view)


def trailing_events(spark, sf) -> DataFrame:
    """Events and their value in hundredths per user over the three days up to each event."""
    events = table(spark, sf, "events")
    sums = TL.trailing(events, ["user_id"], "ts", {"n": F.lit(1), "sum_h": F.round(F.col("value") * 100).cast("long")}, "3 DAYS")
    return events.select("event_id", "user_id", "ts").join(sums, ["user_id", "ts"]).select("event_id", "user_id", "n", "sum_h")


register("w06_trailing_events", """
SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS sum_h
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)""")(trailing_events)
