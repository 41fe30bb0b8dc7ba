"""Streams over the given tables, run to their end (ST-04, event-time KPIs, a stream-stream join)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.gold import SPLIT_BYTES
from colloquy.plans import register
from colloquy.plans.sqlgen import meetings_ctes
from colloquy.session import bounded_tasks, ensure_checkpoint_dir
from colloquy.sources.meetings import meetings_raw, n_tasks
from colloquy.streaming import pending, windows

TS = "yyyy-MM-dd HH:mm:ss"
#: Files (of about ``SPLIT_BYTES`` each) of one micro-batch.
BATCH_FILES = 100
#: Buckets of the keyed state for each task's ``MEETINGS_PER_TASK`` meetings, so that a bucket does not grow with the input.
BUCKETS_PER_TASK = 32


def sliding_kpi(spark, sf) -> DataFrame:
    """Daily windows, every six hours, per event type."""
    stream = windows.sliding_kpi(windows.table_stream(spark, f"{sf}/events.parquet"), "ts", ["event_type"], "value", "1 day", "6 hours", "2 hours")
    out = windows.collected(stream, "sliding-kpi", ["window", "event_type"])
    return out.select(F.date_format("window.start", TS).alias("window_start"), "event_type", "n", "sum_h", "low", "high")


register("st07_sliding_kpi", """
SELECT strftime(make_timestamp((CAST(floor(epoch(ts) / 21600) AS BIGINT) - k) * 21600000000), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_h, min(value) AS low, max(value) AS high
FROM events, (SELECT unnest(range(4)) AS k) GROUP BY ALL""")(sliding_kpi)


def followed_within(spark, sf) -> DataFrame:
    """Views followed by an error of the same user within the hour, as a join of two streams; per user."""
    events = windows.table_stream(spark, f"{sf}/events.parquet")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"))
    pairs = windows.collected(windows.interval_join(views, errors, "user_id", "view_ts", "error_ts", "1 HOUR", "30 minutes"), "view-error")
    gap = F.unix_micros("error_ts") - F.unix_micros("view_ts")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(gap).alias("gap_us"))


register("st08_view_then_error", """
SELECT v.user_id, count(*) AS n_pairs, CAST(sum(epoch_us(e.ts) - epoch_us(v.ts)) AS BIGINT) AS gap_us
FROM events v JOIN events e ON v.user_id = e.user_id AND v.event_type = 'view' AND e.event_type = 'error'
     AND e.ts >= v.ts AND e.ts <= v.ts + INTERVAL 1 HOUR GROUP BY v.user_id""")(followed_within)


def parts_of(spark, sf) -> DataFrame:
    """Part rows of the meetings: every 11th has no summary, every 13th a summary that does not parse."""
    m = meetings_raw(spark, sf)
    info = F.to_json(F.struct("title", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("startTime"),
                              F.col("duration_min").alias("durationMinutes"), "attendees"))
    summary = F.to_json(F.struct(F.col("sentiment_score").alias("sentimentScore"), F.col("sentiment_label").alias("overallSentiment"), "topics",
                                 F.col("key_moments").alias("keyMoments"), F.col("action_items").alias("actionItems"), "summary"))
    broken = F.when(F.col("k") % 13 == 0, F.lit("{")).otherwise(summary)
    one = F.struct(F.lit("meeting-info").alias("part"), info.alias("body"))
    two = F.struct(F.lit("summary").alias("part"), broken.alias("body"))
    return m.select("meeting_id", F.explode(F.when(F.col("k") % 11 == 0, F.array(one)).otherwise(F.array(two, one))).alias("p")).select("meeting_id", "p.*")


def complete_meetings(spark, sf) -> DataFrame:
    """Meetings that the keyed state completes from a stream of parts, summaries and infos in batches of their own."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/parts-{uuid.uuid4().hex}"
    n = n_tasks(spark, sf)
    rows = pending.with_validity(parts_of(spark, sf))
    files = 0
    with bounded_tasks(spark, n, SPLIT_BYTES):
        rows.write.partitionBy("part").parquet(f"{root}-made")  # the meetings are built once for both parts
        made = spark.read.schema(rows.schema).parquet(f"{root}-made").select(*rows.columns)
        for part in ("summary", "meeting-info"):
            made.where(F.col("part") == part).write.mode("append").parquet(root)
            files = files or len(spark.read.parquet(root).inputFiles())
        # a part's files in one batch, or as many as make some million rows: every batch costs a commit of all state
        stream = windows.table_stream(spark, root, max_files_per_trigger=min(files, BATCH_FILES))
        events = pending.track(stream, buckets=n * BUCKETS_PER_TASK)
        done = windows.collected(events, "complete-meetings", mode="update", timers=True).where(F.col("event").isin("complete", "repaired"))
    m = pending.meetings_of(done)
    return m.select("meeting_id", "title", F.date_format("start_time", TS).alias("start"), "sentiment_score", F.array_join("topics", "|").alias("topics"), "summary",
                    F.size("key_moments").alias("n_moments"))


register("st04_complete_meetings", f"WITH {meetings_ctes()}" + """
SELECT meeting_id, title, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start, sentiment_score, array_to_string(topics, '|') AS topics, summary,
       CAST(len(key_moments) AS INTEGER) AS n_moments
FROM meetings_plain WHERE k % 11 <> 0 AND k % 13 <> 0""")(complete_meetings)
