"""Raw JSON reader and the streaming ingest: quarantine, idempotence, stream == batch."""
import json
import os

from pyspark.sql import functions as F

from colloquy.operators.records import RECORD_COLUMNS, enrich
from colloquy.operators.redaction import sanitize_meetings
from colloquy.sources.raw_json import INFO_SCHEMA, meeting_id_from_path, read_meetings
from colloquy.streaming.ingest import process_batch, running_kpi_stream, start_ingest
from colloquy.sources.meetings import meetings_raw
from tests.conftest import SF_SMALL


def write_raw(spark, root, n=40):
    """Raw six-file layout (info + summary parts) for meetings derived from the tables."""
    rows = meetings_raw(spark, SF_SMALL).orderBy("k").limit(n).collect()
    for r in rows:
        d = os.path.join(root, r["meeting_id"])
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "meeting-info.json"), "w") as f:
            json.dump({"meetingId": r["meeting_id"], "title": r["title"],
                       "startTime": r["start_time"].strftime("%Y-%m-%dT%H:%M:%S"),
                       "durationMinutes": r["duration_min"], "attendees": list(r["attendees"])}, f)
        with open(os.path.join(d, "summary.json"), "w") as f:
            json.dump({"sentimentScore": r["sentiment_score"], "overallSentiment": r["sentiment_label"],
                       "topics": list(r["topics"]), "summary": r["summary"],
                       "keyMoments": [{"text": m["text"], "type": m["type"]} for m in r["key_moments"]],
                       "actionItems": list(r["action_items"])}, f)
    bad = os.path.join(root, "broken")
    os.makedirs(bad, exist_ok=True)
    with open(os.path.join(bad, "meeting-info.json"), "w") as f:
        f.write("{not json")
    return len(rows)


def test_reader_and_quarantine(spark, scratch):
    root = os.path.join(scratch, "raw")
    n = write_raw(spark, root)
    good, bad = read_meetings(spark, root)
    assert good.count() == n and bad.count() == 1
    assert good.filter(F.size("key_moments") > 0).count() > 0


def test_stream_is_idempotent_and_equals_batch(spark, scratch):
    root = os.path.join(scratch, "raw")
    n = write_raw(spark, root)
    rec, quar, ck = (os.path.join(scratch, x) for x in ("records", "quarantine", "ckpt"))
    start_ingest(spark, root, rec, quar, ck, available_now=True, max_files_per_trigger=7).awaitTermination()
    # at-least-once delivery: the same micro-batch handed to the sink again stores nothing new
    info = spark.read.schema(INFO_SCHEMA).option("multiLine", "true").json(f"{root}/*/meeting-info.json") \
        .withColumn("meeting_id", meeting_id_from_path(F.col("_metadata.file_path")))
    process_batch(info, 99, root, rec, quar)
    start_ingest(spark, root, rec, quar, ck, available_now=True).awaitTermination()
    stored = spark.read.parquet(rec)
    assert stored.count() == n == stored.select("meeting_id").distinct().count()
    assert spark.read.parquet(quar).count() >= 1
    good, _ = read_meetings(spark, root)
    batch = enrich(sanitize_meetings(good)[0].drop("n_pii_redacted")).select(*RECORD_COLUMNS)
    cols = [c for c in RECORD_COLUMNS if c not in ("processed_at",)]
    assert sorted(map(tuple, stored.select(*cols).drop("issues").collect())) == \
        sorted(map(tuple, batch.select(*cols).drop("issues").collect()))


def test_running_kpi_stream(spark, scratch):
    root = os.path.join(scratch, "raw")
    write_raw(spark, root)
    rec, quar, ck = (os.path.join(scratch, x) for x in ("records", "quarantine", "ckpt"))
    start_ingest(spark, root, rec, quar, ck, available_now=True).awaitTermination()
    stream = spark.readStream.schema(spark.read.parquet(rec).schema).parquet(rec)
    q = (running_kpi_stream(stream).writeStream.format("memory").queryName("kpi_test").outputMode("complete")
         .trigger(availableNow=True).option("checkpointLocation", os.path.join(scratch, "ck2")).start())
    q.awaitTermination()
    got = spark.sql("SELECT sum(n) AS n FROM kpi_test").collect()[0]["n"]
    assert got == spark.read.parquet(rec).count()


def test_stream_redacts_before_classifying(spark, scratch):
    root = os.path.join(scratch, "raw")
    d = os.path.join(root, "pii1")
    os.makedirs(d)
    with open(os.path.join(d, "meeting-info.json"), "w") as f:
        json.dump({"title": "Support Case #7 - call 415-555-0199 re outage", "startTime": "2026-03-10T09:00:00Z"}, f)
    with open(os.path.join(d, "summary.json"), "w") as f:
        json.dump({"sentimentScore": 2.0, "overallSentiment": "negative", "topics": ["outage"],
                   "summary": "Customer jane@corp.example reports the dashboards are down."}, f)
    rec, quar, ck, vault = (os.path.join(scratch, x) for x in ("records", "quarantine", "ckpt", "vault"))
    start_ingest(spark, root, rec, quar, ck, available_now=True, vault_path=vault).awaitTermination()
    row = spark.read.parquet(rec).collect()[0]
    assert "415-555-0199" not in row["title"] and "[PHONE_" in row["title"]
    assert row["call_type"] == "support" and row["severity" if "severity" in row else "escalation_priority"] == "p0"
    originals = {r["original"] for r in spark.read.parquet(vault).collect()}
    assert {"jane@corp.example"} <= originals and any("415-555-0199" in o for o in originals)
