"""Pending meetings: late parts, three failures, repair, replay, restart; equal to the batch path."""
import json
import os
import time

from pyspark.sql import functions as F

from colloquy.operators.records import RECORD_COLUMNS, enrich
from colloquy.operators.redaction import sanitize_meetings
from colloquy.sources.raw_json import read_meetings
from colloquy.streaming import pending, windows


def put(root, meeting, part, body):
    d = os.path.join(root, meeting)
    os.makedirs(d, exist_ok=True)
    tmp = os.path.join(d, f".{part}.tmp")
    with open(tmp, "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))
    os.rename(tmp, os.path.join(d, f"{part}.json"))


def info(i):
    return {"title": f"Support Case #{i} - call 415-555-01{i:02}", "startTime": "2026-03-10T09:00:00Z", "attendees": [f"p{i}@corp.example"]}


def summary(i):
    return {"sentimentScore": 2.0 + i / 100, "overallSentiment": "mixed", "topics": ["outage"], "summary": f"Mail p{i}@corp.example about the outage."}


class Sink:
    """Events of all micro-batches; a query over it runs until it has what is awaited."""

    def __init__(self, spark, root, checkpoint):
        self.spark, self.root, self.checkpoint, self.events = spark, root, checkpoint, []

    def run_until(self, done, seconds=90):
        parts = pending.part_stream(self.spark, self.root)
        q = (pending.track(parts, retry_ms=200).writeStream.outputMode("update").foreachBatch(lambda df, b: self.events.extend(df.collect()))
             .option("checkpointLocation", self.checkpoint).trigger(processingTime="100 milliseconds").start())
        until = time.time() + seconds
        while not done(self):
            assert q.exception() is None and time.time() < until, q.exception()
            time.sleep(0.2)
        q.stop()

    def of(self, kind):
        return {r["meeting_id"]: r for r in self.events if r["event"] == kind}


def test_late_parts_three_failures_and_restart(spark, scratch):
    root = os.path.join(scratch, "raw")
    for i in range(4):
        put(root, f"m{i}", "meeting-info", info(i))
        if i >= 2:
            put(root, f"m{i}", "summary", summary(i))
    put(root, "bad", "meeting-info", "{not json")
    put(root, "bad", "summary", summary(9))
    put(root, "early", "summary", summary(8))  # no trigger part: waits without tries
    sink = Sink(spark, root, os.path.join(scratch, "ck"))
    sink.run_until(lambda s: len(s.of("dead")) == 3)
    dead = sink.of("dead")
    assert set(sink.of("complete")) == {"m2", "m3"} and set(dead) == {"m0", "m1", "bad"}
    assert dead["bad"]["reason"] == "meeting-info does not parse" and dead["m0"]["reason"] == "summary is missing"
    assert all(r["tries"] == 3 for r in dead.values()) and set(dead["m0"]["parts"]) == {"meeting-info"}
    assert sorted(r["tries"] for r in sink.events if r["event"] == "retry" and r["meeting_id"] == "m0") == [1, 2]
    # restart: the state comes from the checkpoint, late parts repair
    put(root, "m0", "summary", summary(0))
    put(root, "m3", "transcript", {"sentences": []})
    put(root, "early", "meeting-info", info(8))
    sink.run_until(lambda s: set(s.of("repaired")) >= {"m0", "m3"} and "early" in s.of("complete"))
    assert set(sink.of("repaired")) == {"m0", "m3"} and set(sink.of("repaired")["m0"]["parts"]) == {"meeting-info", "summary"}
    assert set(sink.of("repaired")["m3"]["parts"]) == {"meeting-info", "summary", "transcript"}
    assert len([r for r in sink.events if r["meeting_id"] == "m2"]) == 1


def test_the_store_equals_the_batch_path_and_takes_repairs(spark, scratch):
    root = os.path.join(scratch, "raw")
    for i in range(4):
        put(root, f"m{i}", "meeting-info", info(i))
        put(root, f"m{i}", "summary", summary(i))
    store = pending.MeetingStore(spark, os.path.join(scratch, "store"))

    def event(i, kind, score=None, **more):
        parts = {"meeting-info": json.dumps(info(i)), "summary": json.dumps(summary(i if score is None else score))} | more
        return (f"m{i}", kind, 0, "", parts, None)

    first = [event(i, "complete", score=7 if i == 2 else None) for i in range(1, 4)] + [("m0", "dead", 3, "summary is missing", {"meeting-info": "{}"}, None)]
    store.store(spark.createDataFrame(first, pending.EVENT), 0)
    assert tuple(store.alarm().first()) == (1, True)
    second = [event(0, "repaired", transcript=json.dumps({"sentences": [{"text": "write to jane@corp.example"}]})), event(2, "repaired")]
    for _ in range(2):  # the second time is a replay
        store.store(spark.createDataFrame(second, pending.EVENT), 1)
    assert tuple(store.alarm().first()) == (0, False)
    good, _ = read_meetings(spark, root)
    batch = enrich(sanitize_meetings(good)[0].drop("n_pii_redacted")).select(*RECORD_COLUMNS).drop("issues")
    mine = store.read("records").select(*RECORD_COLUMNS).drop("issues")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, batch.collect()))
    # nothing is stored unredacted, originals are in the vault, lineage counts them
    docs = {r["meeting_id"]: r for r in store.read("documents").collect()}
    assert "@" not in docs["m0"]["transcript"] + docs["m0"]["summary"] and "415-555" not in docs["m0"]["meeting_info"]
    assert {"p2@corp.example", "415-555-0102"} <= {r["original"] for r in store.read("vault").where("source_id = 'm2'").collect()}
    lineage = {(r["meeting_id"], r["stage"]): r for r in store.read("lineage").collect()}
    assert len(lineage) == 8 and lineage["m3", "ingestion"]["n_pii_redacted"] == 3
    assert [r["n"] for r in store.read("counters").groupBy("batch_id").agg(F.sum("processed").alias("n")).orderBy("batch_id").collect()] == [3, 2]


def test_steps_of_one_delivery():
    parts, bad = {}, {}
    assert not pending._advance(parts, bad, [("summary", "{", False)]) and pending._lacking(parts, bad) == "meeting-info is missing, summary does not parse"
    assert pending._advance(parts, bad, [("summary", "{}", True), ("meeting-info", "{}", True)]) and not bad and pending._lacking(parts, bad) == ""
    assert not pending._advance(parts, bad, [("summary", "{}", True), ("summary", "{", False)])


def test_state_is_kept_by_buckets_of_meetings(spark, scratch):
    """Python is called for a bucket, not for a meeting; every meeting of it has its own event."""
    root, seen = os.path.join(scratch, "parts"), []
    rows = [(f"m{i}", part, json.dumps(body(i)) if part == "meeting-info" or i % 7 else "{") for part, body in (("summary", summary), ("meeting-info", info)) for i in range(60)]
    for part in ("summary", "meeting-info"):
        df = spark.createDataFrame([r for r in rows if r[1] == part], "meeting_id string, part string, body string")
        pending.with_validity(df).coalesce(1).write.mode("append").parquet(root)
    events = pending.track(windows.table_stream(spark, root, max_files_per_trigger=1), buckets=3)
    with windows.data_batches_only(spark):
        q = (events.writeStream.outputMode("update").foreachBatch(lambda df, b: seen.extend(df.collect())).option("checkpointLocation", os.path.join(scratch, "ck"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    assert {(r["meeting_id"], r["event"]) for r in seen} == {(f"m{i}", "complete") for i in range(60) if i % 7} and len(seen) == 51
    assert {r["meeting_id"]: dict(r["parts"]) for r in seen} == {f"m{i}": {"meeting-info": json.dumps(info(i)), "summary": json.dumps(summary(i))} for i in range(60) if i % 7}
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_meetings_of_one_bucket_have_timers_of_their_own(spark, scratch):
    root = os.path.join(scratch, "raw")
    put(root, "done", "meeting-info", info(1))
    put(root, "done", "summary", summary(1))
    put(root, "late", "meeting-info", info(2))
    put(root, "early", "summary", summary(3))  # no trigger part: no timer
    events, sent = [], set()

    def of(kind):
        return {r["meeting_id"] for r in events if r["event"] == kind}

    q = (pending.track(pending.part_stream(spark, root), retry_ms=200, keep_ms=3000, buckets=1).writeStream.outputMode("update")
         .foreachBatch(lambda df, b: events.extend(df.collect())).option("checkpointLocation", os.path.join(scratch, "ck")).trigger(processingTime="100 milliseconds").start())
    until = time.time() + 90
    while not (of("complete") >= {"done", "early"} and of("repaired") >= {"late"}):
        assert q.exception() is None and time.time() < until, q.exception()
        if "late" in of("dead") and "late" not in sent:
            sent.add("late")
            put(root, "late", "summary", summary(2))
            put(root, "early", "meeting-info", info(3))
        time.sleep(0.1)
    while not q.lastProgress or q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0:  # keep_ms after: the bucket goes with its last meeting
        assert q.exception() is None and time.time() < until, q.exception()
        time.sleep(0.2)
    q.stop()
    assert of("complete") == {"done", "early"} and of("dead") == of("repaired") == {"late"}
    assert sorted(r["tries"] for r in events if r["meeting_id"] == "late") == [1, 2, 3, 3]
    assert [r["reason"] for r in events if r["event"] == "dead"] == ["summary is missing"]
