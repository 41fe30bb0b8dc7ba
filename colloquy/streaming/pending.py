"""Meetings whose parts arrive one by one: held in keyed state until complete, retried, dead-lettered, repaired.

Every part file is one row of the stream.  Per meeting the state holds the valid parts, the parts
that do not parse, the tries, a status and a timer.  The state is keyed by buckets of meetings (by a hash
of the id): a call of Python then takes all meetings of a bucket that a delivery brings, where a call for each
meeting costs far more than the step itself.  A bucket's timer is the earliest of its meetings'.

* waiting   until the trigger part is seen and all required parts are valid; then one ``complete``
            event carries all parts.
* retry     while something is missing after the trigger part came, a timer fires every
            ``retry_ms``; each firing is a try.  The ``MAX_TRIES``-th puts the meeting to ``dead``:
            an event with the reason, for the dead letters.
* repaired  a part that completes a dead meeting, or that changes a complete one, gives an event
            with all parts again; the sink overwrites the record and takes back the dead letter.

A part delivered twice with the same content changes nothing.  Spark's file source takes a path
once: a part that is overwritten in place is not seen again, one that comes late is.  ``keep_ms`` after a meeting was
complete or dead its state goes; a part that comes later starts anew.  Timers are in processing
time: they fire on later micro-batches, after a restart too, since state and timers are in the
checkpoint.

The sink stores everything through keyed tables under one root, numbered by the micro-batch, so a
replayed batch writes the same rows again: redacted records, the redacted parts, the vault, lineage,
notices, dead letters and counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.keyed import KeyedTable
from colloquy.operators.records import RECORD_COLUMNS, enrich
from colloquy.operators.redaction import MATCH_COLUMN, redact_record, sanitize, vault_rows
from colloquy.operators.sinks import escalation_notices, lineage_events
from colloquy.sources.raw_json import INFO_SCHEMA, PARTS, SUMMARY_SCHEMA, meeting_id_from_path, to_meetings_raw
from colloquy.streaming.windows import data_batches_only

TRIGGER, REQUIRED, MAX_TRIES = "meeting-info", ("meeting-info", "summary"), 3
RETRY_MS, KEEP_MS = 60_000, 86_400_000
EVENT = "meeting_id string, event string, tries int, reason string, parts map<string,string>, at timestamp"
#: State of a bucket: per meeting the valid parts, those that do not parse, tries, status and when its timer is due; JSON, packed.
STATE = "size long, meetings binary"
BUCKETS = 4096


def part_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """One row per part file: meeting_id, part, body, valid (it parses as JSON)."""
    files = (spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", max_files_per_trigger)
             .text(f"{root.rstrip('/')}/*/*.json"))
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    return with_validity(files.select(meeting_id_from_path(path).alias("meeting_id"), name.alias("part"), F.col("value").alias("body"))
                         .where(F.col("part").isin(*PARTS)))


def with_validity(parts: DataFrame) -> DataFrame:
    """Adds ``valid``: the body is one JSON object."""
    return parts.withColumn("valid", F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False)))


def _advance(parts: dict, bad: dict, rows: list) -> bool:
    """Take the parts of one delivery; whether a valid part is new or differs."""
    changed = False
    for part, body, valid in rows:
        if valid:
            changed |= parts.get(part) != body
            parts[part] = body
            bad.pop(part, None)
        elif part not in parts:
            bad[part] = "does not parse"
    return changed


def _lacking(parts: dict, bad: dict) -> str:
    return ", ".join(f"{p} {bad.get(p, 'is missing')}" for p in REQUIRED if p not in parts)


def _packed(meetings: dict) -> tuple[int, bytes]:
    raw = json.dumps(meetings, ensure_ascii=False, separators=(",", ":")).encode()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(size: int, held: bytes) -> dict:
    return json.loads(pa.decompress(held, decompressed_size=size, codec="zstd", asbytes=True))


def track(parts: DataFrame, retry_ms: int = RETRY_MS, keep_ms: int = KEEP_MS, max_tries: int = MAX_TRIES, buckets: int = BUCKETS) -> DataFrame:
    """Events (complete, retry, dead, repaired) of a stream of parts.  ``buckets``, like the shuffle partitions, holds for the life of a checkpoint."""

    def timer(held: dict, bad: dict, status: str, now: int) -> int | None:
        if status != "waiting":
            return now + keep_ms
        return now + retry_ms if TRIGGER in held or bad else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        meetings = _unpacked(*state.get) if state.exists else {}
        delivered: dict = {}
        if not state.hasTimedOut:
            for b in batches:
                for meeting, *row in zip(b["meeting_id"], b["part"], b["body"], b["valid"]):
                    delivered.setdefault(meeting, []).append(tuple(row))
        events = []
        for meeting, rows in delivered.items():
            held, bad, tries, status, _ = meetings.get(meeting) or ({}, {}, 0, "waiting", None)
            changed = _advance(held, bad, sorted(rows, key=str) if len(rows) > 1 else rows)
            if changed and not _lacking(held, bad):
                event, status = ("complete" if status == "waiting" else "repaired"), "complete"
                events.append((meeting, event, tries, "", held))
            meetings[meeting] = (held, bad, tries, status, timer(held, bad, status, now))
        for meeting in [m for m, (*_, due) in meetings.items() if due is not None and due < now and m not in delivered]:
            held, bad, tries, status, _ = meetings[meeting]
            if status != "waiting":
                del meetings[meeting]
                continue
            tries += 1
            event = "dead" if tries >= max_tries else "retry"
            status = "dead" if tries >= max_tries else status
            events.append((meeting, event, tries, _lacking(held, bad), held if event != "retry" else {}))
            meetings[meeting] = (held, bad, tries, status, timer(held, bad, status, now))
        if not meetings:
            state.remove()
        else:
            state.update(_packed(meetings))
            if due := [d for *_, d in meetings.values() if d is not None]:
                state.setTimeoutDuration(max(1, min(due) - now))
        if events:
            at = pd.Timestamp.now(tz="UTC").tz_localize(None)
            yield pd.DataFrame(events, columns=["meeting_id", "event", "tries", "reason", "parts"]).assign(at=at)

    bucket = F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = parts.where(F.col("meeting_id").isNotNull()).select(bucket, "meeting_id", "part", "body", "valid")
    return rows.groupBy("bucket").applyInPandasWithState(step, EVENT, STATE, "update", "ProcessingTimeTimeout")


def _of(part: str, schema: T.StructType) -> Column:
    return F.from_json(F.col("parts")[part], schema, {"columnNameOfCorruptRecord": "_corrupt_record"})


def meetings_of(events: DataFrame) -> DataFrame:
    """meetings_raw rows of the events that carry all required parts."""
    full = events.where(F.col("event").isin("complete", "repaired"))
    info = full.select("meeting_id", _of("meeting-info", INFO_SCHEMA).alias("i")).select("meeting_id", "i.*")
    summary = full.select("meeting_id", _of("summary", SUMMARY_SCHEMA).alias("s")).select("meeting_id", "s.*")
    return to_meetings_raw(info, summary).drop("info_corrupt")


class MeetingStore:
    """The keyed tables of the ingest under one root."""

    KEYS = {"records": ["meeting_id"], "documents": ["meeting_id"], "vault": ["source_id", "placeholder"], "lineage": ["meeting_id", "stage"],
            "notices": ["meeting_id"], "dead_letters": ["meeting_id"], "counters": ["batch_id", "call_type"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, schema: T.StructType) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", self.KEYS[name], schema)

    def read(self, name: str) -> DataFrame:
        """The current rows of a table; its schema is in its files."""
        files = f"{self.root}/{name}/data"
        stored = self.spark.read.parquet(f"{files}/*").schema
        return self.table(name, T.StructType([f for f in stored.fields if not f.name.startswith("_")])).view()

    def _put(self, name: str, rows: DataFrame, batch_id: int, order: list | None = None) -> None:
        t = self.table(name, rows.schema)
        t.upsert(rows, batch_id + 1, order)
        if batch_id % 8 == 7:
            t.compact()

    def store(self, events: DataFrame, batch_id: int) -> None:
        """foreachBatch body: everything that a batch of events gives, each table in one write."""
        events = events.where("event != 'retry'").persist()
        try:
            kinds = {r["event"] for r in events.select("event").distinct().collect()}
            if kinds & {"complete", "repaired"}:
                self._store_meetings(events, batch_id)
            if kinds & {"dead", "repaired"}:
                letters = events.where(F.col("event").isin("dead", "repaired")).select(
                    "meeting_id", "event", "tries", "reason", F.map_keys("parts").alias("parts_held"), "at")
                self._put("dead_letters", letters, batch_id)
        finally:
            events.unpersist()

    def _staged(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Written and read again: what follows plans from a file scan, not from the rule chains."""
        path = f"{self.root}/staging/{name}-{batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _store_meetings(self, events: DataFrame, batch_id: int) -> None:
        clean = self._staged(sanitize(meetings_of(events)), "sanitized", batch_id)
        full = self._staged(enrich(clean.drop(MATCH_COLUMN)), "enriched", batch_id)
        records = full.select(*RECORD_COLUMNS)
        self._put("vault", vault_rows(clean), batch_id)
        self._put("documents", self._staged(self.documents(events), "documents", batch_id), batch_id)
        now = F.current_timestamp()
        self._put("lineage", lineage_events(full, "ingestion", now).unionByName(lineage_events(full, "analysis", now)), batch_id)
        self._put("notices", escalation_notices(records), batch_id)
        counters = records.groupBy("call_type").agg(F.count(F.lit(1)).alias("processed"), F.count_if("is_anomaly").alias("anomalies"),
                                                    F.count_if("has_pagerduty").alias("paged"))
        self._put("counters", counters.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id)
        self._put("records", records, batch_id)  # last: a record says that the rest is stored
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/staging")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    @staticmethod
    def documents(events: DataFrame) -> DataFrame:
        """S-07: the redacted parts of each meeting, as text."""
        full = events.where(F.col("event").isin("complete", "repaired"))
        texts = F.array(*[F.col("parts")[p] for p in PARTS])  # one pattern chain for all parts
        clean = redact_record(full.select("meeting_id", texts.alias("texts")), ["texts"])
        return clean.select("meeting_id", *[F.get("texts", i).alias(p.replace("-", "_")) for i, p in enumerate(PARTS)], "n_pii_redacted")

    def dead_letters(self) -> DataFrame:
        """Meetings that failed and were not repaired since."""
        return self.read("dead_letters").where("event = 'dead'")

    def alarm(self, at_least: int = 1) -> DataFrame:
        """Depth of the dead letters, and whether that is an alarm."""
        return self.dead_letters().agg(F.count(F.lit(1)).alias("depth")).withColumn("alarm", F.col("depth") >= at_least)


def start(spark: SparkSession, parts: DataFrame, store: MeetingStore, checkpoint: str, retry_ms: int = RETRY_MS, keep_ms: int = KEEP_MS,
          available_now: bool = False, interval: str = "30 seconds"):
    """Start the ingest.  ``available_now`` takes what is there and stops: timers then wait for the next start."""
    w = track(parts, retry_ms, keep_ms).writeStream.outputMode("update").foreachBatch(store.store).option("checkpointLocation", checkpoint)
    if not available_now:
        return w.trigger(processingTime=interval).start()
    with data_batches_only(spark):
        return w.trigger(availableNow=True).start()
