"""Stored upserts and lookups through keyed tables (S-05, S-08, S-09, S-10), the batch vault (D-03, J-12).

Each query writes its tables under the checkpoint folder from the stored meetings and reads the answer back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import redaction as RD
from colloquy.operators import sinks as SK
from colloquy.operators.keyed import KeyedTable
from colloquy.operators.records import RECORD_COLUMNS, enriched, sanitized, vault
from colloquy.plans import register
from colloquy.plans.q_io import _LINEAGE_SQL, STORED_BEFORE, TS_SQL, _plus_days, _ts
from colloquy.plans.sqlgen import meetings_ctes, with_enriched
from colloquy.session import ensure_checkpoint_dir

LOOKUP_STEP = 50


def _table(spark, name: str, key: list, schema: T.StructType) -> KeyedTable:
    return KeyedTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyed/{name}-{uuid.uuid4().hex}", key, schema)


def _stored_records(spark, sf) -> tuple[KeyedTable, DataFrame]:
    """Records of the months before the cut-off, stored; all records."""
    records = enriched(spark, sf).select(*RECORD_COLUMNS)
    t = _table(spark, "records", ["meeting_id"], records.schema)
    t.upsert(records.where(F.col("month") < STORED_BEFORE), 1)
    return t, records


def insert_into_stored(spark, sf) -> DataFrame:
    t, records = _stored_records(spark, sf)
    return t.insert_if_absent(records, 2)


register("s08b_insert_into_stored", with_enriched(f"""
SELECT meeting_id, CASE WHEN month < '{STORED_BEFORE}' THEN 'duplicate' ELSE 'saved' END AS status FROM enriched"""))(insert_into_stored)


def stored_lookups(spark, sf) -> DataFrame:
    """Every 50th meeting by its number, and as many ids that are not stored."""
    t, records = _stored_records(spark, sf)
    ids = records.select("meeting_id").where(F.col("meeting_id").cast("long") % LOOKUP_STEP == 0)
    keys = ids.unionByName(ids.select(F.concat("meeting_id", F.lit("-x")).alias("meeting_id")))
    return t.lookup(keys).select("meeting_id", "title", "call_type", "category", "z_score", F.size("issues").alias("n_listed"))


register("s05b_stored_lookups", with_enriched(f"""
SELECT meeting_id, title, call_type, category, z_score, CAST(len(issues) AS INTEGER) AS n_listed FROM enriched
WHERE CAST(meeting_id AS BIGINT) % {LOOKUP_STEP} = 0 AND month < '{STORED_BEFORE}'"""))(stored_lookups)


def stored_lineage(spark, sf) -> DataFrame:
    """Ingestion, analysis and reprocessing as three writes, the deletion of untitled meetings as a
    fourth, then a compaction; what the compacted table holds."""
    e = enriched(spark, sf)
    first = SK.lineage_events(e, "ingestion", F.col("start_time"))
    t = _table(spark, "lineage", ["meeting_id", "stage"], first.schema)
    t.upsert(first, 1)
    t.upsert(SK.lineage_events(e, "analysis", F.timestamp_add("HOUR", F.lit(1), F.col("start_time"))), 2)
    t.upsert(SK.lineage_events(e.where("is_anomaly"), "analysis", _plus_days(1), "reprocessed"), 3)
    untitled = e.where(F.coalesce(F.col("title"), F.lit("")) == "").select("meeting_id")
    t.delete(untitled.select("meeting_id", F.explode(F.array(F.lit("ingestion"), F.lit("analysis"))).alias("stage")), 4)
    t.compact(full=True)
    return t.view().select("meeting_id", "stage", _ts(F.col("timestamp")).alias("timestamp"), "status")


register("s09b_stored_lineage", with_enriched(f"""
SELECT meeting_id, stage, strftime(arg_max(ts, ts), {TS_SQL}) AS timestamp, arg_max(status, ts) AS status
FROM lineage WHERE meeting_id NOT IN (SELECT meeting_id FROM enriched WHERE coalesce(title, '') = '')
GROUP BY meeting_id, stage""", _LINEAGE_SQL))(stored_lineage)


def revealed(spark, sf) -> DataFrame:
    """All six text columns of the stored sanitized meetings with their originals from the stored vault."""
    plain = sanitized(spark, sf).select("meeting_id", *RD.MEETING_TEXT_COLUMNS)
    out = RD.reveal_record(plain, vault(spark, sf), RD.MEETING_TEXT_COLUMNS)
    flat = {c: F.array_join(c, "|") for c in ("attendees", "topics", "action_items")}
    flat |= {f"moment_{f}s": F.array_join(F.transform("key_moments", lambda m: m[f]), "|") for f in ("text", "type")}
    return out.select("meeting_id", "title", "summary", *[c.alias(n) for n, c in flat.items()])


register("d03c_reveal_meeting_record", f"WITH {meetings_ctes()}" + """
SELECT meeting_id, title, summary, array_to_string(attendees, '|') AS attendees, array_to_string(topics, '|') AS topics,
       array_to_string(action_items, '|') AS action_items,
       array_to_string(list_transform(key_moments, lambda m: m.text), '|') AS moment_texts,
       array_to_string(list_transform(key_moments, lambda m: m.type), '|') AS moment_types
FROM meetings_plain""")(revealed)
