"""Structured Streaming ingestion of new meetings.

* ST-01  file source on ``root/*/meeting-info.json`` (the trigger file), bounded by
         ``maxFilesPerTrigger`` (one micro-batch ~ one queue batch).
* ST-04  the other parts are looked up per micro-batch by id (exact paths of the
         batch's meetings, so a batch reads only its own files).
* ST-02  at-least-once delivery + idempotent sink: within a batch keep one row per
         id, then append only ids not yet stored (anti join) — re-delivered ids stay single.
* ST-03  rows with a corrupt meeting-info or no id go to a quarantine table.
* D-02   every string leaf is redacted before classification; vault rows are appended.
* ST-05  ``availableNow`` trigger: the nightly batch run over everything not yet seen.
* ST-06  running KPI per (month, call type) as a stateful aggregation.

Checkpoints live under the caller's checkpoint location (shared storage on a cluster),
so a restarted query resumes after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.records import RECORD_COLUMNS, enrich
from colloquy.operators.redaction import sanitize_meetings
from colloquy.operators.sinks import insert_if_absent, stored
from colloquy.sources.raw_json import INFO_SCHEMA, SUMMARY_SCHEMA, meeting_id_from_path, to_meetings_raw


def meeting_info_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(INFO_SCHEMA).option("multiLine", "true")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .json(f"{root.rstrip('/')}/*/meeting-info.json")
            .withColumn("meeting_id", meeting_id_from_path(F.col("_metadata.file_path"))))


def _existing(spark: SparkSession, paths: list) -> list:
    """Paths that exist, via the Hadoop FileSystem API (any store); bounded by the batch size."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        jp = jvm.org.apache.hadoop.fs.Path(p)
        if jp.getFileSystem(conf).exists(jp):
            out.append(p)
    return out


def _summaries_for(spark: SparkSession, root: str, ids: list) -> DataFrame:
    existing = _existing(spark, [f"{root.rstrip('/')}/{i}/summary.json" for i in ids])
    if not existing:
        return spark.createDataFrame([], SUMMARY_SCHEMA).withColumn("meeting_id", F.lit(None).cast("string"))
    return (spark.read.schema(SUMMARY_SCHEMA).option("multiLine", "true").json(existing)
            .withColumn("meeting_id", meeting_id_from_path(F.col("_metadata.file_path"))))


def _put_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Rows of one batch; a replayed batch overwrites its own partition and no other."""
    (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def process_batch(batch: DataFrame, batch_id: int, root: str, records_path: str, quarantine_path: str,
                  vault_path: str | None = None) -> None:
    """foreachBatch body: join parts, redact, classify, idempotent append, quarantine bad rows.
    Classification reads only the sanitized meeting; placeholder -> original rows go to the
    vault (upsert semantics are applied when the vault is read, see ``pii_vault``)."""
    spark = batch.sparkSession
    batch = batch.dropDuplicates(["meeting_id"]).persist()
    # Ids of this micro-batch only (bounded by maxFilesPerTrigger).
    ids = [r["meeting_id"] for r in batch.select("meeting_id").where(F.col("meeting_id").isNotNull()).collect()]
    m = to_meetings_raw(batch, _summaries_for(spark, root, ids))
    bad = F.col("info_corrupt") | F.col("meeting_id").isNull()
    _put_batch(m.filter(bad), batch_id, quarantine_path)
    sanitized, vault_rows = sanitize_meetings(m.filter(~bad).drop("info_corrupt"))
    if vault_path:
        _put_batch(vault_rows, batch_id, vault_path)
    good = enrich(sanitized.drop("n_pii_redacted")).select(*RECORD_COLUMNS)
    target = stored(spark, records_path, good.select("meeting_id").schema)
    insert_if_absent(good, target).write.mode("append").parquet(records_path)
    batch.unpersist()


def start_ingest(spark: SparkSession, root: str, records_path: str, quarantine_path: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int = 1000, vault_path: str | None = None):
    """Start the ingest stream; ``available_now`` processes everything present, then stops."""
    w = (meeting_info_stream(spark, root, max_files_per_trigger).writeStream
         .foreachBatch(lambda df, bid: process_batch(df, bid, root, records_path, quarantine_path, vault_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_kpi_stream(records_stream: DataFrame) -> DataFrame:
    """ST-06: running count / anomalies / mean per (month, call type) over the record stream."""
    valid = F.col("sentiment_score") > 0
    return records_stream.groupBy("month", "call_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_anomaly")).alias("anomalies"),
        F.sum(F.when(valid, F.round(F.col("sentiment_score") * 100).cast("bigint"))).alias("sum_h"),
        F.count(F.when(valid, 1)).alias("n_scored"))
