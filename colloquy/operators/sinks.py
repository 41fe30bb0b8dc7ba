"""Sinks and table maintenance: idempotent insert, upserts, deletes, export snapshots.

All of them are joins/aggregations keyed by meeting id (or placeholder); Spark
shuffles both sides on the key (or AQE broadcasts a side it measured small).
Writes go to a caller-given path — on a cluster a shared location, never a
machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 16 flat export columns of the BI dataset (fixed schema of the external table).
EXPORT_SCHEMA = T.StructType([
    T.StructField("meeting_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("call_type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()), T.StructField("sentiment_label", T.StringType()),
    T.StructField("is_anomaly", T.BooleanType()), T.StructField("z_score", T.DoubleType()),
    T.StructField("n_issues", T.IntegerType()), T.StructField("escalation_team", T.StringType()),
    T.StructField("escalation_priority", T.StringType()), T.StructField("has_pagerduty", T.BooleanType()),
    T.StructField("account_name", T.StringType()), T.StructField("feature_gap", T.BooleanType()),
    T.StructField("month", T.StringType()), T.StructField("processed_at", T.StringType()),
])


def insert_status(batch: DataFrame, target: DataFrame, key: str = "meeting_id") -> DataFrame:
    """S-08: per incoming row, 'saved' when the key is new, 'duplicate' when present.
    Duplicates inside the batch keep their first row (dropDuplicates on the key)."""
    existing = target.select(key).distinct().withColumn("_exists", F.lit(True))
    return (batch.dropDuplicates([key]).join(existing, key, "left")
            .withColumn("status", F.when(F.col("_exists"), F.lit("duplicate")).otherwise(F.lit("saved")))
            .drop("_exists"))


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Rows to append: batch minus keys already stored (anti join); first write wins."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def stored(spark, path: str, schema) -> DataFrame:
    """The table at ``path``, or no rows before its first write.  Read errors are raised: an
    unreadable table is not an empty one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def append_new(batch: DataFrame, path: str, key: str = "meeting_id") -> int:
    """Idempotent append into a parquet table at ``path``; returns rows written."""
    spark = batch.sparkSession
    target = stored(spark, path, batch.select(key).schema)
    new = insert_if_absent(batch, target, key).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def latest_per_key(df: DataFrame, keys: list, order_col: str) -> DataFrame:
    """S-09 / W-05: last writer wins per key.  ``max_by`` over a struct of all columns is
    partially aggregated, so a key with very many versions is combined map-side."""
    others = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.struct(order_col, *others))
    return df.groupBy(*keys).agg(latest.alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in others])


def delete_keys(df: DataFrame, keys: DataFrame, key: str = "meeting_id") -> DataFrame:
    """S-10: drop every row (record or lineage stage) whose key is in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def _export_col(f: T.StructField):
    if f.name == "processed_at":
        return F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at")
    if isinstance(f.dataType, T.DoubleType):  # numbers are stored rounded to 6 places (F-21)
        return F.round(F.col(f.name).cast("double"), 6).alias(f.name)
    return F.col(f.name).cast(f.dataType).alias(f.name)


def export_rows(records: DataFrame, snapshot_date: str) -> DataFrame:
    """S-12: flat export columns + the snapshot ``date`` partition column."""
    cols = [_export_col(f) for f in EXPORT_SCHEMA.fields]
    return records.select(*cols, F.to_date(F.lit(snapshot_date)).alias("date"))


def write_export(records: DataFrame, path: str, snapshot_date: str) -> int:
    """Daily NDJSON snapshot under ``path/date=YYYY-MM-DD``; re-running a day overwrites
    only that day's partition (dynamic partition overwrite).  Returns the row count."""
    seen = Observation("export")
    rows = export_rows(records, snapshot_date).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)
    return seen.get["n"]


def read_export(spark, path: str) -> DataFrame:
    """S-13: the external table: explicit schema, ``date`` discovered from the folders
    (filters on ``date`` prune partitions)."""
    schema = T.StructType(EXPORT_SCHEMA.fields + [T.StructField("date", T.DateType())])
    return spark.read.schema(schema).json(path)


def latest_snapshot(export: DataFrame) -> DataFrame:
    """S-14: only the newest snapshot, so each meeting counts once.  The newest date is one
    scalar (an aggregate of the date column alone), then a literal filter prunes every other
    date partition."""
    newest = export.agg(F.max("date").alias("d")).first()["d"]
    return export.filter(F.col("date") == F.lit(newest)) if newest is not None else export.limit(0)


def read_latest_snapshot(spark, path: str) -> DataFrame:
    """S-14 on a stored export: the newest ``date=`` folder by listing the folders (one per day), so
    that no other day's file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*")
    days = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    newest = max((d.getPath().getName().removeprefix("date=") for d in days), default=None)
    export = read_export(spark, path)
    return export.filter(F.col("date") == F.lit(newest).cast("date")) if newest else export.limit(0)


def escalation_notices(records: DataFrame) -> DataFrame:
    """S-15: one notice per paged meeting."""
    return records.filter(F.col("has_pagerduty")).select(
        "meeting_id", "title", "category", F.col("escalation_team").alias("team"),
        F.col("escalation_priority").alias("priority"),
        F.concat(F.lit("Escalation: "), F.col("meeting_id")).alias("subject"))


def pipeline_counters(records: DataFrame) -> DataFrame:
    """S-16: processed meetings per call type."""
    return records.groupBy("call_type").agg(F.count(F.lit(1)).alias("processed"))


def lineage_events(enriched: DataFrame, stage: str, ts, status: str = "complete") -> DataFrame:
    """Lineage rows (meeting_id, stage, timestamp, status, n_pii_redacted: replacements of that meeting)."""
    n = F.col("n_pii_redacted") if "n_pii_redacted" in enriched.columns else F.lit(0)
    return enriched.select("meeting_id", F.lit(stage).alias("stage"), ts.alias("timestamp"),
                           F.lit(status).alias("status"), n.cast("int").alias("n_pii_redacted"))


def write_sanitized(parts: DataFrame, path: str) -> None:
    """S-07: the redacted meeting document (all parts, every string leaf redacted) as
    JSON lines, one per meeting, appended batch by batch (no per-meeting folders: one
    tiny file per meeting would not scale)."""
    from colloquy.operators.redaction import redact_record
    cols = [c for c in parts.columns if c != "meeting_id"]
    redact_record(parts, cols).write.mode("append").json(path)


def append_feedback(accepted: DataFrame, path: str) -> None:
    """S-11: append the accepted (error-free) submissions to the feedback log."""
    accepted.filter(F.col("error").isNull()).drop("error").write.mode("append").parquet(path)


def error_counters(quarantine: DataFrame, stage: str = "ingestion") -> DataFrame:
    """S-16: rejected rows per stage."""
    return quarantine.select(F.lit(stage).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("errors"))


def with_counters(records: DataFrame, name: str = "ingest"):
    """S-16 without an extra job: attach an ``Observation`` that collects pipeline
    counters while the records are written.  Returns (observed DataFrame, observation);
    ``observation.get`` is available once an action on the DataFrame has finished."""
    from pyspark.sql import Observation
    obs = Observation(name)
    observed = records.observe(
        obs, F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("call_type") == "support").alias("support"),
        F.count_if(F.col("call_type") == "external").alias("external"),
        F.count_if(F.col("call_type") == "internal").alias("internal"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"),
        F.count_if(F.col("has_pagerduty")).alias("paged"))
    return observed, obs
