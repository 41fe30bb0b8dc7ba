"""Raw meeting documents: six JSON files per meeting under ``<root>/<meeting_id>/``.

Each part is read as its own JSON source with an explicit schema (no inference
pass), the meeting id is taken from the file path, and the parts are joined on
the id — left outer from meeting-info, so a missing part reads as empty.
Malformed files land in ``_corrupt_record`` and are routed to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ["meeting-info", "transcript", "summary", "speaker-meta", "speakers", "events"]

MOMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("type", T.StringType())])
INFO_SCHEMA = T.StructType([
    T.StructField("meetingId", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("startTime", T.StringType()), T.StructField("durationMinutes", T.DoubleType()),
    T.StructField("duration", T.DoubleType()), T.StructField("attendees", T.ArrayType(T.StringType())),
    T.StructField("allEmails", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])
SUMMARY_SCHEMA = T.StructType([
    T.StructField("sentimentScore", T.DoubleType()), T.StructField("overallSentiment", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("keyMoments", T.ArrayType(MOMENT)),
    T.StructField("actionItems", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def meeting_id_from_path(path: Column, root_depth: int | None = None) -> Column:
    """Id = the folder holding the file (``.../<id>/<part>.json``); for a bare key
    ``<id>`` itself (no folder) the whole key."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(path)


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Does the glob match anything (any Hadoop file system)?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    st = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return st is not None and len(st) > 0


def read_part(spark: SparkSession, root: str, part: str, schema: T.StructType | None = None,
              streaming: bool = False) -> DataFrame:
    """One part for every meeting: ``root/*/<part>.json`` (prefix + suffix filter as a glob).
    A part absent for every meeting reads as an empty table."""
    if not streaming and schema is not None and not has_files(spark, f"{root.rstrip('/')}/*/{part}.json"):
        return spark.createDataFrame([], schema).withColumn("meeting_id", F.lit(None).cast("string"))
    reader = spark.readStream if streaming else spark.read
    r = reader.option("multiLine", "true").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record")
    if schema is not None:
        r = r.schema(schema)
    df = r.json(f"{root.rstrip('/')}/*/{part}.json")
    return df.withColumn("meeting_id", meeting_id_from_path(F.col("_metadata.file_path")))


def to_meetings_raw(info: DataFrame, summary: DataFrame) -> DataFrame:
    """meeting-info ⟕ summary -> meetings_raw (field-name drift resolved by coalesce)."""
    i = info.select("meeting_id", "title", F.col("startTime").alias("start_raw"),
                    F.coalesce("durationMinutes", "duration").alias("duration_min"),
                    F.coalesce("attendees", "allEmails", F.array().cast("array<string>")).alias("attendees"),
                    # PERMISSIVE parsing leaves every field NULL on a corrupt record; naming real
                    # columns here also keeps the scan from reading only the corrupt column.
                    (F.col("_corrupt_record").isNotNull() & F.col("title").isNull()
                     & F.col("startTime").isNull()).alias("info_corrupt"))
    s = summary.select("meeting_id", F.col("sentimentScore").alias("sentiment_score"),
                       F.col("overallSentiment").alias("sentiment_label"), "topics",
                       F.col("summary"), F.col("keyMoments").alias("key_moments"),
                       F.col("actionItems").alias("action_items"))
    j = i.join(s, "meeting_id", "left")
    return j.select(
        "meeting_id", F.coalesce("title", F.lit("")).alias("title"),
        F.try_to_timestamp(F.col("start_raw")).alias("start_time"),
        F.coalesce("duration_min", F.lit(0.0)).alias("duration_min"), "attendees",
        F.nullif(F.col("sentiment_score"), F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("sentiment_label", F.lit("")).alias("sentiment_label"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("key_moments", F.array().cast(T.ArrayType(MOMENT))).alias("key_moments"),
        F.coalesce("action_items", F.array().cast("array<string>")).alias("action_items"),
        "info_corrupt")


def read_meetings(spark: SparkSession, root: str) -> tuple:
    """(meetings_raw, quarantine): rows with a corrupt meeting-info or no id go to quarantine."""
    info = read_part(spark, root, "meeting-info", INFO_SCHEMA)
    summary = read_part(spark, root, "summary", SUMMARY_SCHEMA)
    m = to_meetings_raw(info, summary)
    bad = F.col("info_corrupt") | F.col("meeting_id").isNull() | (F.col("meeting_id") == "")
    return m.filter(~bad).drop("info_corrupt"), m.filter(bad)


def read_all_parts(spark: SparkSession, root: str) -> DataFrame:
    """J-01: every meeting's six parts as one row.  meeting-info and summary are parsed
    with their schemas; transcript, speaker-meta, speakers and events (whose fields the
    pipeline never reads) stay as their raw JSON text.  All parts join on the id, left
    outer from meeting-info, so a missing part is NULL."""
    info = read_part(spark, root, "meeting-info", INFO_SCHEMA)
    summary = read_part(spark, root, "summary", SUMMARY_SCHEMA)
    out = info.select("meeting_id", F.struct(*[c for c in INFO_SCHEMA.fieldNames() if c != "_corrupt_record"]).alias("meeting_info"))
    out = out.join(summary.select("meeting_id", F.struct(*[c for c in SUMMARY_SCHEMA.fieldNames()
                                                           if c != "_corrupt_record"]).alias("summary")),
                   "meeting_id", "left")
    for part in ("transcript", "speaker-meta", "speakers", "events"):
        if not has_files(spark, f"{root.rstrip('/')}/*/{part}.json"):
            out = out.withColumn(part.replace("-", "_"), F.lit(None).cast("string"))
            continue
        raw = (spark.read.option("wholetext", "true").text(f"{root.rstrip('/')}/*/{part}.json")
               .select(meeting_id_from_path(F.col("_metadata.file_path")).alias("meeting_id"),
                       F.col("value").alias(part.replace("-", "_"))))
        out = out.join(raw, "meeting_id", "left")
    return out
