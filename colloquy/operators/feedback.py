"""Feedback corrections: validation, acceptance against stored records, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.rules import FEEDBACK_CALL_TYPES, FEEDBACK_SENTIMENT_LABELS

CORRECTIONS = ["corrected_category", "corrected_call_type", "corrected_sentiment_label"]


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != F.lit("")


def validation_error(call_types=FEEDBACK_CALL_TYPES, labels=FEEDBACK_SENTIMENT_LABELS) -> Column:
    """D-28: first failing rule's message, or NULL when valid."""
    ct_list = "[" + ", ".join(f"'{v}'" for v in sorted(call_types)) + "]"
    lb_list = "[" + ", ".join(f"'{v}'" for v in sorted(labels)) + "]"
    any_correction = _given(CORRECTIONS[0]) | _given(CORRECTIONS[1]) | _given(CORRECTIONS[2])
    return (F.when(~_given("meeting_id"), F.lit("meeting_id is required"))
            .when(_given("corrected_call_type") & ~F.col("corrected_call_type").isin(*call_types),
                  F.lit(f"corrected_call_type must be one of {ct_list}"))
            .when(_given("corrected_sentiment_label") & ~F.col("corrected_sentiment_label").isin(*labels),
                  F.lit(f"corrected_sentiment_label must be one of {lb_list}"))
            .when(~any_correction, F.lit("at least one correction field is required")))


def accept(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """J-07: valid submissions for known meetings, with the record's originals copied in.
    Unknown ids and invalid rows come back with ``error`` set."""
    v = feedback.withColumn("error", validation_error())
    rec = records.select("meeting_id", F.col("category").alias("original_category"),
                         F.col("call_type").alias("original_call_type"), "title", F.lit(True).alias("_known"))
    j = v.join(rec, "meeting_id", "left")
    return j.withColumn("error", F.coalesce(
        "error", F.when(F.col("_known").isNull(), F.concat(F.lit("meeting "), F.col("meeting_id"), F.lit(" not found"))))
    ).drop("_known")


def latest_corrections(accepted: DataFrame) -> DataFrame:
    """W-05: per meeting and field the newest accepted non-empty correction (on equal times the
    greatest value), combined map-side; a later correction of one field leaves the others."""
    ok = accepted.filter(F.col("error").isNull())
    newest = {c: F.max(F.when(_given(c), F.struct("submitted_at", c))) for c in CORRECTIONS}
    return (ok.groupBy("meeting_id").agg(*[x.alias(c) for c, x in newest.items()], F.max("submitted_at").alias("submitted_at"))
            .select("meeting_id", *[F.col(f"{c}.{c}").alias(c) for c in CORRECTIONS], "submitted_at"))


def apply_corrections(records: DataFrame, latest: DataFrame) -> DataFrame:
    """J-08: corrected value when given and non-empty, else the original."""
    j = records.join(latest, "meeting_id", "left")
    return j.select(
        *[c for c in records.columns if c not in ("category", "call_type", "sentiment_label")],
        F.coalesce(F.nullif("corrected_category", F.lit("")), F.col("category")).alias("category"),
        F.coalesce(F.nullif("corrected_call_type", F.lit("")), F.col("call_type")).alias("call_type"),
        F.coalesce(F.nullif("corrected_sentiment_label", F.lit("")), F.col("sentiment_label")).alias("sentiment_label"),
        F.col("submitted_at").isNotNull().alias("corrected"))
