"""Sinks: idempotent insert, upsert, delete, export snapshots, feedback."""
from pyspark.sql import functions as F

from colloquy.operators import feedback as FB
from colloquy.operators import sinks as SK
from colloquy.operators.records import RECORD_COLUMNS, build_enriched, enriched
from tests.conftest import SF_SMALL


def test_append_new_is_idempotent(spark, scratch):
    recs = enriched(spark, SF_SMALL).select(*RECORD_COLUMNS)
    path = f"{scratch}/records"
    first = SK.append_new(recs.filter(F.col("month") < "1998-01"), path)
    total = SK.append_new(recs, path)
    again = SK.append_new(recs.unionByName(recs), path)       # re-delivered batch, duplicates inside
    stored = spark.read.parquet(path)
    assert again == 0 and first + total == recs.count() == stored.count()
    assert stored.select("meeting_id").distinct().count() == stored.count()


def test_insert_status(spark):
    recs = enriched(spark, SF_SMALL).select(*RECORD_COLUMNS)
    st = SK.insert_status(recs, recs.filter(F.col("call_type") == "support"))
    got = {r["status"]: r["n"] for r in st.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["duplicate"] == recs.filter(F.col("call_type") == "support").count()
    assert got["saved"] + got["duplicate"] == recs.count()


def test_latest_per_key_and_delete(spark):
    df = spark.createDataFrame([("m1", "a", 1, "old"), ("m1", "a", 3, "new"), ("m1", "b", 2, "x"), ("m2", "a", 1, "y")],
                               "meeting_id string, stage string, ts int, status string")
    got = {(r["meeting_id"], r["stage"]): r["status"] for r in SK.latest_per_key(df, ["meeting_id", "stage"], "ts").collect()}
    assert got == {("m1", "a"): "new", ("m1", "b"): "x", ("m2", "a"): "y"}
    left = SK.delete_keys(df, spark.createDataFrame([("m1",)], "meeting_id string"))
    assert [r["meeting_id"] for r in left.collect()] == ["m2"]


def test_export_partitions_and_latest_snapshot(spark, scratch):
    recs = enriched(spark, SF_SMALL)
    path = f"{scratch}/export"
    n1 = SK.write_export(recs.filter(F.col("month") < "2000-01"), path, "2026-11-30")
    n2 = SK.write_export(recs, path, "2026-12-01")
    n2b = SK.write_export(recs, path, "2026-12-01")            # same-day rerun overwrites only that day
    ext = SK.read_export(spark, path)
    assert ext.filter(F.col("date") == "2026-11-30").count() == n1
    assert ext.count() == n1 + n2 and n2 == n2b == recs.count()
    latest = SK.latest_snapshot(ext)
    assert latest.count() == n2 and latest.select("meeting_id").distinct().count() == n2
    listed = SK.read_latest_snapshot(spark, path)
    assert sorted(listed.collect()) == sorted(latest.collect())
    assert "PartitionFilters: [isnotnull(date" in listed._jdf.queryExecution().executedPlan().toString()


def test_feedback_validation_accept_apply(spark):
    recs = build_enriched(spark, SF_SMALL).select("meeting_id", "category", "call_type", "sentiment_label", "title")
    mid = recs.first()["meeting_id"]
    fb = spark.createDataFrame([
        (mid, "2026-01-01 00:00:00", "Other", None, None),
        (mid, "2026-01-02 00:00:00", None, None, "negative"),
        (mid, "2026-01-03 00:00:00", None, "bogus", None),
        ("", "2026-01-03 00:00:00", "Other", None, None),
        ("nope", "2026-01-03 00:00:00", "Other", None, None),
        (mid, "2026-01-04 00:00:00", None, None, None)],
        "meeting_id string, submitted_at string, corrected_category string, corrected_call_type string, "
        "corrected_sentiment_label string").withColumn("submitted_at", F.to_timestamp("submitted_at"))
    acc = FB.accept(fb, recs).orderBy("submitted_at").collect()
    errors = [r["error"] for r in acc]
    assert errors[0] is None and errors[1] is None
    assert "corrected_call_type must be one of" in errors[2]
    assert "meeting_id is required" in errors
    assert "meeting nope not found" in errors
    assert "at least one correction field is required" in errors
    latest = FB.latest_corrections(FB.accept(fb, recs))
    out = FB.apply_corrections(recs, latest).filter(F.col("meeting_id") == mid).collect()[0]
    orig = recs.filter(F.col("meeting_id") == mid).collect()[0]
    # per field the latest non-empty correction: the later label leaves the earlier category in place
    assert out["sentiment_label"] == "negative" and out["category"] == "Other" != orig["category"] and out["corrected"]


def test_export_date_filter_prunes_partitions(spark, scratch):
    recs = enriched(spark, SF_SMALL)
    path = f"{scratch}/export"
    SK.write_export(recs, path, "2026-11-30")
    SK.write_export(recs, path, "2026-12-01")
    latest = SK.latest_snapshot(SK.read_export(spark, path))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2026-12-01" in plan.split("PartitionFilters")[1][:200]
    assert latest.count() == recs.count()


def test_observed_counters(spark, scratch):
    recs = enriched(spark, SF_SMALL).select(*RECORD_COLUMNS)
    observed, obs = SK.with_counters(recs)
    observed.write.mode("overwrite").parquet(f"{scratch}/obs")
    m = obs.get
    assert m["processed"] == recs.count() == m["support"] + m["external"] + m["internal"]
