"""Event-time windows and stream-stream joins: late rows, restart, equality with the batch aggregate."""
import datetime as dt
import os

from pyspark.sql import functions as F

from colloquy.streaming import windows as W

T0 = dt.datetime(2026, 3, 1)
SCHEMA = "id long, ts timestamp, kind string, value double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, path, rows):
    """One more file of the stream's folder."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def kpi(spark, path):
    return W.sliding_kpi(W.table_stream(spark, path, 1), "ts", ["kind"], "value", "60 minutes", "30 minutes", "20 minutes")


def table(df):
    return {(r["window"]["start"], r["kind"]): (r["n"], r["sum_h"], r["low"], r["high"]) for r in df.collect()}


def test_late_rows_inside_the_watermark_count_and_others_are_reported(spark, scratch):
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    put(spark, src, [(1, at(5), "a", 1.5), (2, at(10), "a", 2.25), (3, at(40), "b", 1.0)])
    keys = ["window", "kind"]
    W.collected(kpi(spark, src), "kpi", keys, out, ck)
    put(spark, src, [(4, at(100), "a", 4.0)])
    W.collected(kpi(spark, src), "kpi", keys, out, ck)  # restart: the watermark is now minute 80
    put(spark, src, [(5, at(62), "a", 8.0)])  # late, its windows end at 90 and 120
    got = table(W.collected(kpi(spark, src), "kpi", keys, out, ck))
    on_time = spark.read.parquet(src)
    batch = table(on_time.groupBy(F.window("ts", "60 minutes", "30 minutes").alias("window"), "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("sum_h"), F.min("value").alias("low"), F.max("value").alias("high")))
    assert got == batch and got[at(30), "a"] == (1, 800, 8.0, 8.0)
    put(spark, src, [(6, at(7), "a", 100.0)])  # its windows ended at 30 and 60: outside
    q = (kpi(spark, src).writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}-late/{b}"))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    assert W.late_groups(q) == 2
    assert table(W.table_of(spark, out, kpi(spark, src), keys)) == batch


def test_interval_join_of_two_streams(spark, scratch):
    left, right = os.path.join(scratch, "left"), os.path.join(scratch, "right")
    put(spark, left, [(1, at(0), "x", 1.0), (2, at(5), "x", 1.0), (3, at(500), "x", 1.0)])
    put(spark, right, [(1, at(10), "y", 7.0), (1, at(59), "y", 8.0), (1, at(61), "y", 9.0), (2, at(1), "y", 5.0), (4, at(3), "y", 5.0), (3, at(500), "y", 6.0)])

    def sides():
        r = W.table_stream(spark, right).select("id", F.col("ts").alias("right_ts"), F.col("value").alias("right_value"))
        return W.table_stream(spark, left).select("id", "ts"), r

    got = W.collected(W.interval_join(*sides(), "id", "ts", "right_ts", "60 MINUTES", "10 minutes"), "join")
    assert sorted((r["id"], r["right_value"]) for r in got.collect()) == [(1, 7.0), (1, 8.0), (3, 6.0)]
    outer = W.interval_join(*sides(), "id", "ts", "right_ts", "60 MINUTES", "10 minutes", "left_outer")
    got = W.collected(outer, "outer")  # the watermark of minute 490 has passed 2's hour, not 3's
    assert sorted((r["id"], r["right_value"] or 0) for r in got.collect()) == [(1, 7.0), (1, 8.0), (2, 0), (3, 6.0)]
