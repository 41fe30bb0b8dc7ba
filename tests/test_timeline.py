"""As-of joins and trailing frames against plain loops: ties, nulls, empty sides, a hot key."""
import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.operators import timeline as TL

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def sides(n=300):
    """A third of all rows on one key, equal times, null keys and times."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None, "c"])
    time = lambda: None if rng.random() < 0.03 else at(rng.randrange(500))
    left = [(i, key(), time()) for i in range(n)]
    right = [(key(), time(), i) for i in range(n)]
    return left, right


def test_asof_join_equals_a_plain_loop(spark):
    left, right = sides()
    ld = spark.createDataFrame(left, "id int, k string, t timestamp").repartition(3)
    rd = spark.createDataFrame(right, "k string, rt timestamp, v int").repartition(3)
    for parts in (1, 7, 64):
        got = {r["id"]: r["v"] for r in TL.asof_join(ld, rd, ["k"], "t", "rt", ["v"], order=["v"], parts=parts).collect()}
        want = {}
        for i, k, t in left:
            best = max(((rt, v) for rk, rt, v in right if k is not None and rk == k and rt is not None and t is not None and rt <= t), default=(None, None))
            want[i] = best[1]
        assert got == want
    none = rd.limit(0)
    assert TL.asof_join(ld, none, ["k"], "t", "rt", ["v"]).where("v IS NULL").count() == len(left)
    assert TL.asof_join(ld.limit(0), rd, ["k"], "t", "rt", ["v"]).count() == 0


def test_trailing_frames_equal_a_plain_loop(spark):
    rows = [(k, t, v) for k, t, v in sides()[1] if k is not None]
    df = spark.createDataFrame(rows, "k string, t timestamp, v long")
    got = {(r["k"], r["t"]): (r["n"], r["s"]) for r in TL.trailing(df, ["k"], "t", {"n": F.lit(1), "s": F.col("v")}, "60 MINUTES", parts=9).collect()}
    want = {}
    for k, t, _ in rows:
        if t is not None:
            inside = [v for k2, t2, v in rows if k2 == k and t2 is not None and t - dt.timedelta(hours=1) <= t2 <= t]
            want[k, t] = (len(inside), sum(inside))
    assert got == want


def test_a_hot_key_is_spread_over_blocks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    blocked = TL._blocked(rows.withColumn("_t_at", F.unix_micros("t")), 64).groupBy("k", "_t_block").count()
    assert blocked.count() == 64 and blocked.agg(F.max("count")).first()[0] <= 20_000 / 64 + 1
    plan = TL.asof_join(rows, rows.select("k", F.col("t").alias("rt"), F.lit(1).alias("v")), ["k"], "t", "rt", ["v"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
