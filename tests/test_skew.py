"""Hot keys: one key holding a third of all rows."""
from pyspark.sql import functions as F

from colloquy.operators.reports import first_n_per_group
from colloquy.operators.sinks import latest_per_key
from colloquy.operators.redaction import pii_vault


def hot(spark, n=30000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("g"),
        F.col("id").cast("string").alias("meeting_id"), F.col("id").alias("ts"), F.col("id").alias("v")).repartition(8)


def test_top_n_per_group_with_hot_key(spark):
    df = hot(spark)
    out = first_n_per_group(df, "g", 3, order="ts", cols=("g", "meeting_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # partial limit before the exchange, final limit after it
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(g")
    rows = out.filter(F.col("g") == "hot").orderBy("rn").collect()
    assert [r["meeting_id"] for r in rows] == ["0", "3", "6"]


def test_max_by_upsert_with_hot_key(spark):
    df = hot(spark).select(F.col("g").alias("meeting_id"), F.lit("s").alias("stage"), "ts", "v")
    got = {r["meeting_id"]: r["v"] for r in latest_per_key(df, ["meeting_id", "stage"], "ts").collect()}
    assert got["hot"] == 29997
    plan = latest_per_key(df, ["meeting_id", "stage"], "ts")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_vault_with_hot_placeholder(spark):
    m = spark.range(9000).select(F.lit("[EMAIL_abcdef]").alias("placeholder"), F.lit("a@b.co").alias("original"),
                                 F.lit("EMAIL").alias("entity_type"), F.col("id").alias("source_id"),
                                 F.lit(1).alias("pidx"), F.lit(1).alias("pos"))
    v = pii_vault(m).collect()
    assert len(v) == 1 and v[0]["n_matches"] == 9000 and v[0]["source_id"] == 8999
