"""Keyed tables: existence checks, upserts, deletes, compaction, replay and half-written runs."""
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType()),
                       T.StructField("note", T.StructType([T.StructField("a", T.StringType())]))])


@pytest.fixture()
def table(spark, scratch):
    return KeyedTable(spark, scratch + "/t", ["id"], SCHEMA, rows_per_file=50)


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, (f"n{v}",)) for k, v in pairs], SCHEMA)


def state(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_upserts_deletes_and_compaction_keep_the_latest_view(spark, table):
    rng, want = random.Random(1), {}
    assert state(table.view()) == {} and table.compact() == [] and table.runs() == []
    for seq in range(1, 7):
        batch = {f"k{rng.randrange(120)}": rng.randrange(1000) for _ in range(40)}
        if seq == 4:
            gone = sorted(want)[:10]
            table.delete(spark.createDataFrame([(k,) for k in gone], "id string"), seq)
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            table.upsert(rows(spark, batch.items()), seq)
            want |= batch
        assert state(table.view()) == want
    merged = table.compact(fanout=3)
    assert len(merged) >= 3 and state(table.view()) == want
    table.upsert(rows(spark, [("k1", -1)]), 7)
    want["k1"] = -1
    table.compact(full=True)
    assert len(table.runs()) == 1 and state(table.view()) == want
    assert table.view().where("note.a != concat('n', v)").count() == 0
    assert len(table.vacuum()) == 8 and state(table.view()) == want
    # a write that was merged already and is replayed changes nothing
    table.upsert(rows(spark, [("k1", 999)]), 2)
    assert state(table.view()) == want


def test_insert_if_absent_first_write_wins_and_replays(spark, table):
    first = table.insert_if_absent(rows(spark, [("a", 1), ("b", 2), ("b", 3)]), 1)
    assert {r["id"]: r["status"] for r in first.collect()} == {"a": "saved", "b": "saved"}
    kept = state(table.view())
    for _ in range(2):  # the second time is a replay of the same batch
        again = table.insert_if_absent(rows(spark, [("b", 9), ("c", 4), (None, 5)]), 2)
        assert {r["id"]: r["status"] for r in again.where("id IS NOT NULL").collect()} == {"b": "duplicate", "c": "saved"}
        assert state(table.view()) == kept | {"c": 4}
    table.compact(full=True)
    table.insert_if_absent(rows(spark, [("c", 7), ("d", 8)]), 3)
    assert state(table.view()) == kept | {"c": 4, "d": 8}


def test_rows_of_one_key_do_not_depend_on_order(spark, table):
    pairs = [("a", v) for v in range(20)]
    table.upsert(rows(spark, pairs), 1)
    one = state(table.view())
    table.upsert(rows(spark, pairs[::-1]).repartition(5), 1)
    assert state(table.view()) == one
    table.upsert(rows(spark, pairs), 2, order=["v"])
    assert state(table.view()) == {"a": 19}


def test_files_read_do_not_grow_with_the_table(spark, scratch):
    read = []
    for n in (500, 5000):
        t = KeyedTable(spark, f"{scratch}/t{n}", ["id"], SCHEMA, rows_per_file=50)
        t.upsert(spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").cast("int").alias("v"), F.struct(F.lit("x").alias("a")).alias("note")), 1)
        assert t.manifest().count() == n // 50
        keys = spark.createDataFrame([("k3",), ("k77",), ("nothing",)], "id string")
        assert state(t.lookup(keys)) == {"k3": 3, "k77": 77}
        read.append(len(t.files_for(keys)))
        assert len(t.lookup(keys).inputFiles()) == read[-1]
    assert max(read) <= 3


def test_a_half_written_run_is_invisible(spark, table):
    table.upsert(rows(spark, [("a", 1)]), 1)
    table.upsert(rows(spark, [("a", 2), ("b", 2)]), 2)
    os.remove(table.path + "/manifest/s000000000000002/_SUCCESS")
    assert state(table.view()) == {"a": 1}
    table.upsert(rows(spark, [("a", 2), ("b", 2)]), 2)
    assert state(table.view()) == {"a": 2, "b": 2}


def test_compaction_to_nothing(spark, table):
    table.upsert(rows(spark, [("a", 1)]), 1)
    table.delete(spark.createDataFrame([("a",)], "id string"), 2)
    assert len(table.compact(full=True)) == 2
    assert state(table.view()) == {} and table.lookup(spark.createDataFrame([("a",)], "id string")).count() == 0


def test_presence_is_decided_without_the_payload(spark, scratch):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("payload", T.StringType())])
    t = KeyedTable(spark, f"{scratch}/p", ["id"], schema)
    t.upsert(spark.createDataFrame([("a", "1"), ("b", "2")], schema), 1)
    t.delete(spark.createDataFrame([("b",)], "id string"), 2)
    t.upsert(spark.createDataFrame([("c", "3")], schema), 3)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    p = t.present(keys)
    assert sorted(r["id"] for r in p.collect()) == ["a", "c"]
    assert sorted(r["id"] for r in t.present(keys, before=2).collect()) == ["a", "b"]
    assert "payload" not in p._jdf.queryExecution().executedPlan().toString()
