"""Gold tables: built once per fingerprint, reused after, rebuilt when the spec changes."""
from colloquy.operators.gold import gold_table
from tests.conftest import SF_SMALL


def test_gold_build_once_and_respec(spark):
    calls = []
    src = [f"{SF_SMALL}/region.parquet"]

    def build(tag):
        def f():
            calls.append(tag)
            return spark.read.parquet(src[0])
        return f

    spec = f"test-{id(calls)}"
    a = gold_table(spark, "gold-test", src, spec, build("a"))
    b = gold_table(spark, "gold-test", src, spec, build("b"))
    c = gold_table(spark, "gold-test", src, spec + "-other", build("c"))
    assert calls == ["a", "c"]
    assert a.count() == b.count() == c.count() == 5


def test_prune_gold_is_scoped_and_opt_in(spark):
    from colloquy.operators.gold import fingerprint, prune_gold
    src = [f"{SF_SMALL}/region.parquet"]
    gold_table(spark, "prune-test", src, "one", lambda: spark.read.parquet(src[0]))
    gold_table(spark, "prune-test", src, "two", lambda: spark.read.parquet(src[0]))
    keep = fingerprint(spark, src, "two")
    listed = prune_gold(spark, "prune-test", keep)                 # dry run: nothing deleted
    assert len(listed) >= 1 and all("prune-test-" in v for v in listed)
    assert prune_gold(spark, "prune-test", keep) == listed
    prune_gold(spark, "prune-test", keep, dry_run=False)
    assert prune_gold(spark, "prune-test", keep) == []
    assert gold_table(spark, "prune-test", src, "two", lambda: 1 / 0).count() == 5   # kept, not rebuilt
