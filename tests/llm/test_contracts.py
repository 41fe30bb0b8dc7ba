"""Every query's operator against its plain-Python version, on a corpus of edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, contamination, jaccard, lm, quality, repeats, secrets, sharding, warc
from colloquy.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute
from tests.llm.conftest import corpus, words

ROWS = [(d, t) for d, t, *_ in corpus()]


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def want(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_repeats(docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(repeats.digest(docs), *names) == want(brute.op2(ROWS))


def test_repeats_across_small_shards_and_hot_hashes(docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(repeats.remove(docs, block_bytes=3000, hot=1), *names) == want(brute.op2(ROWS))


BENCH = [(1, " ".join(ROWS[6][1].split(" ")[40:75])), (2, "one two three"), (3, None), (4, "!!"), (10, "W1 nothing like it " + "é" * 150),
         (None, "other text under the same id"), (2, "one two three")]


def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in BENCH], "item_id long, text string, items string")


def test_contamination(spark, docs):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    exp = want(brute.op3(ROWS, BENCH))
    assert sum(r[5] for r in exp) == 4
    assert got(contamination.digest(contamination.scan(docs, bench(spark))), *names) == exp


def test_contamination_in_benchmark_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(contamination, "SLICE_BYTES", 100)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(contamination.digest(contamination.scan(docs, bench(spark))), *names) == want(brute.op3(ROWS, BENCH))


def test_removed_passages_are_gone(spark, docs):
    out = contamination.remove_spans(docs, bench(spark))
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 13").first().text == ""
    again = brute.op3([(r.doc_id, r.text) for r in out.collect()], [BENCH[0]])
    assert not any(r[5] for r in again)


PAGES = [(3, "http://www.B.example.com/x?q=1#f", "<p>same</p>"), (1, "https://a.example.com/", "<p>same</p>"), (2, None, None), (4, "", ""),
         (5, "u\r\nWARC-Type: evil", "é" * 1000), (5, "u\r\nWARC-Type: evil", "é" * 1000), (None, "http://x/", "<p>same</p>"), (None, "http://x/", "alone"),
         (7, "http://a.example.com/", "\r\n\r\nblank")]


def pages(spark):
    return spark.createDataFrame([(*r, "k", 1) for r in PAGES], "page_id long, url string, html string, archive string, offset int").repartition(3)


def test_warc(spark):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = warc.capture_history(pages(spark))
    assert got(out, *names) == want(brute.op4(PAGES))
    rows = out.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(PAGES)))
    order = [(r.url_key, r.captured_at) for r in rows]
    assert order == sorted(order)


def test_warc_index_in_many_ranges(spark):
    archives = warc.write_archives(pages(spark), archive_bytes=1)
    rows = warc.merge_index(archives, range_rows=2).orderBy("position").collect()
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in rows]
    assert len(keys) == len(PAGES) and keys == sorted(keys)


def test_warc_small_payloads_stay_responses(spark):
    out = warc.capture_history(pages(spark), min_revisit_bytes=100)
    assert {r.page_id for r in out.where("record_type = 'revisit'").collect()} == set()


def test_lm(docs):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    out, exp = got(lm.score(docs), *names), want(brute.op5(ROWS))
    assert [r[:5] for r in out] == [r[:5] for r in exp]
    assert all(abs(a[5] - b[5]) < 1e-6 * abs(b[5]) for a, b in zip(out, exp))


def test_bpe(docs):
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got(bpe.encode(docs, tokenizer_path()), *names) == want(brute.op6(ROWS, tokenizer_path()))


def test_quality(docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = [(d, t, s) for d, t, _, s in corpus()]
    assert got(quality.digest(quality.judge(docs)), *names) == want(brute.op7(rows))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == want((r[0],) for r in brute.op7(rows) if r[7])
    assert not kept.where("source = 'd' and text like '%footer%'").count()
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets(docs):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    exp = brute.op8(ROWS)
    found = secrets.digest(secrets.scan(docs))
    assert got(found, *names) == want(r[:5] for r in exp)
    base = {r[5] for r in exp if r[5]}
    assert base <= {",".join(x for x in r.spans.split(",") if not x.startswith("format")) for r in found.collect()}
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert masked.where("text like '%AKIA%' or text like '%Zq8x%' or text like '%0af3%'").count() == 0
    assert masked.where("text like '%password:short%'").count() == 1
    same = {(r.doc_id, r.text) for r in masked.collect()}
    assert {r for r in ROWS if r[0] not in (10, 14, 15)} <= same


def test_sharding(docs):
    tree = sharding.topology(8)
    rows = sharding.assign(docs, tree, sharding.with_new_shard(tree, 8), rows_per_piece=7).collect()
    assert len(rows) == len(ROWS)
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and all(r.law == "key" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in rows if r.doc_id == 20}) == 1
    names = ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    assert want(tuple(r[n] for n in names) for r in rows) == want(brute.op9(ROWS, tree, sharding.with_new_shard(tree, 8)))
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ROWS)


def test_jaccard(docs):
    assert got(jaccard.digest(jaccard.join(docs)), "doc_id", "class_id", "n_links") == want(brute.op10(ROWS))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2


def near_groups(n_groups=4, size=60):
    """Groups of near copies: a base text with two words of 200 changed in each (similarity about 0.9
    to the base, and about 0.82 to each other)."""
    import random
    rng, rows = random.Random(3), []
    for g in range(n_groups):
        base = words(rng, 200, 10**7).split(" ")
        for i in range(size):
            own = list(base)
            for k in rng.sample(range(200), 2):
                own[k] = f"x{g}y{i}z{k}"
            rows.append((g * 1000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("leaf, block", [(jaccard.LEAF, jaccard.BLOCK), (16, jaccard.BLOCK), (16, 16)])
def test_jaccard_groups_of_near_copies(spark, leaf, block):
    """With leaves of 16 the groups are masses, with blocks of 16 compared block by block; the links stay whole."""
    rows = near_groups()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(jaccard.digest(jaccard.join(df, leaf=leaf, block=block)), "doc_id", "class_id", "n_links")
    exp = want(brute.op10(rows))
    assert [r[:2] for r in out] == [r[:2] for r in exp]
    have, all_links = sum(r[2] for r in out), sum(r[2] for r in exp)
    assert all(a[2] <= b[2] for a, b in zip(out, exp)) and have >= 0.999 * all_links


def test_jaccard_group_above_ten_thousand_near_copies(spark):
    """Recall of the links of one group of 10,500 near copies, against all pairs; the members of the
    group are dealt once, whatever the number of runs."""
    rows = near_groups(1, 10_500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.digest(jaccard.join(df)).collect()}
    assert {c for c, _ in out.values()} == {0}
    base = {}
    sets = []
    for _, text in rows:
        w = text.split(" ")
        sets.append([base.setdefault(tuple(w[k:k + 5]), len(base)) for k in range(len(w) - 4)])
    counts = np.bincount(np.concatenate(sets))
    common = np.flatnonzero(counts > 1)
    where = np.full(len(counts), -1)
    where[common] = np.arange(len(common))
    m = np.zeros((len(rows), len(common)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [where[x] for x in s if where[x] >= 0]] = 1
    size = np.array([len(set(s)) for s in sets])
    total = found = 0
    for a in range(0, len(rows), 1500):
        inter = m[a:a + 1500] @ m.T
        n = (inter / (size[a:a + 1500, None] + size[None] - inter) >= 0.8 - 1e-9).sum(axis=1) - 1
        got_n = np.array([out[i][1] for i in range(a, min(a + 1500, len(rows)))])
        assert (got_n <= n).all()
        total, found = total + n.sum(), found + got_n.sum()
    assert found >= 0.999 * total


def test_blocks_of_a_group_grow_with_its_members(spark):
    """Rows dealt to compare a group: pairs of blocks, far fewer than members at every size."""
    for n in (2_000, 8_000, 32_000):
        tiles = -(-n // jaccard.BLOCK)
        assert tiles * tiles <= n / 50


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    out = {(r.node, r.root) for r in jaccard.components(edges).collect()}
    assert out == {(i, 0) for i in range(1, 41)} | {(101, 100)}


EMPTY = {"op2": lambda d: repeats.digest(d), "op3": None, "op5": lm.score, "op6": lambda d: bpe.encode(d, tokenizer_path()),
         "op7": lambda d: quality.digest(quality.judge(d)), "op8": lambda d: secrets.digest(secrets.scan(d)),
         "op9": lambda d: sharding.assign(d, sharding.topology(8)), "op10": lambda d: jaccard.digest(jaccard.join(d))}


@pytest.mark.parametrize("op", sorted(EMPTY))
def test_empty_tables(spark, no_docs, op):
    if op == "op3":
        df = contamination.digest(contamination.scan(no_docs, bench(spark).limit(0)))
    else:
        df = EMPTY[op](no_docs)
    assert df.count() == 0 and "doc_id" in df.columns


def test_empty_pages_and_benchmark(spark, docs):
    assert warc.capture_history(pages(spark).limit(0)).count() == 0
    out = contamination.digest(contamination.scan(docs, bench(spark).limit(0)))
    assert out.count() == len(ROWS) and out.where("contaminated").count() == 0


def test_stages_on_empty_tables(spark, no_docs):
    for df in (quality.keep_good(no_docs), jaccard.keep_one(no_docs), contamination.remove_spans(no_docs, bench(spark)), secrets.mask(no_docs)):
        assert df.columns == no_docs.columns and df.count() == 0


def test_registered_once_for_each_number():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline
    from colloquy.llm.common import stage, table
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for name, step in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(step(spark, docs, sf), "test")
        if name == "quality rules":
            exp = brute.op7([(r.doc_id, r.text, r.source) for r in docs.collect()])
            assert got(out, "doc_id") == want((r[0],) for r in exp if r[7])
        elif name == "n-gram Jaccard join":
            assert got(out, "doc_id") == want({(r[1],) for r in brute.op10(rows)})
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
            hit = {r[0] for r in brute.op3(rows, items) if r[5]}
            new = {r.doc_id: r.text for r in out.collect()}
            assert set(new) == {d for d, _ in rows} and {d for d, t in rows if new[d] != t} == hit
        elif name == "secret scans":
            new = {r.doc_id: r.text for r in out.collect()}
            found = {r[0] for r in brute.op8(rows) if r[5]}
            assert found <= {d for d, t in rows if new[d] != t} and not any(r[5] for r in brute.op8(new.items()))
        else:
            assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(brute.op6(rows, tokenizer_path()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0
