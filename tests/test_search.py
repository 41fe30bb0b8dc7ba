"""BM25 against a brute-force Python scorer on the whole small corpus."""
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from colloquy.operators import search as S
from colloquy.sources.tables import table
from tests.conftest import SF_SMALL


def brute(docs, query, k1=1.5, b=0.75):
    tok = [re.findall(r"\w+", d.lower()) for d in docs]
    avgdl = sum(map(len, tok)) / len(tok)
    df = defaultdict(int)
    for t in tok:
        for w in set(t):
            df[w] += 1
    out = []
    for t in tok:
        tf = Counter(t)
        s = 0.0
        for w in re.findall(r"\w+", query.lower()):
            idf = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1)
            s += idf * (tf[w] * (k1 + 1)) / (tf[w] + k1 * (1 - b + b * len(t) / avgdl))
        out.append(s)
    return out


def test_bm25_matches_brute_force(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text").orderBy("doc_id")
    rows = d.collect()
    query = "the data the worthless"            # repeated term counts twice
    ref = {r["doc_id"]: s for r, s in zip(rows, brute([r["text"] or "" for r in rows], query))}
    got = {r["doc_id"]: r["score"] for r in S.bm25(d, "doc_id", F.col("text"), query).collect()}
    for k, v in ref.items():
        assert abs(got.get(k, 0.0) - v) < 1e-9
    top = S.top_k(S.bm25(d, "doc_id", F.col("text"), query), "doc_id", 50).collect()
    want = sorted([(round(v, 6), k) for k, v in ref.items() if v > 0], key=lambda x: (-x[0], x[1]))[:20]
    assert [(r["score"], r["doc_id"]) for r in top] == want     # k clamped to 20


def test_bm25_with_stored_index_equals_direct(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    idx = S.corpus_index(d.select("doc_id", S.tokens(F.col("text")).alias("tokens")))
    q = "the data the worthless"
    direct = {r["doc_id"]: r["score"] for r in S.bm25(d, "doc_id", F.col("text"), q).collect()}
    via_index = {r["doc_id"]: r["score"] for r in S.bm25(d, "doc_id", F.col("text"), q, index=idx).collect()}
    assert direct.keys() == via_index.keys() and all(abs(direct[k] - via_index[k]) < 1e-9 for k in direct) and len(direct) > 0


def test_query_reads_postings_and_no_text(spark):
    idx = S.document_index(spark, SF_SMALL)
    d = table(spark, SF_SMALL, "documents")
    plan = S.bm25(d, "doc_id", F.col("text"), "the data", index=idx)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 1 and "In(term" in scans[0] and "text" not in scans[0].split("ReadSchema")[1]


def test_appended_documents_score_as_a_rebuilt_index(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    tok = lambda x: x.select("doc_id", S.tokens(F.col("text")).alias("tokens"))
    old, new = d.filter("length(text) % 3 > 0"), d.filter("length(text) % 3 = 0")
    idx = S.corpus_index(tok(old)).plus(S.corpus_index(tok(new)))
    q = "the data the worthless"
    want = {r["doc_id"]: r["score"] for r in S.bm25(d, "doc_id", F.col("text"), q).collect()}
    got = {r["doc_id"]: r["score"] for r in S.bm25(d, "doc_id", F.col("text"), q, index=idx).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_postings_are_shuffled_once_and_rows_that_come_twice_add_up(spark):
    rows = [("a", "x y x z"), ("a", "x y x z"), ("b", ""), ("c", None), ("d", "y"), (None, "z z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").select("doc_id", S.tokens(F.col("text")).alias("tokens"))
    p = S.postings(docs)
    got = {(r["doc_id"], r["dl"], r["term"]): r["tf"] for r in p.collect()}
    assert got == {("a", 4, "x"): 4, ("a", 4, "y"): 2, ("a", 4, "z"): 2, ("d", 1, "y"): 1, (None, 2, "z"): 2}
    assert "Exchange hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString()
