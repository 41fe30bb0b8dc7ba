"""op11, op12 and op13 against plain versions, on edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import centroids, runs, toxicity
from colloquy.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import corpus, words

ROWS = [(d, t) for d, t, *_ in corpus()]


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# op11

RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_texts():
    rng = random.Random(3)
    rows = [(1000 + i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(30)]
    rows += [(2000 + i, "x\t" * i + "y") for i in (10, 11, 12, 13, 40)]
    rows += [(3000, "p q r " * 40 + "\n" + "p q r s " * 3 + " é ü" * 9), (3001, ("a b " * 5 + "c ") * 4), (3002, words(rng, 50) + " " + (words(rng, 30) + " ") * 3)]
    return rows


def test_runs_equal_brute_force(spark, docs):
    more = spark.createDataFrame(periodic_texts(), "doc_id long, text string")
    out = runs.digest(runs.detect(docs.select("doc_id", "text").union(more), runs.planted))
    exp = sorted(brute.op11(ROWS + periodic_texts()), key=repr)
    assert got(out, *RUN_COLUMNS) == exp
    assert sum(r[1] > 0 for r in exp) > 30 and any(r[1] > 2 for r in exp)


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            n, k = rng.choice([0, 11, 12, 13, 60]), rng.choice([1, 2, 3])
            w = [str(rng.randrange(k)).encode() for _ in range(n)]
            if n:
                a, p = rng.randrange(n), rng.randrange(1, n + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert runs.runs_of([b" ".join(w) for w in texts], [len(w) for w in texts]) == [brute.runs([x.decode() for x in w]) for w in texts]


def test_runs_of_a_very_long_periodic_text(spark):
    n = 200_000
    out = runs.detect(spark.createDataFrame([(1, "u v w " * n), (2, "z " * n)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in out] == [[(0, 3 * n, 3)], [(0, n, 1)]]
    assert [bytes(r.collapsed) for r in out] == [b"u v w", b"z"]


def test_runs_of_no_rows(no_docs):
    assert runs.digest(runs.detect(no_docs, runs.planted)).count() == 0


# op12

def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster int, distance string, n int")


def test_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 1) if i % 7 else 0.25 for _ in range(64)]) for i in range(300)]
    rows += rows[:40] + [(None, [0.5] * 64), (None, [0.5] * 64), (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63),
                         (904, [math.nan] + [1.0] * 63), (905, [math.inf] + [1.0] * 63), (906, []), (907, [-0.0005] * 64)]
    out = centroids.cluster(vectors(spark, [(*r, 1, "x", 2) for r in rows]).repartition(3))
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert got(out, *names) == sorted(brute.op12(rows), key=repr)


def test_clusters_of_huge_components(spark):
    rows = [(i, [float((-1) ** i * 10.0 ** (j % 18) * (i % 4)) for j in range(64)]) for i in range(20)]
    out = centroids.cluster(vectors(spark, [(*r, 1, "x", 2) for r in rows]))
    exp = [tuple(x if not isinstance(x, int) or x < 1 << 63 else None for x in r) for r in brute.op12(rows)]
    assert got(out, "vec_id", "cluster", "distance", "centroid_sha256") == sorted([(r[0], r[1], r[2], r[5]) for r in exp], key=repr)


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0] * 64), (2, [2.0] * 64)]
    assert centroids.cluster(vectors(spark, [(*r, 1, "x", 2) for r in rows], "float")).count() == 2
    assert centroids.cluster(vectors(spark, [], "float")).count() == 0


def test_search_rejects_and_stays_exact():
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 3000, (64, 1)) + rng.normal(0, 300, (64, 64))
    cents = np.floor(middle).astype(np.int64)
    x = np.floor(middle[rng.integers(0, 64, 2000)] + rng.normal(0, 100, (2000, 64))).astype(np.int64)
    index = centroids.Search(cents.tolist())
    number, d = index.nearest(x)
    full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert index.compared < 0.2 * len(x) * 64
    same = centroids.Search([[5] * 64, [3] * 64, [3] * 64])
    assert same.nearest(np.full((2, 64), 4))[0].tolist() == [0, 0] and same.nearest(np.full((1, 64), 2))[0].tolist() == [1]


# op13

def toxic_corpus(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        w = words(rng, 60, 3000).split(" ")
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["Vilebad", "grubworm" + "abcdef"[rng.randrange(6)], "awfulest"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxic_documents_and_offsets(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, None, "x", 1.0), (9999, "", "x", 1.0), (9998, "grubwormzzz!", "y", 2.0)],
                                 "doc_id long, text string, spans string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y, None if i % 50 == 7 else y, 1.0) for i, _, y in rows], "doc_id long, quality int, toxic int, score double")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == len(rows) + 3
    for i, text, y in rows:
        assert (out[i].score >= toxicity.THRESHOLD) == bool(y)
        tagged = {text[s.start:s.end] for s in out[i].spans}
        assert not y or all(any(w in t for t in tagged) for w in text.split(" ") if w[:4] in ("Vile", "grub", "awfu"))
    assert out[9998].score >= toxicity.THRESHOLD and [(s.start, s.end) for s in out[9998].spans] == [(0, 11)]
    assert out[9999].score == out[None].score < toxicity.THRESHOLD
    digest = toxicity.digest(toxicity.score(docs, labels))
    held = {r.doc_id: r.held_out for r in digest.collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows) and held[None] is False


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    buf = np.frombuffer(b"one two three four\ntwo\nfive two one one six", dtype=np.uint8)
    w = toxicity.words_in(buf, np.array([0, 19, 23]))
    f = toxicity.Field(weight=rng.normal(0, 1, toxicity.FEATURES), begin=rng.normal(0, 1, 2), move=rng.normal(0, 1, (2, 2)))
    f.weight[0] = 0
    p, both = f.marginals(w)
    lift = f.weight[w.features].sum(axis=1)[w.form]
    exp, pairs = [], np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(w.doc == d)
        total, ones = 0.0, np.zeros(len(at))
        moves = np.zeros((2, 2))
        for bits in range(1 << len(at)):
            y = [bits >> k & 1 for k in range(len(at))]
            q = math.exp(f.begin[y[0]] + sum(lift[a] * v for a, v in zip(at, y)) + sum(f.move[u, v] for u, v in zip(y, y[1:])))
            total += q
            ones += q * np.array(y)
            for u, v in zip(y, y[1:]):
                moves[u, v] += q
        exp += (ones / total).tolist()
        pairs += moves / total
    assert np.allclose(p, exp) and np.allclose(both, pairs)


def test_long_chain_equals_short_steps():
    rng = np.random.default_rng(5)
    m = [rng.random(5000) + 0.01 for _ in range(4)]
    a0, a1 = toxicity._forward(m)
    s = np.array([0.5, 0.5])
    for t in range(5000):
        s = s @ np.array([[m[0][t], m[1][t]], [m[2][t], m[3][t]]])
        s /= s.sum()
        assert abs(s[1] - a1[t]) < 1e-9 and abs(s[0] - a0[t]) < 1e-9


def test_without_labels_or_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}
    assert toxicity.score(no_docs, one).count() == 0
    assert toxicity.digest(toxicity.score(docs, one)).count() == len(ROWS)


def test_held_out_accuracy(spark):
    d = SF_SMALL.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity.digest(toxicity.score(docs, labels)).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in out)
    assert hit >= 0.88 * sum(r.toxic for r in out)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in out) <= 0.02 * sum(r.toxic == 0 for r in out)
