"""Toxicity by a linear-chain conditional random field that tags toxic words.

A classifier fitted on a bounded sample: at most about ``MAX_PER_LABEL`` labelled documents of each
label, those with the smallest hashes of their ids, of up to ``MAX_BYTES`` bytes.  Document labels
become word labels by a cover: among the features of words (the word, its first and last bytes)
that hardly occur in clean documents, the one that stands in most toxic documents is taken as a
marker, the documents it stands in count half from then on, and so forth while a marker still
stands in the equivalent of ``LEAST_DOCS`` documents.  Words of toxic documents with a marker are
labelled 1, all others 0.

The field has two states, a weight per hashed feature and transition weights, fitted by gradient
steps on the exact likelihood.  Forward and backward messages are products of 2 x 2 matrices, one
per word; all words of a slice of texts are one chain that is reset at each text, cut in blocks
that advance together.  The marginals of a document give its score (a logistic function of the
highest marginal and of the expected number of toxic words, fitted on a third of the sample that
the field has not seen) and its toxic
stretches: code point offsets of neighbouring words with marginal 0.5 or more.

Only the text is an input of a score.  Whole texts are scored, in slices.  Null and empty texts,
and texts without words, have no toxic word and get the score of that.  A label that is null is
ignored; where rows of one id differ in label, 1 counts.  If the sample lacks a label, every score
is the share of label 1 in it (0 without labels).  Repeated ids get a row each, a null id is not
held out, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import joined, prefix_hash, range_hash, schema_with, shards, text_bytes, words_of

SLICE_BYTES = 4 << 20
#: Bound of the sample that the model is fitted on: documents of each label, bytes of one.
MAX_PER_LABEL, MAX_BYTES = 1200, 16_000
#: Hashed features, and the lengths in bytes of the prefixes and suffixes among them.
FEATURES, PREFIXES, SUFFIXES = 1 << 19, (3, 4, 5, 6, 7, 8), (3, 4)
#: A marker stands in so many toxic documents, counted by what is left of them, and in at most this
#: share as many clean ones.
LEAST_DOCS, CLEAN_SHARE, MAX_MARKERS = 4.0, 0.05, 400
EPOCHS, RATE, DECAY = 30, 0.5, 1e-3
THRESHOLD = 0.3
TAGGED = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of the Latin letters of one and two bytes; lengths stay."""
    out = _LOWER[buf]
    second = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    out[second] += 0x20
    return out


@dataclass
class Words:
    """Words of a buffer of texts: places, text of each, number of its form; features by form."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    form: np.ndarray
    features: np.ndarray  # forms x features, 0: none

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if len(self.doc) else np.zeros(0, bool)


def words_in(buf: np.ndarray, starts: np.ndarray) -> Words:
    low = lowered(buf)
    a, b = words_of(low, _LETTER)
    prefix = prefix_hash(low)
    hashes = range_hash(prefix, a, b)
    _, where, form = np.unique(hashes, return_index=True, return_inverse=True)
    a1, b1 = a[where], b[where]
    length = b1 - a1
    cols = [(range_hash(prefix, a1, b1), np.ones(len(a1), bool))]
    cols += [(range_hash(prefix, a1, np.minimum(a1 + k, b1)), length > k) for k in PREFIXES]
    cols += [(range_hash(prefix, np.maximum(b1 - k, a1), b1), length > k) for k in SUFFIXES]
    features = np.zeros((len(a1), len(cols)), dtype=np.int32)
    for i, (h, given) in enumerate(cols):
        h = h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        features[:, i] = np.where(given, 1 + (h >> np.uint64(33)) % np.uint64(FEATURES - 1), 0)
    return Words(a, b, np.searchsorted(starts, a, side="right") - 1, form, features)


def _times(w: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Products of 2 x 2 matrices, given by their four entries, each scaled to sum 1."""
    out = [w[0] * b[0] + w[1] * b[2], w[0] * b[1] + w[1] * b[3], w[2] * b[0] + w[3] * b[2], w[2] * b[1] + w[3] * b[3]]
    total = out[0] + out[1] + out[2] + out[3]
    return [x / total for x in out]


def _forward(m: list[np.ndarray], begin: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors a[t] = a[t-1] m[t], each scaled to sum 1, with a[-1] = begin; m by its four entries.

    The chain is cut in blocks that advance together; the products of whole blocks are a shorter
    chain, which gives the vector that each block starts with."""
    n = len(m[0])
    size = max(1, round(n ** (1 / 3)))
    if n <= 32:
        size = n
    count = -(-n // size) if n else 0
    if not count:
        return np.zeros(0), np.zeros(0)
    blocks = []
    for i, x in enumerate(m):
        full = np.full(size * count, float(i in (0, 3)))
        full[:n] = x
        blocks.append(np.ascontiguousarray(full.reshape(count, size).T))
    s0, s1 = np.full(count, begin[0]), np.full(count, begin[1])
    if count > 1:
        whole = [b[0] for b in blocks]
        for k in range(1, size):
            whole = _times(whole, [b[k] for b in blocks])
        after = _forward(whole, begin)
        s0[1:], s1[1:] = after[0][:-1], after[1][:-1]
    out = np.empty((2, size, count))
    for k in range(size):
        n0, n1 = s0 * blocks[0][k] + s1 * blocks[2][k], s0 * blocks[1][k] + s1 * blocks[3][k]
        total = n0 + n1
        s0, s1 = n0 / total, n1 / total
        out[0, k], out[1, k] = s0, s1
    return out[0].T.ravel()[:n], out[1].T.ravel()[:n]


@dataclass
class Field:
    """Weights of the features (for state 1 against 0), of the first state and of the transitions."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic weights of a document: constant, highest marginal, expected number of toxic words.
    doc: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Share of label 1, the score of everything if nothing could be fitted.
    share: float | None = None

    def _chain(self, words: Words) -> list[np.ndarray]:
        """The four entries of each word's matrix: move and emission, at a text's start the same from both states."""
        lift = np.clip(self.weight[words.features].sum(axis=1), -30, 30)[words.form]
        low, high = np.exp(np.minimum(0, -lift)), np.exp(np.minimum(0, lift))
        move, begin, start = np.exp(self.move), np.exp(self.begin), words.first
        return [np.where(start, begin[j], move[i, j]) * (high if j else low) for i in (0, 1) for j in (0, 1)]

    def marginals(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Probability of state 1 per word; summed probabilities of the moves inside texts."""
        m = self._chain(words)
        a0, a1 = _forward(m)
        # backward messages are forward ones over the reversed, transposed chain
        b0, b1 = np.ones((2, len(a0)))
        if len(a0) > 1:
            r0, r1 = _forward([m[i][:0:-1] for i in (0, 2, 1, 3)])
            b0[:-1], b1[:-1] = r0[::-1], r1[::-1]
        p0, p1 = a0 * b0, a1 * b1
        both = [a[:-1] * m[2 * i + j][1:] * b[1:] for i, a in enumerate((a0, a1)) for j, b in enumerate((b0, b1))]
        total = both[0] + both[1] + both[2] + both[3]
        inside = ~words.first[1:]
        return p1 / (p0 + p1), np.array([(x[inside] / total[inside]).sum() for x in both]).reshape(2, 2)

    def fit(self, words: Words, label: np.ndarray) -> None:
        """Adaptive gradient steps on the mean log-likelihood of the word labels."""
        forms = len(words.features)
        first = words.first
        pair = ~first[1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][pair], label[1:][pair]), 1)
        opened = np.bincount(label[first], minlength=2)
        flat = words.features.ravel()
        sums = [np.full(x.shape, 1e-8) for x in (self.weight, self.begin, self.move)]
        for _ in range(EPOCHS):
            p, both = self.marginals(words)
            by_form = np.bincount(words.form, label - p, minlength=forms)
            g = np.bincount(flat, np.repeat(by_form, words.features.shape[1]), minlength=FEATURES) - DECAY * self.weight
            g[0] = 0
            start = np.array([(1 - p[first]).sum(), p[first].sum()])
            for x, grad, s in zip((self.weight, self.begin, self.move), (g, opened - start, seen - both), sums):
                s += grad * grad
                x += RATE * grad / np.sqrt(s)

    def summary(self, p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Per text: 1, the logit of the highest marginal, log(1 + expected number of toxic words)."""
        most = np.zeros(n_docs)
        np.maximum.at(most, doc, p)
        most = np.clip(most, 1e-6, 1 - 1e-6)
        expected = np.bincount(doc, np.where(p > 0.1, p, 0), minlength=n_docs)
        return np.stack([np.ones(n_docs), np.log(most / (1 - most)), np.log1p(expected)], axis=1)

    def fit_scores(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> None:
        """Logistic regression by Newton's steps."""
        keep = np.diag([1e-6, ridge, ridge])
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))
            hess = (x * (q * (1 - q))[:, None]).T @ x + keep + 1e-9 * np.eye(3)
            self.doc = self.doc + np.linalg.solve(hess, x.T @ (y - q) - keep @ self.doc)
        self.doc[1:] = np.maximum(self.doc[1:], 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))


def markers(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents, by the cover described above, as a flag per feature."""
    wide = words.features.shape[1]
    pairs = np.unique((np.repeat(words.doc, wide).astype(np.int64) * FEATURES) + words.features[words.form].ravel())
    doc, feat = pairs // FEATURES, pairs % FEATURES
    doc, feat = doc[feat > 0], feat[feat > 0]
    mine = toxic[doc] == 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    clean = np.bincount(feat[~mine], minlength=FEATURES) / n0
    doc, feat = doc[mine], feat[mine]
    allowed = clean <= CLEAN_SHARE * np.bincount(feat, minlength=FEATURES) / n1
    good = allowed[feat]
    doc, feat = doc[good], feat[good]
    left = np.ones(len(toxic))
    flag = np.zeros(FEATURES, dtype=bool)
    for _ in range(MAX_MARKERS):
        gain = np.bincount(feat, left[doc], minlength=FEATURES)
        gain[flag] = 0
        best = int(gain.argmax())
        if gain[best] < LEAST_DOCS:
            break
        flag[best] = True
        left[doc[feat == best]] *= 0.5
    return flag


def learn(sample: list[tuple[bytes, int]]) -> Field:
    """Field from (text, label) pairs; equal texts count once."""
    texts = sorted(set(sample), key=lambda x: hashlib.md5(x[0]).digest())
    model = Field()
    toxic = np.array([y for _, y in texts], dtype=np.int64)
    model.share = float(toxic.mean()) if len(toxic) else 0.0
    # every third text of each label fits the document scores, on marginals of words it has not taught
    rank = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic))
    apart = rank % 3 == 0
    teach, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
    if any(len(set(toxic[x].tolist())) < 2 for x in (teach, rest)):
        teach = rest = np.arange(len(texts))
        if len(set(toxic.tolist())) < 2:
            return model

    def taken(which: np.ndarray) -> Words:
        buf, starts, _ = joined(pa.array([texts[i][0] for i in which], pa.large_binary()), gap=1)
        return words_in(buf, starts)

    words = taken(teach)
    if not len(words.doc):
        return model
    model.share = None
    flag = markers(words, toxic[teach])
    label = (flag[words.features].any(axis=1)[words.form] & (toxic[teach][words.doc] == 1)).astype(np.int64)
    model.fit(words, label)
    if rest is not teach:
        words = taken(rest)
    p = model.marginals(words)[0] if len(words.doc) else np.zeros(0)
    model.fit_scores(model.summary(p, words.doc, len(rest)), toxic[rest])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """The bounded sample.  Its ids come from the labels alone; texts are read for those only."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    total = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    most = F.lit(0)
    for label, n in total.items():
        most = F.when(F.col("_toxic") == label, F.lit(min(1 << 30, (MAX_PER_LABEL << 30) // n))).otherwise(most)
    # about MAX_PER_LABEL ids of each label, whatever their number: small enough to send to every task
    ids = F.broadcast(known.where(draw < most))
    short = docs.where(F.octet_length(text_bytes()) <= MAX_BYTES).select("doc_id", text_bytes().alias("_data"))
    rows = short.join(ids, "doc_id").groupBy("doc_id", "_toxic").agg(F.min("_data").alias("_data"))
    return [(bytes(r["_data"]), r["_toxic"]) for r in rows.collect()]


def _stretches(words: Words, p: np.ndarray, starts: np.ndarray, buf: np.ndarray, n_docs: int) -> list[list[dict]]:
    """Neighbouring words of a text with marginal TAGGED or more, in code points, with the highest."""
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    tagged = np.flatnonzero(p >= TAGGED)
    if not len(tagged):
        return out
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
    new = np.ones(len(tagged), dtype=bool)
    new[1:] = (np.diff(tagged) > 1) | (np.diff(words.doc[tagged]) > 0)
    cut = np.flatnonzero(new)
    tops = np.maximum.reduceat(p[tagged], cut)
    for i, j, top in zip(tagged[cut].tolist(), tagged[np.concatenate((cut[1:], [len(tagged)])) - 1].tolist(), tops.tolist()):
        d = int(words.doc[i])
        zero = int(points[starts[d]])
        out[d].append({"start": int(points[words.start[i]]) - zero, "end": int(points[words.end[j]]) - zero, "marginal": round(top, 6)})
    return out


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score, n_words and spans (start, end, highest marginal) of every text."""
    src = docs.select(*keep, text_bytes().alias("_data"))
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled(docs, labels)))

    def run(batches):
        for part in shards(batches, "_data", SLICE_BYTES):
            buf, starts, _ = joined(part.column("_data"), gap=1)
            words = words_in(buf, starts)
            n = part.num_rows
            p = model.value.marginals(words)[0] if len(words.doc) and model.value.share is None else np.zeros(len(words.doc))
            spans = _stretches(words, p, starts, buf, n)
            score = model.value.scores(model.value.summary(p, words.doc, n))
            out = part.drop_columns(["_data"])
            count = np.bincount(words.doc, minlength=n)
            yield from pa.Table.from_arrays([*out.columns, pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(spans, pa.list_(SPAN))],
                                            names=[*out.column_names, "score", "n_words", "spans"]).to_batches()

    return src.mapInArrow(run, schema_with(src, "_data", "score double, n_words long, spans array<struct<start:long,end:long,marginal:double>>"))


def digest(scored: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))
