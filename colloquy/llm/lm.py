"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Counts: every block of documents sends its distinct tokens (128-bit keys) with their training
counts to buckets by hash, and learns the corpus count of each.  The ``HEAD`` most frequent
training tokens, the end of a text, and ``BANDS`` bands of all other tokens (by their last two
bytes) are the model's classes.  The model predicts the next class: the two classes before it,
each weighted by a vector, give a predicted feature vector, whose products with all class vectors,
plus biases, are the scores.  Training passes over all training texts: each scan task runs
noise-contrastive steps from the same start, and the parameters are averaged by tokens seen.
Scoring computes the softmax over all classes for the distinct contexts of a block by matrix
products, so token probabilities are normalised; a token of a band has the band's probability
times (c + 1) / (N_band + V_band + 1), which leaves one part for all unseen tokens.

Tokens: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``, then one end per text.  Null and empty texts have
the end only.  A text is held out if crc32 of its id as text (null: empty) mod 7 is 2.  Rows that
repeat an id are documents of their own.  An empty table gives no rows; with no training texts
all counts are 0 and the model is uniform over its classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import MIX, binary_array, count_of, joined, one_array, lower_table, prefix_hash, range_hash, shards, spread, stage, text_bytes

BLOCK_BYTES = 4 << 20
HEAD, BANDS, DIM = 1000, 64, 16
BATCH, NOISE, RATE = 8192, 32, 0.05
HOLD_OUT, FOLDS = 2, 7

_LOWER = lower_table()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x9, 0xE)]] = False


@dataclass
class Tokens:
    """Words of a buffer of texts, the end of each text after its words."""

    key: np.ndarray
    more: np.ndarray  # second part of the key: length and first bytes
    band: np.ndarray
    text: np.ndarray  # number of the text of each token
    end: np.ndarray  # whether the token is an end


def tokens(data: pa.Array) -> Tokens:
    buf, starts, ends = joined(data, gap=1)
    buf = _LOWER[buf]
    flag = _IS_WORD[buf]
    flag[ends] = False
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    text = np.searchsorted(starts, a, side="right") - 1
    key = range_hash(prefix_hash(buf), a, b)
    key ^= key >> np.uint64(32)
    key *= MIX
    wide = np.concatenate((buf, np.zeros(8, np.uint8)))
    size = b - a
    more = np.minimum(size, 0xFFFF).astype(np.uint64)
    for k in range(6):
        more = (more << np.uint64(8)) | np.where(size > k, wide[a + k], 0).astype(np.uint64)
    band = (buf[b - 1].astype(np.int64) * 31 + np.where(size > 1, buf[np.maximum(b - 2, 0)], 0).astype(np.int64) * 7) % BANDS
    # put an end after the words of each text
    count = np.bincount(text, minlength=n)
    total = len(a) + n
    end = np.zeros(total, dtype=bool)
    end[np.cumsum(count) + np.arange(n)] = True
    out = []
    for x in (key, more, band):
        y = np.zeros(total, dtype=x.dtype)
        y[~end] = x
        out.append(y)
    return Tokens(*out, np.repeat(np.arange(n), count + 1), end)


def _distinct(t: Tokens, buckets: int, train: np.ndarray):
    """Distinct words in (bucket, key) order: positions of one occurrence, number of each word
    token, buckets, training counts."""
    word = np.flatnonzero(~t.end)
    _, first, which = np.unique(t.key[word], return_index=True, return_inverse=True)
    to = spread(t.key[word[first]], buckets)
    order = np.argsort(to, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    which = place[which]
    count = np.bincount(which[train[t.text[word]]], minlength=len(order))
    return word[first][order], word, which, to[order], count


@dataclass
class Model:
    n: int  # training tokens, ends included
    v: int
    ends: int
    head_key: np.ndarray
    head_more: np.ndarray
    head_count: np.ndarray
    band_n: np.ndarray
    band_v: np.ndarray
    params: np.ndarray | None = None

    @property
    def classes(self) -> int:
        return len(self.head_key) + BANDS + 1

    def class_of(self, t: Tokens) -> np.ndarray:
        """Head tokens by place, then the bands, the end last."""
        h = len(self.head_key)
        out = t.band + h
        if h:
            at = np.minimum(np.searchsorted(self.head_key, t.key), h - 1)
            hit = (self.head_key[at] == t.key) & (self.head_more[at] == t.more) & ~t.end
            out = np.where(hit, at, out)
        out[t.end] = self.classes - 1
        return out

    def noise(self) -> np.ndarray:
        count = np.concatenate((self.head_count, self.band_n, [self.ends])).astype(np.float64) + 1
        return count / count.sum()


class LogBilinear:
    """Class vectors in contexts (r), as targets (q), biases (b), and context weights (c)."""

    def __init__(self, classes: int, prior: np.ndarray):
        rng = np.random.default_rng(5)
        self.r = rng.normal(0, 0.1, (classes, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (classes, DIM)).astype(np.float32)
        self.b = np.log(prior).astype(np.float32)
        self.c = np.full((2, DIM), 0.5, dtype=np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)])

    def load(self, flat: np.ndarray) -> "LogBilinear":
        at = 0
        for name in ("r", "q", "b", "c"):
            x = getattr(self, name)
            setattr(self, name, flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c[0] + self.r[two] * self.c[1]


def contexts(cls: np.ndarray, t: Tokens, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; the end stands before a text."""
    def before(k):
        out = np.full(len(cls), end, dtype=cls.dtype)
        out[k:][t.text[k:] == t.text[:-k]] = cls[:-k][t.text[k:] == t.text[:-k]]
        return out
    return before(1), before(2)


def _sum_rows(grad: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[head], np.add.reduceat(grad[order], head, axis=0)


class Trainer:
    """Noise-contrastive steps with per-parameter rates (Adagrad)."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.cum = np.cumsum(noise)
        self.sq = {k: np.full_like(getattr(model, k), 1e-4) for k in ("r", "q", "b", "c")}
        self.seen = 0

    def _step(self, name: str, ids, grad) -> None:
        x, sq = getattr(self.m, name), self.sq[name]
        sq[ids] += grad * grad
        x[ids] += RATE * grad / np.sqrt(sq[ids])

    def batch(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), len(self.cum) - 1)
        h1, h2 = m.r[one], m.r[two]
        hat = h1 * m.c[0] + h2 * m.c[1]
        q = m.q[target]
        good = np.einsum("ij,ij->i", hat, q) + m.b[target] - self.log_noise[target]
        bad = hat @ m.q[noise].T + (m.b[noise] - self.log_noise[noise])
        g = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        w = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        d_hat = g[:, None] * q + w @ m.q[noise]
        scale = 1 / np.sqrt(n)
        ids, grad = _sum_rows(np.concatenate((hat * g[:, None], g[:, None]), axis=1), target)
        nids, ngrad = _sum_rows(np.concatenate((w.T @ hat, w.sum(axis=0)[:, None]), axis=1), noise)
        rids, rgrad = _sum_rows(np.concatenate((d_hat * m.c[0], d_hat * m.c[1])), np.concatenate((one, two)))
        cgrad = np.stack(((d_hat * h1).sum(axis=0), (d_hat * h2).sum(axis=0)))
        for i, x in ((ids, grad * scale), (nids, ngrad * scale)):
            self._step("q", i, x[:, :DIM])
            self._step("b", i, x[:, DIM])
        self._step("r", rids, rgrad * scale)
        self._step("c", slice(None), cgrad * scale)
        self.seen += n


def _held(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HOLD_OUT


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    rows = docs.select("doc_id", _held(docs).alias("held_out"), text_bytes().alias("data"))
    n = count_of(rows.agg(F.sum(F.octet_length("data") + 8)).first()[0], block_bytes)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")), n


def _ordered(t: pa.Table) -> pa.Table:
    """Rows of a block in one order, whatever order they came in."""
    ids, data = t.column("doc_id").to_pylist(), t.column("data").to_pylist()
    return t.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, data[i])), pa.int64()))


def count_tokens(blocks: DataFrame, n_buckets: int, head: int) -> DataFrame:
    """Table (block, bucket, counts, top, bands): corpus counts of each block's distinct tokens, and
    for each bucket (block null) its most frequent tokens and the sums of its bands."""
    def send(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        tok = tokens(one_array(t.column("data")))
        first, _, _, to, count = _distinct(tok, n_buckets, ~np.asarray(t.column("held_out")))
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        off = np.append(at, len(to))
        block = t.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(to[at], pa.int32()), "block": pa.array(np.full(len(at), block), pa.int32()),
                         "key": binary_array(tok.key[first].view(np.uint8), off * 8), "more": binary_array(tok.more[first].view(np.uint8), off * 8),
                         "band": binary_array(tok.band[first].astype(np.uint8), off),
                         "count": binary_array(count.astype(np.uint32).view(np.uint8), off * 4)})

    top = pa.list_(pa.struct([("key", pa.int64()), ("more", pa.int64()), ("band", pa.int32()), ("c", pa.int64())]))
    bands = pa.list_(pa.struct([("band", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))

    def total(t: pa.Table) -> pa.Table:
        # a block may send to a bucket once only, so order is by block
        t = t.sort_by("block")
        read = lambda c, kind: np.frombuffer(joined(t.column(c))[0].tobytes(), dtype=kind)
        key, more, band, count = read("key", np.uint64), read("more", np.uint64), read("band", np.uint8), read("count", np.uint32)
        order = np.lexsort((more, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        c = np.bincount(number, weights=count, minlength=int(new.sum())).astype(np.int64)
        one = order[new]
        size = np.array([len(x) for x in t.column("key").to_pylist()]) // 8
        off = np.append(0, np.cumsum(size))
        best = np.lexsort((key[one], -c))[:head]
        best = best[c[best] > 0]
        known = c > 0
        bn = np.bincount(band[one], weights=c, minlength=BANDS).astype(np.int64)
        bv = np.bincount(band[one][known], minlength=BANDS)
        m = t.num_rows
        sums = [{"band": int(i), "n": int(bn[i]), "v": int(bv[i])} for i in np.flatnonzero(bv)]
        tops = [{"key": int(key[one[i]].view(np.int64)), "more": int(more[one[i]].view(np.int64)), "band": int(band[one[i]]), "c": int(c[i])} for i in best]
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"block": pa.array([*t.column("block").to_pylist(), None], pa.int32()), "bucket": pa.array([bucket] * (m + 1), pa.int32()),
                         "counts": pa.array([*(x.as_py() for x in binary_array(c[number].view(np.uint8), off * 8)), None], pa.binary()),
                         "top": pa.array([None] * m + [tops], top), "bands": pa.array([None] * m + [sums], bands)})

    sent = blocks.groupBy("block").applyInArrow(send, "bucket int, block int, key binary, more binary, band binary, count binary")
    return sent.groupBy("bucket").applyInArrow(
        total, "block int, bucket int, counts binary, top array<struct<key:long,more:long,band:int,c:long>>, bands array<struct<band:int,n:long,v:long>>")


def summarise(counted: DataFrame, ends: int, head: int) -> Model:
    """Corpus totals, the head and the bands without it."""
    top = (counted.where("top is not null").select(F.explode("top").alias("t")).select("t.*")
           .orderBy(F.desc("c"), "key", "more").limit(head).collect())
    band_n, band_v = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
    for r in (counted.where("bands is not null").select(F.explode("bands").alias("b")).groupBy("b.band")
              .agg(F.sum("b.n").alias("n"), F.sum("b.v").alias("v")).collect()):
        band_n[r.band], band_v[r.band] = r.n, r.v
    n, v = int(band_n.sum()) + ends, int(band_v.sum()) + (ends > 0)
    for r in top:
        band_n[r.band] -= r.c
        band_v[r.band] -= 1
    key = np.array([r.key for r in top], dtype=np.int64).view(np.uint64)
    more = np.array([r.more for r in top], dtype=np.int64).view(np.uint64)
    c = np.array([r.c for r in top], dtype=np.int64)
    order = np.argsort(key)
    return Model(n, v, ends, key[order], more[order], c[order], band_n, band_v)


def train(docs: DataFrame, model: Model, partials: int = 64) -> Model:
    """One pass of noise-contrastive estimation over all training texts; parameters averaged."""
    noise = model.noise()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext
        m = sent.value
        trainer = Trainer(LogBilinear(m.classes, noise), noise, TaskContext.get().partitionId())
        for part in shards(batches, "data", BLOCK_BYTES):
            t = tokens(one_array(part.column("data")))
            cls = m.class_of(t)
            one, two = contexts(cls, t, m.classes - 1)
            for a in range(0, len(cls), BATCH):
                trainer.batch(one[a:a + BATCH], two[a:a + BATCH], cls[a:a + BATCH])
        if trainer.seen:
            flat = trainer.m.flat().astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % partials], pa.int32()), pa.array([trainer.seen], pa.int64()),
                                              pa.array([flat.tobytes()], pa.binary())], names=["part", "seen", "params"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in t.column("params").to_pylist())
        return pa.table({"part": t.column("part")[:1], "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()),
                         "params": pa.array([total.tobytes()], pa.binary())})

    rows = docs.where(~_held(docs)).select(text_bytes().alias("data"))
    schema = "part int, seen long, params binary"
    got = rows.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()
    if got:
        model.params = sum(np.frombuffer(bytes(r.params), dtype=np.float64) for r in sorted(got, key=lambda r: r.part)) / sum(r.seen for r in got)
    else:
        model.params = LogBilinear(model.classes, noise).flat()
    return model


def log_normaliser(m: LogBilinear, hat: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Logarithm of the sum over all classes, for each predicted vector."""
    out = np.empty(len(hat), dtype=np.float64)
    for a in range(0, len(hat), rows):
        s = hat[a:a + rows] @ m.q.T + m.b
        top = s.max(axis=1)
        s -= top[:, None]
        out[a:a + rows] = np.log(np.exp(s, out=s).sum(axis=1, dtype=np.float64)) + top
    return out


def token_scores(model: Model, net: LogBilinear, t: Tokens, count: np.ndarray) -> np.ndarray:
    """Natural log-probability of every token; ``count``: the token's training count."""
    cls = model.class_of(t)
    end = model.classes - 1
    one, two = contexts(cls, t, end)
    code, which = np.unique(one * model.classes + two, return_inverse=True)
    hat = net.context(code // model.classes, code % model.classes)
    z = log_normaliser(net, hat)
    out = np.empty(len(cls), dtype=np.float64)
    for a in range(0, len(cls), 1 << 18):
        b = slice(a, a + (1 << 18))
        out[b] = np.einsum("ij,ij->i", hat[which[b]], net.q[cls[b]]) + net.b[cls[b]] - z[which[b]]
    h = len(model.head_key)
    tail = (cls >= h) & ~t.end
    band = t.band[tail]
    out[tail] += np.log((count[tail] + 1) / (model.band_n[band] + model.band_v[band] + 1))
    return out


def score(docs: DataFrame, head: int = HEAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    blocks, n_blocks = _blocks(docs, block_bytes)
    counted = stage(count_tokens(blocks, n_blocks, head), "token-counts")
    ends = docs.where(~_held(docs)).count()
    model = train(docs, summarise(counted, ends, head))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        m = sent.value
        net = LogBilinear(m.classes, m.noise()).load(m.params)
        t = _ordered(t)
        tok = tokens(one_array(t.column("data")))
        held = np.asarray(t.column("held_out"))
        _, word, which, _, _ = _distinct(tok, n_blocks, ~held)
        c = np.frombuffer(joined(r.sort_by("bucket").column("counts"))[0].tobytes(), dtype=np.int64)
        count = np.full(len(tok.key), m.ends, dtype=np.int64)
        count[word] = c[which]
        n = len(held)
        by = lambda x: np.bincount(tok.text, weights=x, minlength=n)
        base = by(np.log10((count + 1) / (m.n + m.v + 1)))
        own = by(token_scores(m, net, tok, count)) / np.log(10)
        return pa.table({"doc_id": one_array(t.column("doc_id")), "held_out": pa.array(held), "n_tokens": pa.array(np.bincount(tok.text, minlength=n), pa.int64()),
                         "n_known": pa.array(by(count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, m.n), pa.int64()),
                         "base_score": pa.array(base), "score": pa.array(own)})

    replies = counted.where("block is not null").select("block", "bucket", "counts")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
