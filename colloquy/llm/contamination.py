"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of a task's documents.  Its words become symbols (words that no benchmark
item has all end a run; runs shorter than the shortest window cannot hold a window), the runs'
suffix array gives the Burrows-Wheeler transform, and a wavelet matrix answers ranks on it.  All
test windows are searched backward at once; occurrences are located by stepping to sampled
suffix positions, compared with the item's bytes, and merged to removal spans.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Window: ten consecutive words
of an item; an item of fewer words, but not none, is one window.  A null or empty text has no
words; an empty benchmark hits nothing; a null item_id counts as the empty string in the digest;
repeated items count once by id.  Rows are independent: repeated ids give a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import (as_rows, count_of, from_rows, joined, one_array, lower_table, prefix_hash, range_hash, schema_with, shards,
                                 text_bytes, words_of)

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Bytes of benchmark texts that are sent to the executors at once; a larger benchmark goes in slices.
SLICE_BYTES = 8 << 20
SAMPLE = 8

_LOWER = lower_table()
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def suffix_order(text: np.ndarray, run_of: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; 0 ends a run, and an earlier run's end is the smaller."""
    n = len(text)
    runs = int(run_of[-1]) + 1 if n else 0
    key = np.where(text == 0, run_of, text.astype(np.int64) + runs)
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    slots, ks, h = np.arange(n), key[sa], 1
    while True:
        head = np.ones(len(slots), dtype=bool)
        head[1:] = ks[1:] != ks[:-1]
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        single = head & np.append(head[1:], True)
        slots = slots[~single]
        if not len(slots):
            return sa
        pos = sa[slots]
        key = (rank[pos] << 32) | (rank[np.minimum(pos + h, n)] + 1)
        order = np.argsort(key, kind="stable")
        sa[slots] = pos[order]
        ks, h = key[order], 2 * h


class WaveletMatrix:
    """Ranks and symbols of a sequence: one bit array with running counts per level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.shift = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.bits, self.ones, self.zeros = [], [], []
        for s in self.shift:
            b = ((seq >> s) & 1).astype(np.int8)
            self.bits.append(b)
            self.ones.append(np.concatenate(([0], np.cumsum(b, dtype=np.int64))))
            self.zeros.append(len(b) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[b == 0], seq[b == 1]))

    def rank(self, sym: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Per position array: how often each symbol stands before its position."""
        first, at = np.zeros(len(sym), dtype=np.int64), list(at)
        for s, ones, z in zip(self.shift, self.ones, self.zeros):
            one = ((sym >> s) & 1).astype(bool)
            first = np.where(one, z + ones[first], first - ones[first])
            at = [np.where(one, z + ones[i], i - ones[i]) for i in at]
        return [i - first for i in at]

    def access(self, at: np.ndarray) -> np.ndarray:
        sym = np.zeros(len(at), dtype=np.int64)
        for s, bits, ones, z in zip(self.shift, self.bits, self.ones, self.zeros):
            one = bits[at].astype(bool)
            sym |= one.astype(np.int64) << s
            at = np.where(one, z + ones[at], at - ones[at])
        return sym


class FMIndex:
    """Backward search and location over runs of symbols 1.. that end with 0."""

    def __init__(self, text: np.ndarray, run_of: np.ndarray, sigma: int):
        self.n = len(text)
        sa = suffix_order(text, run_of)
        self.bwt = WaveletMatrix(text[sa - 1], sigma)  # before position 0: the last run's end
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        starts = np.zeros(self.n, dtype=bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0
        self.sampled = starts[sa] | (sa % SAMPLE == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, with their ranges of suffix rows."""
        who = np.arange(len(windows))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for back in range(1, windows.shape[1] + 1):
            on = np.flatnonzero(length[who] >= back)
            sym = windows[who[on], length[who[on]] - back]
            a, b = self.bwt.rank(sym, lo[on], hi[on])
            lo[on], hi[on] = self.first[sym] + a, self.first[sym] + b
            keep = lo < hi
            who, lo, hi = who[keep], lo[keep], hi[keep]
            if not len(who):
                break
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_at[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            sym = self.bwt.access(rows)
            rows = self.first[sym] + self.bwt.rank(sym, rows)[0]
            steps += 1
        return out


class Windows:
    """The benchmark's distinct windows as rows of symbols, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.items: list[set[str]] = []
        for item, text in items:
            buf = _LOWER[np.frombuffer(text, dtype=np.uint8)]
            flat = buf.tobytes()
            ids = [self.vocab.setdefault(flat[a:b], len(self.vocab) + 1) for a, b in zip(*map(np.ndarray.tolist, words_of(buf, _IS_WORD)))]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                k = seen.setdefault(tuple(ids[i:i + size]), len(seen))
                if k == len(self.items):
                    self.items.append(set())
                self.items[k].add(item)
        self.words = [b"", *self.vocab]
        self.length = np.array([len(x) for x in seen], dtype=np.int64)
        self.rows = np.zeros((len(seen), size), dtype=np.int64)
        for x, k in seen.items():
            self.rows[k, :len(x)] = x
        buf = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        hashes = range_hash(prefix_hash(buf), ends - [len(w) for w in self.words], ends)[1:]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two benchmark words share a hash: choose another multiplier")
        self.least = int(self.length.min()) if len(seen) else 0


def scan_shard(data: pa.Array, win: Windows) -> tuple[list, list, list]:
    """Per text: number of words, spans of hit words, items."""
    buf, starts, ends = joined(data, gap=1)
    buf = _LOWER[buf]
    a, b = words_of(buf, _IS_WORD)
    doc = np.searchsorted(starts, a, side="right") - 1
    n_words = np.bincount(doc, minlength=len(starts))
    spans, items = [[] for _ in range(len(starts))], [set() for _ in range(len(starts))]
    if not len(a) or not len(win.hashes):
        return n_words.tolist(), spans, items
    h = range_hash(prefix_hash(buf), a, b)
    at = np.minimum(np.searchsorted(win.hashes, h), len(win.hashes) - 1)
    sym = np.where(win.hashes[at] == h, win.ids[at], 0)
    # runs of benchmark words inside a text, at least as long as the shortest window
    on = sym > 0
    brk = np.ones(len(a), dtype=bool)
    brk[1:] = ~(on[1:] & on[:-1] & (doc[1:] == doc[:-1]))
    head = np.flatnonzero(brk)
    length = np.diff(np.append(head, len(a)))
    keep = on[head] & (length >= win.least)
    head, length = head[keep], length[keep]
    if not len(head):
        return n_words.tolist(), spans, items
    run_of = np.repeat(np.arange(len(head)), length + 1)
    before = np.cumsum(length + 1) - (length + 1)
    word_at = np.arange(len(run_of)) - np.repeat(before - head, length + 1)
    text = sym[np.minimum(word_at, len(sym) - 1)]
    text[np.cumsum(length + 1) - 1] = 0
    index = FMIndex(text, run_of, len(win.words))
    who, lo, hi = index.search(win.rows, win.length)
    if not len(who):
        return n_words.tolist(), spans, items
    many = hi - lo
    rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    which, word = np.repeat(who, many), word_at[index.locate(rows)]
    flat, hits = buf.tobytes(), np.zeros(len(a) + 1, dtype=np.int64)
    for k, w in zip(which.tolist(), word.tolist()):
        size = int(win.length[k])
        if all(flat[a[w + j]:b[w + j]] == win.words[win.rows[k, j]] for j in range(size)):
            hits[w] += 1
            hits[w + size] -= 1
            items[doc[w]] |= win.items[k]
    hit = np.cumsum(hits[:-1]) > 0
    cut = np.flatnonzero(hit)
    if len(cut):
        fresh = np.ones(len(cut), dtype=bool)
        fresh[1:] = (np.diff(cut) > 1) | (doc[cut[1:]] != doc[cut[:-1]])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(cut)) - 1
        for i, j in zip(cut[first].tolist(), cut[last].tolist()):
            d = int(doc[i])
            spans[d].append((int(a[i] - starts[d]), int(b[j] - starts[d]), j - i + 1))
    return n_words.tolist(), spans, items


def _slices(benchmark: DataFrame) -> list[Windows]:
    """Windows of the benchmark, in slices of bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t"))
    n = count_of(items.agg(F.sum(F.octet_length("t"))).first()[0], SLICE_BYTES)
    return [Windows([(r.i or "", bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()])
            for k in range(n)]


SPAN = "array<struct<start:int,end:int,words:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_words, spans (byte ranges of merged hits, with their
    word counts) and items (sorted ids) per row.  No shuffle: shards are parts of scan tasks."""
    windows = _slices(benchmark)
    sent = [docs.sparkSession.sparkContext.broadcast(w) for w in windows]
    src = docs.select(*keep, text_bytes().alias("_data"))

    def run(batches):
        for part in shards(batches, "_data", SHARD_BYTES):
            data = one_array(part.column("_data"))
            n_words, spans, items = scan_shard(data, sent[0].value)
            for w in sent[1:]:
                _, more, found = scan_shard(data, w.value)
                spans = [_merge(x + y, bytes(t.as_py())) if y else x for x, y, t in zip(spans, more, data)]
                items = [x | y for x, y in zip(items, found)]
            out = part.drop_columns(["_data"]).combine_chunks()
            cols = [*out.columns, pa.array(n_words, pa.int64()),
                    pa.array([[{"start": a, "end": b, "words": c} for a, b, c in s] for s in spans],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield from pa.Table.from_arrays(cols, names=[*out.column_names, "n_words", "spans", "items"]).to_batches()

    return src.mapInArrow(run, schema_with(src, "_data", f"n_words long, spans {SPAN}, items array<string>"))


def _merge(spans: list[tuple[int, int, int]], text: bytes) -> list[tuple[int, int, int]]:
    """Union of spans found by different slices, words counted anew."""
    out: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    count = lambda a, b: len(words_of(_LOWER[np.frombuffer(text[a:b], dtype=np.uint8)], _IS_WORD)[0])
    return [(a, b, count(a, b)) for a, b in out]


def digest(found: DataFrame) -> DataFrame:
    """Contract columns of a scan."""
    n_hit = F.aggregate(F.transform("spans", lambda s: s["words"].cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit passages cut out of their texts (columns as given); other rows stay."""
    found = scan(as_rows(docs), benchmark, ("row",))
    data, cuts = F.col("row.text").cast("binary"), F.col("spans")
    begin = F.concat(F.array(F.lit(0)), cuts["end"])
    end = F.concat(cuts["start"], F.array(F.octet_length(data)))
    pieces = F.zip_with(begin, end, lambda a, b: F.substring(data, a + 1, b - a))
    kept = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y)).cast("string")
    return from_rows(found, F.when(F.size(cuts) > 0, kept).otherwise(F.col("row.text")))
