"""Periodic runs of words, seeded by a Kruskal sweep over descending common prefixes.

Words are maximal stretches without white space.  A run is a stretch of consecutive words with
smallest period q, at least max(12, 2 * q) long, that no neighbouring word extends.  Its start s
and s + q share a prefix of length - q >= 6 words, so only words whose next six words come again
in the text can take part; every such position is kept and all others cannot matter.

Per slice of texts: those positions (and the ones six further, where their comparison goes on)
are ordered by prefix doubling from six words up; the ranks of every doubling give the common
prefix of neighbours exactly.  Neighbours are then united by decreasing common prefix L, with
union-find over ordered position sets, the smaller set going into the larger.  Two positions
i < j that become neighbours in a set at L have exactly L words in common; j - i <= L seeds the
stretch [i, j + L) with period j - i, and if the words before i and j differ it is a run.  The
period is the smallest: a smaller one would have put a position between them at a higher L.

Rows are independent, so there is no shuffle and no group; a task holds one slice of texts, or one
text if that is longer.  A null text has no words, and texts without runs keep their words (parted
by one space); an empty table gives no rows.  Repeated rows give a row each, a null id is passed
on, other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import MIX, MULT, binary_array, prefix_hash, range_hash, schema_with, shards, text_bytes, words_of

SLICE_BYTES = 4 << 20
#: A run has at least so many words, and two periods.
LEAST = 12
#: Hence its start and the word a period later share at least half of that.
PREFIX = LEAST // 2

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth text, by the crc32 of its id, repeat from a word on with some period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose next PREFIX words stand in the same text and come again there."""
    n = len(hashes) - PREFIX + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    window = doc[:n].astype(np.uint64) + np.uint64(1)
    for t in range(PREFIX):
        window *= np.uint64(MULT)
        window += hashes[t:t + n]
        window ^= window >> np.uint64(31)
    inside = np.flatnonzero(doc[:n] == doc[PREFIX - 1:])
    order = inside[np.argsort(window[inside])]
    same = window[order][1:] == window[order][:-1]
    return np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])


class Suffixes:
    """Suffixes of many texts in lexicographic order, from the positions that can start a run.

    ``word`` has the word numbers of all texts, each text followed by a 0 and the first preceded by
    one; ``end`` has the place of its text's 0 for every place."""

    def __init__(self, word: np.ndarray, end: np.ndarray, starts: np.ndarray):
        self.word = word
        self.place = np.unique(np.concatenate((starts, np.minimum(starts + PREFIX, end[starts]))))
        self.where = np.full(len(word) + 1, -1, dtype=np.int32)
        self.where[self.place] = np.arange(len(self.place), dtype=np.int32)
        last = end[self.place]
        at = [word[np.minimum(self.place + t, last)].astype(np.int64) for t in range(PREFIX)]
        keys = [a << 32 | b for a, b in zip([last, *at[1::2]], [*at[0::2], np.int64(0)])]
        self.order = np.lexsort(keys[::-1])
        changed = np.zeros(len(self.order), dtype=bool)
        changed[:1] = True
        for k in keys:
            k = k[self.order]
            changed[1:] |= k[1:] != k[:-1]
        self.levels = [self._ranks(changed)]
        while self._double():
            pass

    def _ranks(self, changed: np.ndarray) -> np.ndarray:
        """Rank of a place: the first index of its group in the order."""
        first = np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))
        rank = np.empty(len(changed), dtype=np.int32)
        rank[self.order] = first
        return rank

    def _double(self) -> bool:
        """Order the groups of equal prefixes by the prefixes that follow; False if all differ."""
        rank, step = self.levels[-1], PREFIX << (len(self.levels) - 1)
        sorted_rank = rank[self.order]
        tied = np.zeros(len(rank), dtype=bool)
        tied[1:] = sorted_rank[1:] == sorted_rank[:-1]
        tied[:-1] |= tied[1:]
        if not tied.any():
            return False
        at = np.flatnonzero(tied)
        mine = self.order[at]
        key = rank[mine].astype(np.int64) << 32 | rank[self.where[self.place[mine] + step]]
        by = np.argsort(key, kind="stable")
        self.order[at] = mine[by]
        key = key[by]
        new = rank.copy()
        changed = np.ones(len(at), dtype=bool)
        changed[1:] = key[1:] != key[:-1]
        new[self.order[at]] = np.maximum.accumulate(np.where(changed, at, 0))
        self.levels.append(new)
        return True

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in the order that share PREFIX words or more: two places, common prefix."""
        first = self.levels[0][self.order]
        k = np.flatnonzero(first[1:] == first[:-1])
        a, b = self.place[self.order[k]], self.place[self.order[k + 1]]
        common = np.zeros(len(k), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            x, y = self.where[a + common], self.where[b + common]
            equal = (x >= 0) & (y >= 0) & (rank[x] == rank[y])
            common[equal] += PREFIX << level
        going = np.ones(len(k), dtype=bool)
        for _ in range(PREFIX - 1):
            going &= self.word[a + common] == self.word[b + common]
            common[going] += 1
        return a, b, common


def sweep(a: np.ndarray, b: np.ndarray, common: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (place, length, period) from the pairs of neighbours, by decreasing common prefix."""
    by = np.argsort(-common, kind="stable")
    places, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[:len(a)][by].tolist(), index[len(a):][by].tolist()
    size, word = common[by].tolist(), word.tolist()
    parent = list(range(len(places)))
    members: list[list[int]] = [[p] for p in places.tolist()]
    found = []

    def seed(i: int, j: int, n: int) -> None:
        if j - i <= n and n + j - i >= LEAST and word[i - 1] != word[j - 1]:
            found.append((i, n + j - i, j - i))

    for p, q, n in zip(x, y, size):
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if len(members[p]) < len(members[q]):
            p, q = q, p
        parent[q] = p
        large, small, before = members[p], members[q], -1
        for m, after in zip(small, [*small[1:], len(word)]):
            k = bisect_left(large, m)
            if k and large[k - 1] != before:  # only neighbours from the other set are new
                seed(large[k - 1], m, n)
            if k < len(large) and large[k] < after:
                seed(m, large[k], n)
            large.insert(k, m)
            before = m
        members[q] = []
    return found


def runs_of(texts: list[bytes], counts: list[int]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period; ``counts`` are the words."""
    out: list[list] = [[] for _ in texts]
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    first, last = words_of(buf, _WORD)
    if len(first) < LEAST:
        return out
    hashes = range_hash(prefix_hash(buf), first, last)
    hashes ^= hashes >> np.uint64(29)
    hashes *= MIX
    n_words = np.array(counts, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    starts = _repeated(hashes, doc)
    if not len(starts):
        return out
    # only texts with such positions go on, each followed by a place for its end
    used = np.unique(doc[starts])
    new = np.full(len(texts), -1, dtype=np.int64)
    new[used] = np.arange(len(used))
    mine = new[doc] >= 0
    place = np.cumsum(mine) + new[doc]  # place 0 stands before the first text
    length = n_words[used]
    end = np.cumsum(length + 1)
    word = np.zeros(int(end[-1]) + 1, dtype=np.int32)
    word[place[mine]] = np.unique(hashes[mine], return_inverse=True)[1] + 1
    end_at = np.concatenate(([0], np.repeat(end, length + 1)))
    pairs = Suffixes(word, end_at, place[starts]).neighbours()
    begin = end - length
    for at, n, period in sorted(sweep(*pairs, word), key=lambda r: (r[0], r[2])):
        d = int(np.searchsorted(end, at))
        out[used[d]].append((at - int(begin[d]), n, period))
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, parted by one space."""
    words = text.split()
    gone = np.zeros(len(words) + 1, dtype=np.int32)
    for s, n, period in runs:
        gone[s + period] += 1
        gone[s + n] -= 1
    return b" ".join(compress(words, (np.cumsum(gone)[:-1] == 0).tolist()))


def detect(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the text with every run cut to its first
    period, per row of ``docs``; ``change`` may rewrite the words first."""
    src = docs.select("doc_id", text_bytes().alias("_data"))

    def run(batches):
        for part in shards(batches, "_data", SLICE_BYTES):
            words = [x.split() for x in part.column("_data").to_pylist()]
            if change is not None:
                words = [change(i, w) for i, w in zip(part.column("doc_id").to_pylist(), words)]
            counts = [len(w) for w in words]
            texts = [b" ".join(w) for w in words]
            del words
            found = runs_of(texts, counts)
            texts = [collapsed(t, r) if r else t for t, r in zip(texts, found)]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            wide = offsets[-1] >= 1 << 31
            short = pa.array(texts, pa.large_binary()) if wide else binary_array(np.frombuffer(b"".join(texts), np.uint8), offsets)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            yield from pa.Table.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.chunked_array([short])],
                                            names=["doc_id", "n_words", "runs", "collapsed"]).to_batches()

    return src.mapInArrow(run, schema_with(src, "_data", "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period), and hashes of all runs and of the kept words."""
    best = F.try_element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.n")).alias("length"),
        F.col("_best.period").alias("period"), F.expr("(1000 * -_best.n) div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
