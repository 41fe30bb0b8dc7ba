"""Removal of repeated byte strings by suffix arrays (exact, 100 bytes).

A shard is a block of documents (by a hash of the id), and its suffix array is built by
Larsson-Sadakane refinement in numpy: suffixes are ordered by eight bytes, then groups of equal
suffixes are refined by the ranks of the suffixes 8, 16, 32 and 64 bytes on.  The common prefixes
of neighbours in the order, cut at 100, part it in classes of equal 100-byte
strings; the first of a class in the shard stays a candidate, the others are repeats.  Across
shards the candidates are merged by binary search: each shard's sorted keys are searched in those
of the others, equal keys are compared byte by byte, and the earlier string wins.

Only strings that can repeat are ordered: any 100 bytes hold the smallest hash among their
24-byte substrings, so each shard sends its distinct smallest hashes, and learns which of them
occur twice in the corpus and which in several shards.  Every repeated string passes this test.
The hashes also route the merge: equal strings have equal smallest hashes, and the strings of a
stretch that share one travel as one run.  Where a hash has more than ``HOT`` places in the corpus,
its strings are routed by the smallest hash among their 64-byte substrings instead: one common line in
many contexts is dealt to many tasks, and neighbouring strings still travel as one run, so the bytes
sent follow the input, however common its passages are.

Order of strings: (doc_id, null first; rows of one id by their bytes; start).  Null texts are
empty; rows that repeat an id are documents of their own, the later is a copy; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import MIX, MULT, MULT_INV, binary_array, count_of, joined, one_array, powers, prefix_hash, ragged, range_hash, spread, text_bytes

LENGTH, GRAM, LONG_GRAM = 100, 24, 64
BLOCK_BYTES = 4 << 20
#: Places of a hash whose runs one task of the merge takes.
HOT = 8192
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the three words of a gram, and what is added so that zeros do not hash to zero.
_GRAM_MULT = np.array([MULT, MIX, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_GRAM_ADD = np.uint64(0x165667B19E3779F9)
#: Positions that one step of a sweep handles: its few arrays stay in the processor's cache.
_SWEEP = 1 << 15


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number, zeros after the end."""
    wide = np.zeros(len(buf) + 7, dtype=np.uint8)
    wide[:len(buf)] = buf
    return np.ndarray(len(buf), dtype=">u8", buffer=wide, strides=(1,)).astype(np.uint64)


def suffix_array(buf: np.ndarray, depth: int, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes at least (Larsson-Sadakane refinement), and the
    rank of each; equal ranks: equal as far as compared."""
    n = len(buf)
    key = words8(buf) if key is None else key
    sa = np.argsort(key)
    ks = key[sa]
    rank = np.zeros(n + 1, dtype=np.int64)
    slots, h = np.arange(n), 8
    while True:
        head = np.ones(len(slots), dtype=bool)
        head[1:] = ks[1:] != ks[:-1]
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + 1
        if h >= depth:
            return sa, rank[:n]
        single = head & np.append(head[1:], True)
        slots = slots[~single]
        if not len(slots):
            return sa, rank[:n]
        pos = sa[slots]
        key = (rank[pos] << 32) | rank[np.minimum(pos + h, n)]
        order = np.argsort(key)
        sa[slots] = pos[order]
        ks, h = key[order], 2 * h


def common_prefixes(w8: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int, lane: int = _SWEEP) -> np.ndarray:
    """Common prefix (at most ``cap``) of each position of ``order`` with the one before it, by text
    position.  Positions of equal rank share ``cap`` bytes at least; other pairs are compared eight bytes
    at a time, ``lane`` pairs side by side.  ``cap`` bounds the steps of a pair, so nothing has to be
    carried over from the pair of the position before, as Kasai's sweep does."""
    out = np.zeros(len(w8), dtype=np.int64)
    wide = np.concatenate((w8, np.zeros(cap + 8, dtype=np.uint64)))
    for c in range(1, len(order), lane):
        i, j = order[c:c + lane], order[c - 1:c + lane - 1][:len(order) - c]
        g = np.where(rank[i] == rank[j], cap, 0)
        live = np.flatnonzero(g == 0)
        while len(live):
            x = wide[i[live] + g[live]] ^ wide[j[live] + g[live]]
            differ = x != 0
            y, same = x[differ], np.zeros(np.count_nonzero(differ), dtype=np.int8)
            for k in range(7):
                same += y < np.uint64(1 << (56 - 8 * k))
            g[live[differ]] += same
            live = live[~differ]
            g[live] += 8
            live = live[g[live] < cap]
        out[i] = np.minimum(g, cap)
    return out


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position, the greatest number where fewer are left."""
    out = np.full(len(buf), _TOP, dtype=np.uint64)
    n = len(buf) - GRAM + 1
    words = np.ndarray(max(len(buf) - 7, 0), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    for c in range(0, n, _SWEEP):
        w = words[c:min(c + _SWEEP, n) + GRAM - 8].astype(np.uint64)
        size = len(w) - GRAM + 8
        h = out[c:c + size]
        np.multiply(w[:size], _GRAM_MULT[0], out=h)
        for k in range(1, GRAM // 8):
            h += w[8 * k:8 * k + size] * _GRAM_MULT[k]
        h += _GRAM_ADD
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbouring values."""
    out = np.empty(max(len(values) - width + 1, 0), dtype=values.dtype)
    for c in range(0, len(out), _SWEEP):
        a = values[c:c + _SWEEP + width - 1]
        b, spare = np.empty(len(a), a.dtype), np.empty(len(a), a.dtype)
        span, n = 1, len(a)
        while span < width:
            step = min(span, width - span)
            n -= step
            pick(a[:n], a[step:step + n], out=b[:n])
            a, b, spare = b, spare, b
            span += step
        out[c:c + n] = a[:n]
    return out


def smallest_hashes(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray):
    """(gram hashes, smallest gram hash of the 100 bytes from each position, whether 100 bytes of one
    text start there); positions run over buf."""
    n = len(buf)
    grams = gram_hashes(buf)
    size = np.maximum(ends - starts - LENGTH + 1, 0)
    edge = np.zeros(n + 1, dtype=np.int8)  # positions where 100 bytes fit
    edge[starts[size > 0]] += 1
    edge[(starts + size)[size > 0]] -= 1
    fits = np.cumsum(edge[:-1], dtype=np.int8) > 0
    low = np.full(n, _TOP, dtype=np.uint64)
    found = sliding(grams[:max(n - GRAM + 1, 0)], LENGTH - GRAM + 1, np.minimum)
    low[:len(found)] = found
    return grams, low, fits


def sent_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct smallest hashes of a shard, and at how many further positions each stands (255: or more)."""
    grams, low, fits = smallest_hashes(buf, ends, starts)
    # a gram is chosen if it is the smallest of some 100 bytes that hold it
    most = np.zeros(len(buf) + LENGTH - GRAM, dtype=np.uint64)
    np.copyto(most[LENGTH - GRAM:], low, where=fits)
    most = sliding(most, LENGTH - GRAM + 1, np.maximum)
    chosen = (most == grams) & (most > 0)
    value, count = np.unique(grams[chosen], return_counts=True)
    return value, np.minimum(count - 1, 255).astype(np.uint8)


def long_hashes(buf: np.ndarray) -> np.ndarray:
    """Smallest hash among the ``LONG_GRAM`` byte substrings of the 100 bytes from each position that has as many."""
    prefix = prefix_hash(buf)
    grams = prefix[LONG_GRAM:] - prefix[:-LONG_GRAM]
    grams *= powers(len(grams), MULT_INV)
    return sliding(grams, LENGTH - LONG_GRAM + 1, np.minimum)


def _runs(flag: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of true positions with equal values in ``same``."""
    at = np.flatnonzero(flag)
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) > 1
    for s in same:
        value = s[at]
        new[1:] |= value[1:] != value[:-1]
    head = np.flatnonzero(new)
    return at[head], np.diff(np.append(head, len(at)))


def shard_repeats(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: np.ndarray, wide: np.ndarray):
    """(repeats, candidates, low): repeats marks starts whose 100 bytes start earlier in the shard,
    candidates those that other shards may have; ``again`` and ``wide``: sorted hashes that occur
    twice in the corpus, and in several shards."""
    grams, low, fits = smallest_hashes(buf, ends, starts)
    del grams
    head, size = _runs(fits, low)
    keep = np.isin(low[head], again, assume_unique=False)
    head, size = head[keep], size[keep]
    may = np.zeros(len(buf), dtype=bool)
    may[ragged(head, size)] = True
    repeats = np.zeros(len(buf), dtype=bool)
    if not len(head):
        return repeats, may, low
    # the bytes under the candidates, put together
    edge = np.zeros(len(buf) + 1, dtype=np.int32)
    np.add.at(edge, head, 1)
    np.add.at(edge, head + size - 1 + LENGTH, -1)
    cover = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32) > 0)
    text, start_here = buf[cover], may[cover]
    w8 = words8(text)
    sa, rank = suffix_array(text, LENGTH, w8)
    order = sa[start_here[sa]]
    lcp = common_prefixes(w8, order, rank, LENGTH)
    first = lcp[order] < LENGTH
    first[0] = True
    group = np.flatnonzero(first)
    low_pos = np.minimum.reduceat(order, group)
    repeats[cover[order]] = True
    repeats[cover[low_pos]] = False
    may &= ~repeats
    head, size = _runs(may, low)
    keep = np.isin(low[head], wide)
    may[:] = False
    may[ragged(head[keep], size[keep])] = True
    return repeats, may, low


def merge_shards(keys: list[np.ndarray], places: list[np.ndarray], equal) -> np.ndarray:
    """Merge sorted key lists of shards (unique in each) by binary search; ``places`` order the
    strings in the corpus.  Returns the places that have an earlier equal string."""
    lost = []
    lists = [(len(k), i, k, p) for i, (k, p) in enumerate(zip(keys, places))]
    heapq.heapify(lists)
    while len(lists) > 1:
        (_, _, ka, pa_), (_, i, kb, pb) = heapq.heappop(lists), lists[0]
        at = np.searchsorted(kb, ka)
        hit = at < len(kb)
        hit[hit] = kb[at[hit]] == ka[hit]
        mine, other = pa_[hit], pb[at[hit]]
        equal(mine, other)
        lost.append(np.maximum(mine, other))
        pb = pb.copy()
        pb[at[hit]] = np.minimum(mine, other)
        rest, where = ka[~hit], at[~hit]
        out_k, out_p = np.empty(len(kb) + len(rest), kb.dtype), np.empty(len(kb) + len(rest), pb.dtype)
        put = where + np.arange(len(rest))
        old = np.ones(len(out_k), dtype=bool)
        old[put] = False
        out_k[put], out_p[put], out_k[old], out_p[old] = rest, pa_[~hit], kb, pb
        heapq.heapreplace(lists, (len(out_k), i, out_k, out_p))
    return np.concatenate(lost) if lost else np.zeros(0, np.int64)


class _Collision(Exception):
    pass


def merge_task(t: pa.Table) -> pa.Table:
    """Repeats among the candidate runs that were routed to one task."""
    t = t.filter(pa.array(np.asarray(t.column("n")) > 0)) if t.num_rows else t
    t = t.take(pa.array(np.argsort(t.column("block").to_numpy(), kind="stable")))
    buf, off, _ = joined(t.column("data"))
    n = t.column("n").to_numpy()
    block, tie = t.column("block").to_numpy(), t.column("tie").to_numpy()
    doc, at = t.column("doc_id"), t.column("at").to_numpy()
    null = np.asarray(doc.is_null())
    ids = doc.fill_null(0).to_numpy()
    order = np.lexsort((at, tie, ids, ~null))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    start = ragged(off, n)
    run = np.repeat(np.arange(len(n)), n)
    step = start - off[run]
    key = range_hash(prefix_hash(buf), start, start + LENGTH)
    where = (place[run] << 32) | step
    w8 = words8(buf)

    def begin(p):
        return off[order[p >> 32]] + (p & 0xFFFFFFFF)

    def equal(p, q):
        x, y = begin(p), begin(q)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            if (w8[x + k] != w8[y + k]).any():
                raise _Collision

    def merge(key):
        keys, places = [], []
        cut = (np.cumsum(n) - n)[np.flatnonzero(np.diff(block)) + 1]  # the strings of a shard stand together
        for k, w in zip(np.split(key, cut), np.split(where, cut)):
            by = np.argsort(k)
            keys.append(k[by]), places.append(w[by])
        return merge_shards(keys, places, equal)

    if not len(n):
        lost = np.zeros(0, np.int64)
    else:
        try:
            lost = merge(key)
        except _Collision:  # two strings share a hash: number the strings themselves
            rows = np.lib.stride_tricks.as_strided(buf, (len(buf) - LENGTH + 1, LENGTH), (1, 1))[start]
            lost = merge(np.unique(rows, axis=0, return_inverse=True)[1].ravel().astype(np.uint64))
    gone = np.zeros(len(start), dtype=bool)
    base = np.cumsum(n) - n
    gone[base[order[lost >> 32]] + (lost & 0xFFFFFFFF)] = True
    head, size = _runs(gone, run)
    owner = run[head]
    return _repeat_rows(block[owner], t.column("doc_id").take(pa.array(owner)), tie[owner], at[owner] + step[head], size)


def _repeat_rows(block, doc, tie, at, size) -> pa.Table:
    doc = one_array(doc)
    return pa.table({"block": pa.array(block, pa.int32()), "doc_id": doc, "tie": pa.array(tie, pa.int32()),
                     "at": pa.array(at, pa.int64()), "n": pa.array(size, pa.int64())})


def _block(t: pa.Table):
    """Documents of a block in corpus order: table, ties, buffer, starts, ends."""
    data = t.column("data").to_pylist()
    ids = t.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, data[i]))
    t = t.take(pa.array(order, pa.int64()))
    ids = [ids[i] for i in order]
    tie = np.zeros(len(ids), dtype=np.int64)
    for i in range(1, len(ids)):
        tie[i] = tie[i - 1] + 1 if ids[i] == ids[i - 1] else 0
    return t, tie, *joined(t.column("data"))


def marks(t: pa.Table, hot: int) -> pa.Table:
    """The hashes of one bucket that occur twice in the corpus, for each shard that has them, with marks."""
    buf, a, b = joined(t.column("hashes"))
    value = np.frombuffer(buf.tobytes(), dtype=np.uint64)
    more = joined(t.column("more"))[0]
    size = (b - a) // 8
    _, which, shards = np.unique(value, return_inverse=True, return_counts=True)
    places = shards + np.bincount(which, more, len(shards)).astype(np.int64)
    again = places[which] > 1
    # 1: twice in one shard only, 2: in several shards, 3: there at very many places
    mark = np.where(shards > 1, np.where(places > hot, 3, 2), 1).astype(np.uint8)[which]
    owner = np.repeat(np.arange(len(size)), size)[again]
    n = np.bincount(owner, minlength=len(size))
    off = np.append(0, np.cumsum(n))
    out = pa.table({"block": t.column("block"), "hashes": binary_array(value[again].view(np.uint8), off * 8),
                    "mark": binary_array(mark[again], off)})
    return out.filter(pa.array(n > 0))


def routed_runs(buf: np.ndarray, owner: np.ndarray, may: np.ndarray, low: np.ndarray, value: np.ndarray, mark: np.ndarray):
    """(starts, lengths, hash that routes each) of the runs of the candidates ``may``: neighbours of one document
    that share a smallest hash, or the smallest long one where the hash is marked as very common."""
    b, m = _runs(may, owner, low)
    route = low[b]
    heat = mark[np.searchsorted(value, route)] == 3 if len(b) else np.zeros(0, bool)
    if heat.any():
        # the stretches of neighbours, put together
        s, e = b[heat], (b + m)[heat]
        head = np.flatnonzero(np.append(True, (s[1:] != e[:-1]) | (owner[s[1:]] != owner[s[:-1]])))
        s, n = s[head], np.add.reduceat(m[heat], head)
        size = n + LENGTH - 1
        at = ragged(s, size)
        far = long_hashes(buf[at])
        common = np.zeros(len(at), dtype=bool)
        common[ragged(np.cumsum(size) - size, n)] = True
        c, k = _runs(common, far)
        b, m, route = np.concatenate((b[~heat], at[c])), np.concatenate((m[~heat], k)), np.concatenate((route[~heat], far[c]))
    return b, m, route


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(blocks of documents, runs of starts whose 100 bytes start earlier in the corpus)."""
    rows = docs.select("doc_id", text_bytes().alias("data"))
    n_blocks = count_of(rows.agg(F.sum(F.octet_length("data"))).first()[0], block_bytes)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def send(t: pa.Table) -> pa.Table:
        _, _, buf, starts, ends = _block(t)
        value, more = sent_hashes(buf, starts, ends)
        to = spread(value, n_blocks)
        order = np.lexsort((value, to))
        value, more, to = value[order], more[order], to[order]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        off = np.append(head, len(to))
        return pa.table({"bucket": pa.array(to[head], pa.int32()), "block": pa.array(np.full(len(head), t.column("block")[0].as_py()), pa.int32()),
                         "hashes": binary_array(value.view(np.uint8), off * 8), "more": binary_array(more, off)})

    def reply(t: pa.Table) -> pa.Table:
        return marks(t, hot)

    replies = (blocks.groupBy("block").applyInArrow(send, "bucket int, block int, hashes binary, more binary")
               .groupBy("bucket").applyInArrow(reply, "block int, hashes binary, mark binary"))

    run_schema = f"bucket int, block int, doc_id {kind}, tie int, at long, n long, size long, data binary"

    def local(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows or not r.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "doc_id": pa.array([], t.schema.field("doc_id").type),
                             "tie": pa.array([], pa.int32()), "at": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                             "size": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        block = t.column("block")[0].as_py()
        t, tie, buf, starts, ends = _block(t)
        value = np.frombuffer(joined(r.column("hashes"))[0].tobytes(), dtype=np.uint64)
        mark = joined(r.column("mark"))[0]
        order = np.argsort(value)
        value, mark = value[order], mark[order]
        gone, may, low = shard_repeats(buf, starts, ends, value, value[mark > 1])
        # repeats inside the shard: done, they only pass through (n = 0 marks them)
        owner_of = np.repeat(np.arange(len(starts)), ends - starts)
        a, n = _runs(gone, owner_of)
        b, m, route = routed_runs(buf, owner_of, may, low, value, mark)
        to = spread(route, n_blocks)
        owner, size = owner_of[np.concatenate((a, b))], np.concatenate((np.zeros(len(a), np.int64), m + LENGTH - 1))
        data = buf[ragged(np.concatenate((a, b)), size)]
        return pa.table({
            "bucket": pa.array(np.concatenate((np.full(len(a), block % n_blocks), to)), pa.int32()),
            "block": pa.array(np.full(len(a) + len(b), block), pa.int32()),
            "doc_id": one_array(t.column("doc_id")).take(pa.array(owner)), "tie": pa.array(tie[owner], pa.int32()),
            "at": pa.array(np.concatenate((a, b)) - starts[owner], pa.int64()),
            "n": pa.array(np.concatenate((np.zeros(len(a), np.int64), m)), pa.int64()),
            "size": pa.array(np.concatenate((n, m)), pa.int64()), "data": binary_array(data, np.append(0, np.cumsum(size)))})

    runs = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(local, run_schema)

    def across(t: pa.Table) -> pa.Table:
        own = t.filter(pa.array(t.column("n").to_numpy() == 0))
        found = merge_task(t)
        passed = _repeat_rows(own.column("block").to_numpy(), own.column("doc_id"), own.column("tie").to_numpy(),
                              own.column("at").to_numpy(), own.column("size").to_numpy())
        return pa.concat_tables([passed, found])

    found = runs.groupBy("bucket").applyInArrow(across, f"block int, doc_id {kind}, tie int, at long, n long")
    return blocks, found


def removed_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Maximal removed runs (start, length) in the buffer, given runs of repeated starts."""
    edge = np.zeros(len(buf) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + LENGTH, -1)
    cover = np.cumsum(edge[:-1]) > 0
    return _runs(cover, np.repeat(np.arange(len(starts)), ends - starts))


def remove(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes per row of ``docs``."""
    blocks, found = repeats(docs, block_bytes, hot)
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def cut(t: pa.Table, r: pa.Table) -> pa.Table:
        t, tie, buf, starts, ends = _block(t)
        ids = t.column("doc_id").to_pylist()
        index = {(d, k): i for i, (d, k) in enumerate(zip(ids, tie.tolist()))}
        owner = np.array([index[d, k] for d, k in zip(r.column("doc_id").to_pylist(), r.column("tie").to_pylist())], dtype=np.int64)
        begin = starts[owner] + r.column("at").to_numpy() if len(owner) else owner
        a, n = removed_spans(buf, starts, ends, begin, r.column("n").to_numpy())
        gone = np.zeros(len(buf), dtype=bool)
        gone[ragged(a, n)] = True
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        removed = np.bincount(doc[gone], minlength=len(starts))
        spans = np.bincount(doc[a], minlength=len(starts))
        kept = [buf[s:e][~gone[s:e]].tobytes() if k else buf[s:e].tobytes() for s, e, k in zip(starts.tolist(), ends.tolist(), removed.tolist())]
        return pa.table({"doc_id": one_array(t.column("doc_id")), "n_bytes": pa.array(ends - starts, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept": pa.array(kept, pa.binary())})

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove(docs).drop("kept")
