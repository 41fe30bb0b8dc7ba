"""Byte-level BPE by forced-boundary splitting, and its decoding.

The pre-tokeniser's pieces are found for a whole buffer of texts by class transitions.  Byte pairs
that occur inside no vocabulary token mark certain cuts: no merge can span them, so the fragments
between cuts are encoded independently.  Equal fragments of a slice are encoded once, all
fragments together: in each round every unfinished fragment merges its lowest-ranked pair.  The
ids are then concatenated and decoded by a table of token bytes.  Fragments are told apart by a
64-bit hash; the decoded bytes are compared with the text, and a text that differs is encoded
again without hashes.

Null texts are empty and have no ids; rows are independent, so repeated ids give a row each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import joined, prefix_hash, ragged, range_hash, schema_with, shards, text_bytes

SLICE_BYTES = 4 << 20
#: Longer fragments are encoded one by one with a heap.
LONG = 256
LETTER, NUMBER, OTHER, SPACE, GAP = range(5)
#: The pre-tokeniser's contractions (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Code points of the White_Space property (fixed values).
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable ones for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in ids.items():
            self.token[i] = bytes(chars[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pair = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in chars.items():
            self.byte_id[b] = ids[c]
        keys = np.array([a << 32 | b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.arange(len(keys))[order], len(keys))
        self.merged = np.append(np.array([m for _, m in self.pair.values()], dtype=np.int64)[order], 0)
        self.no_rank = len(keys)
        self.cut = np.ones((256, 256), dtype=bool)
        for i in ids.values():
            t = np.frombuffer(self.token[i], dtype=np.uint8)
            self.cut[t[:-1], t[1:]] = False
        self.flat = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def piece_starts(cps: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Whether a pre-tokeniser piece starts at each code point; ``gaps`` are parting positions."""
    n = len(cps)
    cls = char_classes()[cps]
    cls[gaps] = GAP
    prev, prev_cp = np.empty(n, np.uint8), np.empty(n, cps.dtype)
    prev[0], prev_cp[0] = GAP, 0
    prev[1:], prev_cp[1:] = cls[:-1], cps[:-1]
    after = np.append(cls[1:], GAP)
    space = cls == SPACE
    blank = (prev == SPACE) & (prev_cp == 0x20)
    start = np.where(space, (prev != SPACE) | ((after != SPACE) & (after != GAP)), (prev != cls) & ~blank)
    quote = np.flatnonzero((cps == 0x27) & (cls == OTHER) & (prev != OTHER) & ~blank & (after == LETTER))
    if len(quote):
        wide = np.append(cps, [0, 0, 0])
        for c in CONTRACTIONS:
            at = quote
            for j, ch in enumerate(c[1:], 1):
                at = at[wide[at + j] == ord(ch)]
            start[at + 1] = False
            end = at + len(c)
            start[end[end < n]] = True
    start[gaps] = True
    return start


def _heap_encode(vocab: Vocabulary, data: bytes) -> list[int]:
    """Ids of one long fragment: merges by rank, then place."""
    ids = [int(i) for i in vocab.byte_id[np.frombuffer(data, dtype=np.uint8)]]
    left, right, alive = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1)), [True] * len(ids)
    heap = []

    def push(i):
        j = right[i]
        if j < len(ids) and (got := vocab.pair.get((ids[i], ids[j]))):
            heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

    for i in range(len(ids) - 1):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i] if alive[i] else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], right[i] = new, False, right[j]
        if right[j] < len(ids):
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [x for x, ok in zip(ids, alive) if ok]


def encode_fragments(vocab: Vocabulary, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Ids of the fragments buf[start:start + length]: flat ids, and how many each has."""
    n = len(starts)
    count = np.zeros(n, dtype=np.int64)
    done_frag, done_seq, done_tok = [], [], []
    long = np.flatnonzero(lengths > LONG)
    for f in long.tolist():
        got = _heap_encode(vocab, buf[starts[f]:starts[f] + lengths[f]].tobytes())
        done_frag.append(np.full(len(got), f)), done_seq.append(np.arange(len(got))), done_tok.append(np.array(got, dtype=np.int64))
    short = np.flatnonzero(lengths <= LONG)
    tok = vocab.byte_id[buf[ragged(starts[short], lengths[short])]]
    frag = np.repeat(short, lengths[short])
    while len(tok):
        same = np.append(frag[1:] == frag[:-1], False)
        key = (tok << 32) | np.append(tok[1:], 0)
        at = np.searchsorted(vocab.keys, key)
        rank = np.where(same & (vocab.keys[at] == key), vocab.rank[at], vocab.no_rank)
        head = np.flatnonzero(np.append(True, frag[1:] != frag[:-1]))
        size = np.diff(np.append(head, len(tok)))
        low = np.minimum.reduceat(rank, head)
        over = np.repeat(low == vocab.no_rank, size)
        if over.any():
            f = frag[over]
            h = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            done_frag.append(f), done_tok.append(tok[over])
            done_seq.append(np.arange(len(f)) - np.repeat(h, np.diff(np.append(h, len(f)))))
        pick = (rank == np.repeat(low, size)) & ~over
        # of overlapping equal pairs (a run of one token) every second is taken, from the left
        i = np.flatnonzero(pick)
        fresh = np.append(True, (np.diff(i) > 1) | (frag[i[1:]] != frag[i[:-1]])) if len(i) else np.zeros(0, bool)
        run_at = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0)) if len(i) else i
        i = i[(np.arange(len(i)) - run_at) % 2 == 0]
        tok[i] = vocab.merged[at[i]]
        keep = ~over
        keep[i + 1] = False
        tok, frag = tok[keep], frag[keep]
    frag = np.concatenate(done_frag) if done_frag else np.zeros(0, np.int64)
    seq = np.concatenate(done_seq) if done_seq else np.zeros(0, np.int64)
    tok = np.concatenate(done_tok) if done_tok else np.zeros(0, np.int64)
    count = np.bincount(frag, minlength=n)
    out = np.empty(len(tok), dtype=np.int64)
    out[(np.cumsum(count) - count)[frag] + seq] = tok
    return out, count


def _segments(vocab: Vocabulary, text: str):
    """Ordinary text and special tokens of a text, in order."""
    at = 0
    while True:
        found = min(((i, -len(s), s) for s in vocab.special if (i := text.find(s, at)) >= 0), default=None)
        if found is None:
            yield text[at:], None
            return
        yield text[at:found[0]], vocab.special[found[2]]
        at = found[0] + len(found[2])


def encode_buffer(vocab: Vocabulary, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False):
    """Ids of the texts buf[start:end] (one zero byte after each): flat ids, and how many each has."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    width = np.ones(len(cps), dtype=np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += cps >= limit
    byte_at = np.cumsum(width) - width
    char_of = np.searchsorted(byte_at, ends)
    begin = np.zeros(len(buf) + 1, dtype=bool)
    begin[byte_at[piece_starts(cps, char_of)]] = True
    begin[1:-1] |= vocab.cut[buf[:-1], buf[1:]]
    begin[starts] = True
    begin[ends] = True
    begin[-1] = True
    cuts = np.flatnonzero(begin)
    a, size = cuts[:-1], np.diff(cuts)
    gap = np.zeros(len(buf) + 1, dtype=bool)
    gap[ends] = True
    keep = ~gap[a]
    a, size = a[keep], size[keep]
    if exact:
        first, which = np.arange(len(a)), np.arange(len(a))
    else:
        h = range_hash(prefix_hash(buf), a, a + size) ^ (size.astype(np.uint64) << np.uint64(56))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
    ids, count = encode_fragments(vocab, buf, a[first], size[first])
    at = np.cumsum(count) - count
    many = count[which]
    flat = ids[ragged(at[which], many)]
    text_of = np.searchsorted(starts, a, side="right") - 1
    return flat, np.bincount(text_of, weights=many, minlength=len(starts)).astype(np.int64)


def encode_texts(vocab: Vocabulary, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text."""
    plan, parts = [], []
    marks = [s.encode() for s in vocab.special]
    for t in texts:
        if any(m in t for m in marks):
            own = []
            for seg, special in _segments(vocab, t.decode("utf-8")):
                own.append((len(parts), special))
                parts.append(seg.encode())
            plan.append(own)
        else:
            plan.append([(len(parts), None)])
            parts.append(t)
    buf, starts, ends = joined(pa.array(parts, pa.large_binary()), gap=1)
    flat, count = encode_buffer(vocab, buf, starts, ends) if len(parts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.append(0, np.cumsum(count))
    out = []
    for text, own in zip(texts, plan):
        ids = flat[at[own[0][0]]:at[own[0][0] + 1]] if len(own) == 1 else np.concatenate(
            [x for p, special in own for x in (flat[at[p]:at[p + 1]], np.array([] if special is None else [special], dtype=np.int64))])
        if decode_ids(vocab, ids) != text:  # two fragments shared a hash
            ids = np.concatenate([np.array([special]) if special is not None and not seg else _exact(vocab, seg.encode())
                                  if special is None else np.append(_exact(vocab, seg.encode()), special)
                                  for seg, special in _segments(vocab, text.decode("utf-8"))]).astype(np.int64)
        out.append(ids)
    return out


def _exact(vocab: Vocabulary, data: bytes) -> np.ndarray:
    buf, starts, ends = joined(pa.array([data], pa.large_binary()), gap=1)
    return encode_buffer(vocab, buf, starts, ends, exact=True)[0]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of the tokens; invalid UTF-8 is left as it is."""
    return vocab.flat[ragged(vocab.start[ids], vocab.length[ids])].tobytes()


def decode_text(vocab: Vocabulary, ids: np.ndarray) -> str:
    return decode_ids(vocab, ids).decode("utf-8", errors="replace")


def _valid(data: bytes) -> bytes:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("utf-8", errors="replace").encode()
    return data


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The ``keep`` columns with n_tokens, the ids (array<int>, if asked for) and both digests."""
    src = docs.select(*keep, text_bytes().alias("_data"))

    def run(batches):
        vocab = vocabulary(path)
        for part in shards(batches, "_data", SLICE_BYTES):
            got = encode_texts(vocab, [_valid(x) for x in part.column("_data").to_pylist()])
            out = part.drop_columns(["_data"])
            cols = [*out.columns, pa.array([len(x) for x in got], pa.int64())]
            names = [*out.column_names, "n_tokens"]
            if ids:
                off = np.append(0, np.cumsum([len(x) for x in got])).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(got).astype(np.int32))))
                names.append("ids")
            cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got]))
            cols.append(pa.array([hashlib.sha256(decode_text(vocab, x).encode()).hexdigest() for x in got]))
            yield from pa.Table.from_arrays(cols, names=[*names, "ids_sha256", "decoded_sha256"]).to_batches()

    more = "ids array<int>, " if ids else ""
    return src.mapInArrow(run, schema_with(src, "_data", f"n_tokens long, {more}ids_sha256 string, decoded_sha256 string"))
