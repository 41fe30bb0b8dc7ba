"""Plain-Python versions of the operators, straight from their contracts."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash
from tokenizers import Tokenizer

SPACE = r"[^\x20\x09-\x0D]+"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(s: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def op2(rows):
    """rows: (doc_id, text) -> list of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    docs = sorted(((d is not None, d or 0, (t or "").encode()) for d, t in rows))
    seen, out = set(), []
    for known, d, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            x = data[i:i + 100]
            if x in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(x)
        out.append((d if known else None, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))),
                    sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def op3(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = word.findall(lower(t or ""))
        hit, got = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    got |= windows[x]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return out


def op4(rows):
    first = {}
    for p, _, h in rows:
        k = h or ""
        if p is not None:
            first[k] = min(first.get(k, p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and p != f
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return out


def held(d) -> bool:
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def op5(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    toks = [(d, [*re.findall(SPACE, lower(t or "")), None]) for d, t in rows]
    c = Counter(x for d, ws in toks if not held(d) for x in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[x] > 0 for x in ws), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws)) for d, ws in toks]


def op6(rows, path):
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    out = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def op7(rows, max_docs=6):
    """rows: (doc_id, text, source) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    line = lambda x: " ".join(re.findall(SPACE, x)).lower()
    docs = defaultdict(set)
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            if line(x):
                docs[s, line(x)].add(t)
    out = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(SPACE, x):
                dup += x in seen
                seen.add(x)
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        left = sum(len(re.findall(SPACE, x)) for x in t.split("\n") if line(x) and len(docs[s, line(x)]) <= max_docs)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed,
                    not failed and left >= 10 and left >= 0.5 * len(w)))
    return out


def op8(rows):
    """(doc_id, n_assign, n_access, n_hex, base_sha256, base spans)"""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = []
    for d, t in rows:
        t = t or ""
        got = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        got += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        got += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        got.sort()
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in got)
        out.append((d, *(sum(x[1] == k for x in got) for k in range(3)), sha(text), text))
    return out


def _place(key, node):
    """Descend by weighted draws: -ln(u) / weight, u from a chained 64-bit hash of key and child name."""
    while node.children:
        if len(node.children) == 1:
            node = node.children[0]
            continue
        draws = []
        for c in node.children:
            h = xxhash.xxh64(c.name.encode(), xxhash.xxh64(key.encode(), 42).intdigest()).intdigest()
            draws.append(-math.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight)
        node = node.children[draws.index(min(draws))]
    return node.shard


def op9(rows, tree, grown):
    """(doc_id, size, text_crc32, law, shard, grown_shard)"""
    out = []
    for d, t in rows:
        data, key = (t or "").encode(), "null" if d is None else str(d)
        out.append((d, len(data) + 1, zlib.crc32(data), "key", _place(key, tree), _place(key, grown)))
    return out


def op10(rows):
    """(doc_id, class_id, n_links)"""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x00\x20\x09-\x0D]+", lower(t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w and d is not None else frozenset())
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    common = Counter((i, j) for own in at.values() if len(own) < 400 for i in own for j in own if i < j)
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in common.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return [(d, low.get(find(i)) if d is not None else None, links[i]) for i, (d, _) in enumerate(rows)]


def runs(w):
    """(start, length, period) of the runs of a list of words: every period by comparison."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and w[e] == w[e + p]:
                e += 1
            if e - s + p >= max(12, 2 * p):
                out.append((s, e - s + p, p))
            s = e + 1 if e == s else e
    least = [r for r in out if not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in out)]
    return sorted(least, key=lambda r: (r[0], r[2]))


def op11(rows):
    out = []
    for d, t in rows:
        w = re.findall(SPACE, t or "")
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        # texts without a repeated stretch of six words have no run
        found = runs(w) if len(w) < 3000 else []
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out.append((d, len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
                    sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


def op12(rows, k=8, rounds=10):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'null' if r[0] is None else r[0]}"), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = [nearest(v) for _, v in kept]
    own = Counter()
    for d, j in near:
        own[j] += d
    return [(i, j, d, own[j], sum(own.values()), sha(",".join(map(str, cents[j])))) for (i, _), (d, j) in zip(kept, near)]
