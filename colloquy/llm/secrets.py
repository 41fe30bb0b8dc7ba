"""Secret scans: base rules, and probabilistic automata learnt from labelled credentials.

The base rules' matches are the labelled credentials.  A bounded sample of their values
(``MAX_LABELLED`` distinct values with the smallest hashes) is written in character classes and
put in a prefix tree; states whose outgoing frequencies agree (Hoeffding bound) are merged, which
gives a probabilistic automaton of the formats.  Every run of ``MIN_CHARS`` or more credential
characters in all texts that is not inside a base span is scored: log-likelihood under the
automaton against a first-order model of ordinary runs (words and numbers alike).  It adds a span
if it wins by ``EVIDENCE`` in all and by ``MARGIN`` per character: a short run must look the more
like a credential, and the ordinary model, not a rule, keeps words and plain numbers out.  A run
that reaches beyond a base span is scored, and then added, whole.

Null and empty texts have no spans; with no labelled credential the automaton accepts nothing and
no span is added; rows are independent, so repeated ids give a row each.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import as_rows, from_rows, joined, schema_with, shards, text_bytes

SLICE_BYTES = 4 << 20
#: Bounded sample of labelled rows: credentials, and ordinary words for the opposing model.
MAX_LABELLED, MAX_ORDINARY = 4000, 4000
MIN_CHARS = 8
#: Confidence of the merging test; nats per character, and in all, by which the automaton must win.
ALPHA, MARGIN, EVIDENCE = 0.05, 0.5, 12.0

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYS = (b"passw", b"secret", b"token", b"key")

_HEX = np.zeros(256, dtype=bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True
_CRED = np.zeros(256, dtype=bool)
_CRED[0x30:0x3A] = _CRED[0x41:0x5B] = _CRED[0x61:0x7B] = True
_CRED[list(b"+/_=-")] = True

#: Classes of characters: digit, hex letter, other lower, upper, and each of the signs.
_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[0x30:0x3A] = 0
_CLASS[0x61:0x67] = 1
_CLASS[0x67:0x7B] = 2
_CLASS[0x41:0x5B] = 3
for _i, _c in enumerate(b"+/_=-", 4):
    _CLASS[_c] = _i
SIGMA = 10


def classes(value: bytes) -> list[int]:
    return _CLASS[np.frombuffer(value, dtype=np.uint8)].tolist()


class Automaton:
    """States with end counts and, per symbol, a count and a next state."""

    def __init__(self, samples: list[bytes], alpha: float = ALPHA):
        self.end, self.next, self.count = [0], [{}], [{}]
        for value in samples:
            s = 0
            for c in classes(value):
                self.count[s][c] = self.count[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.end)
                    self.end.append(0), self.next.append({}), self.count.append({})
                s = self.next[s][c]
            self.end[s] += 1
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def total(self, s: int) -> int:
        return self.end[s] + sum(self.count[s].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            if self._differ(self.end[a], na, self.end[b], nb):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        """Red states are final; the children of red states are tried against every red state."""
        red = [0]
        while True:
            blue = sorted({(q, r, c) for r in red for c, q in self.next[r].items() if q not in red})
            if not blue:
                self.states = red
                return
            q, r, c = max(blue, key=lambda x: (self.total(x[0]), -x[0]))
            for other in red:
                if self._compatible(other, q):
                    self.next[r][c] = other
                    self._fold(other, q)
                    break
            else:
                red.append(q)

    def score(self, value: bytes) -> float:
        """Mean log-probability per symbol, end included; -inf where the automaton has no path."""
        s, out, symbols = 0, 0.0, classes(value)
        for c in symbols:
            if c not in self.next[s]:
                return -math.inf
            out += math.log(self.count[s][c] / self.total(s))
            s = self.next[s][c]
        return (out + math.log((self.end[s] + 0.5) / (self.total(s) + 1))) / (len(symbols) + 1)


class Ordinary:
    """First-order model of character classes in ordinary words."""

    def __init__(self, samples: list[bytes]):
        n = np.ones((SIGMA + 1, SIGMA + 1))
        for value in samples:
            x = [SIGMA, *classes(value), SIGMA]
            np.add.at(n, (x[:-1], x[1:]), 1)
        self.log = np.log(n / n.sum(axis=1, keepdims=True))

    def score(self, value: bytes) -> float:
        x = [SIGMA, *classes(value), SIGMA]
        return float(self.log[x[:-1], x[1:]].mean())


def _runs(flag: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return a[long].tolist(), b[long].tolist()


def base_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[list], list[list]]:
    """Per text of a buffer: base matches (start, kind, end, value start) and other credential-like
    runs (start, end), in buffer bytes."""
    found, others = [[] for _ in starts], [[] for _ in starts]
    for a, b in zip(*_runs(_HEX[buf], 32)):
        found[int(np.searchsorted(starts, a, side="right")) - 1].append((a, 2, b, a))
    for d, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        data = buf[s:e].tobytes()
        low = data.lower()
        if any(k in low for k in _KEYS):
            found[d] += [(s + m.start(), 0, s + m.end(), s + m.start(2)) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
        if b"AKIA" in data:
            found[d] += [(s + m.start(), 1, s + m.end(), s + m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
        found[d].sort()
    at, to = _runs(_CRED[buf], MIN_CHARS)
    owner = (np.searchsorted(starts, at, side="right") - 1).tolist() if at else []
    for a, b, d in zip(at, to, owner):
        if not any(x <= a and b <= y for x, _, y, _ in found[d]):
            others[d].append((a, b))
    return found, others


def labelled(docs: DataFrame) -> list[tuple[int, bytes]]:
    """Bounded sample: credentials (1) of the base rules, and ordinary long words (0)."""
    def pick(batches):
        for part in shards(batches, "_data", SLICE_BYTES):
            buf, starts, ends = joined(part.column("_data"), gap=1)
            found, _ = base_spans(buf, starts, ends)
            rows = {(1, buf[v:b].tobytes()) for spans in found for a, _, b, v in spans}
            # ordinary runs: those without a change between letters and digits
            kinds = _CRED[buf].astype(np.int8) + (_CRED[buf] & (buf >= 0x30) & (buf <= 0x39))
            plain = {buf[a:b].tobytes() for k in (1, 2) for a, b in zip(*_runs(kinds == k, MIN_CHARS))}
            rows |= {(0, x) for x in sorted(plain, key=lambda x: hashlib.md5(x).digest())[:MAX_ORDINARY]}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())],
                                             names=["label", "value"])

    rows = docs.select(text_bytes().alias("_data")).mapInArrow(pick, "label int, value binary").distinct()
    out = []
    for label, most in ((1, MAX_LABELLED), (0, MAX_ORDINARY)):
        got = rows.where(F.col("label") == label).orderBy(F.md5("value")).limit(most).collect()
        out += [(label, bytes(r.value)) for r in got]
    return out


def learn(sample: list[tuple[int, bytes]]) -> tuple[Automaton, Ordinary]:
    return Automaton([v for k, v in sample if k]), Ordinary([v for k, v in sample if not k])


def likely(automaton: Automaton, ordinary: Ordinary, value: bytes, cache: dict[bytes, bool]) -> bool:
    """Whether the automaton wins by enough; equal class strings are scored once per slice."""
    key = _CLASS[np.frombuffer(value, dtype=np.uint8)].astype(np.uint8).tobytes()
    if key not in cache:
        gain = automaton.score(value) - ordinary.score(value)
        cache[key] = gain > MARGIN and gain * (len(value) + 1) > EVIDENCE
    return cache[key]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the spans of each text (code points, end exclusive), base ones first
    found by rule, those of kind 'format' by the automaton; ordered by start, then kind."""
    src = docs.select(*keep, text_bytes().alias("_data"))
    models = docs.sparkSession.sparkContext.broadcast(learn(labelled(docs)))

    def run(batches):
        automaton, ordinary = models.value
        for part in shards(batches, "_data", SLICE_BYTES):
            buf, starts, ends = joined(part.column("_data"), gap=1)
            found, others = base_spans(buf, starts, ends)
            points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
            rows, cache = [], {}
            for d, (spans, more) in enumerate(zip(found, others)):
                spans = [x[:3] for x in spans]
                for a, b in more:
                    value = buf[a:b].tobytes()
                    if likely(automaton, ordinary, value, cache):
                        spans.append((a, 3, b))
                zero = points[starts[d]]
                rows.append([{"kind": KINDS[k], "start": int(points[a] - zero), "end": int(points[b] - zero)} for a, k, b in sorted(spans)])
            out = part.drop_columns(["_data"])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield from pa.Table.from_arrays([*out.columns, pa.array(rows, kind)], names=[*out.column_names, "spans"]).to_batches()

    return src.mapInArrow(run, schema_with(src, "_data", f"spans {SPANS}"))


def _joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    n = {k: of(k) for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", *(n[k].alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined_spans(base), 256).alias("base_sha256"),
                        _joined_spans(F.col("spans")).alias("spans"), n["format"].alias("n_format"))


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark`` (overlapping spans by one); columns as given."""
    found = scan(as_rows(docs), ("row",))
    # merge overlapping spans, then keep what lies between them
    spans = F.aggregate("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                 F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    out = found.withColumn("_cut", F.when(F.size("spans") > 0, spans))
    begin = F.concat(F.array(F.lit(0)), F.col("_cut")["end"])
    end = F.concat(F.col("_cut")["start"], F.array(F.char_length("row.text")))
    text = F.array_join(F.zip_with(begin, end, lambda a, b: F.substring(F.col("row.text"), a + 1, b - a)), mark)
    return from_rows(out, F.when(F.col("_cut").isNotNull(), text).otherwise(F.col("row.text")))
