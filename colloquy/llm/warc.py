"""WARC archives of captured pages, and an external merge of their capture index.

Writing: every task packs its pages in archives of about ``ARCHIVE_BYTES`` (one gzip member per
record) and sorts the archive's captures by (url key, timestamp, page id): one run per archive.
Archives and runs are rows of a table in the shared folder, so they survive lost executors.
Merging: range borders are taken from a bounded sample of the runs' keys; each run is cut at the
borders by binary search, and the pieces of a range are merged by a loser tree.  The ranges in
order are the global capture history.  Reading: the records are parsed back from the archives.

Equal payloads (SHA-256 over the bytes) of at least ``min_revisit_bytes``: the smallest page_id is
the response, others are revisits that refer to it; rows that repeat that page_id are responses
too.  Null html is the empty payload, a null url the empty one; a null page_id is never the
smallest unless the group has no other; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import shards, stage

ARCHIVE_BYTES = 8 << 20
#: Keys that are read to choose range borders, and captures per range.
BORDER_SAMPLE, RANGE_ROWS = 10_000, 20_000
#: First capture time; a page's time is this plus page_id seconds unless a column is named.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)

_ENTRY = "struct<key:string,ts:string,page_id:long,offset:long,length:long>"
_ENTRY_PA = pa.struct([("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()),
                       ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, no scheme, 'www.', port or fragment; lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^#]*)", (url or "").strip().lower(), re.S)
    host = m[1].rpartition("@")[2].partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/") if host or m[2] else ""


def _header_value(s: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, ts: str) -> bytes:
    """One WARC record as a gzip member."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {ts}", f"WARC-Target-URI: {_header_value(url or '')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(archive: bytes):
    """(offset, headers, http headers, payload) of every record of an archive."""
    at = 0
    while at < len(archive):
        z = zlib.decompressobj(31)
        raw = z.decompress(archive[at:] if at else archive) + z.flush()
        size = len(archive) - at - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[:int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, headers, http.decode(), payload
        at += size


def _members(archive: bytes, run: list[dict]):
    """Records of an archive at the offsets of its index."""
    for e in sorted(run, key=lambda e: e["offset"]):
        yield from ((e["offset"], h, t, p) for _, h, t, p in parse(archive[e["offset"]:e["offset"] + e["length"]]))


def _timestamp(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Table (archive, data, run): one row per archive with its locally sorted captures."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_sha", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("_sha")
             .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_sha", "_first"))
    other = ~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()
    rows = rows.join(first, "_sha", "left").select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))

    def pack(batches):
        from pyspark import TaskContext
        task, no = TaskContext.get().partitionId(), 0
        for part in shards(batches, "payload", archive_bytes):
            out, run, at = [], [], 0
            for page, url, payload, ref in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                ts = _timestamp(page)
                out.append(record(page, url, payload, ref, ts))
                run.append({"key": url_key(url), "ts": ts, "page_id": page, "offset": at, "length": len(out[-1])})
                at += len(out[-1])
            run.sort(key=_order)
            name = f"pages-{task:06d}-{no:04d}.warc.gz"
            no += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()),
                                              pa.array([run], pa.list_(_ENTRY_PA))], names=["archive", "data", "run"])

    return stage(rows.mapInArrow(pack, f"archive string, data binary, run array<{_ENTRY}>"), "warc")


def _order(e: dict) -> tuple:
    """Capture order: key, time, page id (null first), place in the archive."""
    return e["key"], e["ts"], -1 if e["page_id"] is None else e["page_id"], e["offset"]


def loser_tree(runs: list[list], key):
    """K-way merge of sorted runs: inner nodes hold the losers, so each step replays one path."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    keys = [key(r[0]) if r else None for r in runs]
    beats = lambda a, b: keys[a] is not None and (keys[b] is None or (keys[a], a) < (keys[b], b))
    tree, winners = [0] * k, list(range(k))
    nodes = {k + i: i for i in range(k)}  # leaves k..2k-1 of an implicit tree, inner nodes 1..k-1
    for n in range(k - 1, 0, -1):
        a, b = nodes[2 * n], nodes[2 * n + 1]
        nodes[n], tree[n] = (a, b) if beats(a, b) else (b, a)
    best = nodes[1] if k > 1 else winners[0]
    while keys[best] is not None:
        run = runs[best]
        yield run[at[best]]
        at[best] += 1
        keys[best] = key(run[at[best]]) if at[best] < len(run) else None
        n = (best + k) // 2
        while n:
            if beats(tree[n], best):
                best, tree[n] = tree[n], best
            n //= 2


def merge_index(archives: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Global capture history: position, url_key, captured_at, page_id, archive, offset, length."""
    n = archives.agg(F.sum(F.size("run"))).first()[0] or 0
    ranges = max(1, -(-n // range_rows))
    borders: list[tuple] = []
    if ranges > 1:
        entries = archives.select("archive", F.explode("run").alias("e"))
        # about BORDER_SAMPLE entries, whatever their number
        draw = F.pmod(F.xxhash64("archive", "e.offset"), F.lit(1 << 40))
        picked = entries.where(draw < min(1 << 40, (BORDER_SAMPLE << 40) // n)).select("e").collect()
        sample = sorted(_order(r.e.asDict()) for r in picked)
        borders = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})

    def cut(batches):
        for b in batches:
            for name, run in zip(b.column("archive").to_pylist(), b.column("run").to_pylist()):
                keys = [_order(e) for e in run]
                at = [0, *(bisect.bisect_left(keys, x) for x in borders), len(run)]
                got = [(i, run[x:y]) for i, (x, y) in enumerate(zip(at, at[1:])) if y > x]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in got], pa.int32()), pa.array([name] * len(got)),
                         pa.array([p for _, p in got], pa.list_(_ENTRY_PA))], names=["part", "archive", "piece"])

    def merge(t: pa.Table) -> pa.Table:
        runs = [[(*_order(e), name, e) for e in piece] for name, piece in
                sorted(zip(t.column("archive").to_pylist(), t.column("piece").to_pylist()), key=lambda x: x[0])]
        out = list(loser_tree(runs, key=lambda x: x[:5]))
        part = t.column("part")[0].as_py() if t.num_rows else 0
        return pa.table({"part": pa.array([part] * len(out), pa.int32()), "seq": pa.array(range(len(out)), pa.int64()),
                         "url_key": pa.array([x[0] for x in out], pa.string()), "captured_at": pa.array([x[1] for x in out], pa.string()),
                         "page_id": pa.array([x[5]["page_id"] for x in out], pa.int64()),
                         "archive": pa.array([x[4] for x in out], pa.string()), "offset": pa.array([x[3] for x in out], pa.int64()),
                         "length": pa.array([x[5]["length"] for x in out], pa.int64())})

    pieces = archives.select("archive", "run").mapInArrow(cut, f"part int, archive string, piece array<{_ENTRY}>")
    merged = pieces.groupBy("part").applyInArrow(
        merge, "part int, seq long, url_key string, captured_at string, page_id long, archive string, offset long, length long")
    merged = stage(merged, "captures")
    sizes = merged.groupBy("part").agg(F.count("*").alias("_n"))
    base = sizes.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_base"))
    return merged.join(base, "part").select((F.col("_base") + F.col("seq")).alias("position"), "url_key", "captured_at",
                                            "page_id", "archive", "offset", "length")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records read back: archive, offset, page_id, url, payload bytes and digest, type, refers_to, payload."""
    def unpack(batches):
        for b in batches:
            for name, data, run in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), b.column("run").to_pylist()):
                rows = []
                for at, h, http, payload in _members(data, run):
                    kind = h["WARC-Type"]
                    n = int(re.search(r"Content-Length: (\d+)", http)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (n != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{name}: damaged record at {at}")
                    ids = [re.fullmatch(r"<urn:page:(.*)>", h[x])[1] if x in h else "" for x in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((name, at, *(int(x) if x else None for x in ids), h["WARC-Target-URI"], n, digest, kind,
                                 payload if kind == "response" else None))
                names = ["archive", "offset", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", "record_type", "payload"]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.mapInArrow(unpack, "archive string, offset long, page_id long, refers_to long, url string, "
                                       "payload_bytes long, payload_digest string, record_type string, payload binary")


def capture_history(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, merge the index, read back: the records with their place in the global history."""
    archives = write_archives(pages, min_revisit_bytes)
    history = merge_index(archives).drop("page_id")
    return read_archives(archives).drop("payload").join(history, ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", "url_key", "captured_at",
        "archive", "offset", "length")
