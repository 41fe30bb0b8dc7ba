"""Materialised (gold) tables in the shared checkpoint folder.

A gold table is written once per fingerprint of its inputs (path, size and
modification time of every input) plus a spec string (e.g. the rule set), and read
back by every consumer.  This is the store-once / query-many layout of the
pipeline: the per-meeting work runs once, reports scan parquet.  Writing it also
cuts the lineage, so a lost executor never recomputes the whole pipeline.

The folder is ``spark.checkpoint.dir`` of the session (shared storage on a
cluster).  A build writes into a unique temporary folder and renames it into
place, so concurrent builders never expose a half-written table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from colloquy.session import bounded_tasks, ensure_checkpoint_dir

GOLD_VERSION = "3"
#: Bytes of a file that one task of a bounded build reads: what it sorts before the first shuffle.
SPLIT_BYTES = 16 << 20
_PKG = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
# Source files whose logic shapes gold tables: a change to any of them yields a new fingerprint.
CODE_FILES = ["rules.py", "sources/meetings.py", "sources/tables.py", "operators/gold.py", "operators/records.py", "operators/search.py", "operators/redaction.py",
              "functions/__init__.py",
              "functions/classify.py", "functions/sentiment.py", "functions/issues.py", "functions/routing.py",
              "functions/accounts.py", "functions/flags.py", "functions/redact.py"]


def code_fingerprint() -> str:
    import os
    h = hashlib.sha256()
    for f in CODE_FILES:
        with open(os.path.join(_PKG, f), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_bytes(spark: SparkSession, inputs: list) -> int:
    """Bytes of the input files."""
    return sum(fs.getContentSummary(p).getLength() for p, fs in (_fs(spark, path) for path in inputs))


def fingerprint(spark: SparkSession, inputs: list, spec: str) -> str:
    h = hashlib.sha256((GOLD_VERSION + code_fingerprint() + spec).encode())
    for path in inputs:
        p, fs = _fs(spark, path)
        st = fs.getFileStatus(p)
        size = fs.getContentSummary(p).getLength() if st.isDirectory() else st.getLen()
        h.update(f"{path}|{size}|{st.getModificationTime()}".encode())
    return h.hexdigest()[:24]


def gold_table(spark: SparkSession, name: str, inputs: list, spec: str, build: Callable[[], DataFrame],
               sort_by: list | None = None, bloom: list | None = None, tasks: Callable[[], int] | None = None) -> DataFrame:
    """``sort_by`` clusters rows inside files; ``bloom`` columns get a Parquet Bloom filter per row
    group, so a point lookup on them skips the row groups that lack the value.  ``tasks``: partitions
    that every shuffle of the build has at least, for builds whose tasks must not grow with the input; their
    scans read ``SPLIT_BYTES`` a task at most."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    final = f"{root}/gold/{name}-{fingerprint(spark, inputs, spec)}"
    p, fs = _fs(spark, final)
    if not fs.exists(_fs(spark, final + "/_SUCCESS")[0]):
        tmp = f"{root}/gold/_tmp-{name}-{uuid.uuid4().hex}"
        with bounded_tasks(spark, tasks(), SPLIT_BYTES) if tasks else nullcontext():
            df = build()
            if sort_by:
                # Cluster rows inside each file so min/max statistics let filters on these
                # columns skip row groups (no directory partitioning: no skew, no tiny files).
                df = df.sortWithinPartitions(*sort_by)
            writer = df.write.mode("overwrite")
            for c in bloom or []:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            writer.parquet(tmp)
        tp, _ = _fs(spark, tmp)
        if not fs.exists(_fs(spark, final + "/_SUCCESS")[0]):
            fs.mkdirs(p.getParent())
            if not fs.rename(tp, p) and not fs.exists(_fs(spark, final + "/_SUCCESS")[0]):
                raise RuntimeError(f"could not publish gold table {final}")
    return spark.read.parquet(final)


def prune_gold(spark: SparkSession, name: str, keep: str | None = None, dry_run: bool = True) -> list:
    """List (and with ``dry_run=False`` delete) gold folders of table ``name`` other than the
    fingerprint ``keep``.  Opt-in and scoped to one table name: folders in a shared checkpoint
    location may still be read by jobs running older code, so nothing is removed implicitly."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    p, fs = _fs(spark, f"{root}/gold")
    if not fs.exists(p):
        return []
    victims = []
    for st in fs.listStatus(p):
        base = st.getPath().getName()
        if st.isDirectory() and base.startswith(f"{name}-") and base != f"{name}-{keep}":
            victims.append(st.getPath().toString())
            if not dry_run:
                fs.delete(st.getPath(), True)
    return victims
