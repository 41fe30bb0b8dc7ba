"""Keyed tables on shared storage: pruned existence checks, stored upserts, compaction.

A write is a run: one row per key (the last by a narrow order), sorted by a 64-bit hash of the key
and cut in files by ranges of it.  The run's manifest (file, lowest and highest hash, rows) is
written after its files, and a run counts from then on, so a write that dies half way is invisible.
Rows carry the sequence number of their write; the greatest one of a key is its value, a tombstone
ends it.

A lookup compares the batch's hashes with the manifests and reads only files whose range holds one,
so the files read depend on the batch and the number of runs, not on the size of the table.
``compact`` merges runs of like size (the number of runs grows with the logarithm of the table);
the merged run names those it replaces and takes their place when its manifest is complete.

A write with the sequence number of an earlier one takes its place (a replayed batch writes the
same rows again); if that one was compacted meanwhile, its rows are in the merged run already.
Rows whose key is null are never stored.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash ranges that files are put in to be met by keys: their number bounds the rows per run that
#: the manifest is spread to.
SLOTS = 4096
HASH, SEQ, GONE = "_hash", "_seq", "_gone"
_MANIFEST = "run string, seq long, file string, low long, high long, n long, replaces array<string>"


class KeyedTable:
    """Rows of ``schema`` by the columns ``key`` under ``path``; ``rows_per_file`` bounds a file."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: T.StructType, rows_per_file: int = 1_000_000):
        self.spark, self.path, self.key, self.schema, self.rows_per_file = spark, path.rstrip("/"), list(key), schema, rows_per_file
        self.stored_schema = T.StructType([*schema.fields, T.StructField(HASH, T.LongType()), T.StructField(SEQ, T.LongType()),
                                           T.StructField(GONE, T.BooleanType())])

    # -- files -----------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> list[str]:
        """Names of the runs whose manifest is complete: one listing, as many entries as runs."""
        p, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[0]))

    def manifest(self) -> DataFrame:
        """Files of the runs that count."""
        names = self._complete()
        if not names:
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(*[f"{self.path}/manifest/{n}" for n in names])
        replaced = {r for x in rows.where("file IS NULL").select("replaces").collect() for r in x["replaces"]}
        rows = rows.where("file IS NOT NULL").drop("replaces")
        return rows.where(~F.col("run").isin(*replaced)) if replaced else rows

    def runs(self) -> list:
        """(run, seq, n) of the runs that count, newest first."""
        return self.manifest().groupBy("run").agg(F.max("seq").alias("seq"), F.sum("n").alias("n")).orderBy(F.desc("seq")).collect()

    # -- writing ---------------------------------------------------------------------------------

    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _write_run(self, rows: DataFrame, run: str, seq: int, replaces: list[str]) -> None:
        data = f"{self.path}/data/{run}"
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            files = max(1, -(-rows.count() // self.rows_per_file))
            dealt = rows.repartitionByRange(files, HASH) if files > 1 else rows.repartition(1)
            (dealt.sortWithinPartitions(HASH, *self.key).write.mode("overwrite")
             .option(f"parquet.bloom.filter.enabled#{self.key[0]}", "true").parquet(data))
        finally:
            rows.unpersist()
        stored = self.spark.read.schema(self.stored_schema).parquet(data)
        listed = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(HASH).alias("low"), F.max(HASH).alias("high"), F.count(F.lit(1)).alias("n"))
        own = listed.select(F.lit(run).alias("run"), F.lit(seq).cast("long").alias("seq"), "file", "low", "high", "n",
                            F.array().cast("array<string>").alias("replaces"))
        # the row without a file says which runs this one takes the place of, even if it has no rows
        head = self.spark.createDataFrame([(run, seq, None, None, None, 0, replaces)], _MANIFEST)
        own.unionByName(head).write.mode("overwrite").parquet(f"{self.path}/manifest/{run}")

    def _latest(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row per key: the greatest by ``order``; the payload is carried once, beside a narrow order."""
        others = [c for c in rows.columns if c not in self.key]
        narrow = F.struct(*order) if len(order) > 1 else F.col(order[0])
        picked = F.max_by(F.struct(*others), narrow).alias("_row")
        return rows.groupBy(*self.key).agg(picked).select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in others])

    def upsert(self, rows: DataFrame, seq: int, order: list[str] | None = None, gone: Column | None = None) -> None:
        """Store ``rows`` as the newest values of their keys.  Of rows of one key, the greatest by
        ``order``, then by a hash of the row, so that the choice does not depend on arrival."""
        known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key))
        others = [c for c in self.schema.fieldNames() if c not in self.key]
        flag = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
        known = known.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], flag.alias(GONE))
        known = known.withColumn("_tie", F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long"))
        one = self._latest(known, [*(order or []), "_tie"]).drop("_tie")
        stored = one.withColumn(HASH, self._hash()).withColumn(SEQ, F.lit(seq).cast("long")).select(*self.stored_schema.fieldNames())
        self._write_run(stored, f"s{seq:015d}", seq, [])

    def delete(self, keys: DataFrame, seq: int) -> None:
        """S-10: tombstones for ``keys``."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.key]
        self.upsert(keys.select(*self.key, *empty).select(*self.schema.fieldNames()), seq, gone=F.lit(True))

    def insert_if_absent(self, rows: DataFrame, seq: int, order: list[str] | None = None) -> DataFrame:
        """S-08: store the rows whose key has no value; first write wins.  Returns (key, status) of the
        batch's keys: saved or duplicate.  A replay of ``seq`` gives the same answer as its first try."""
        keys = rows.select(*self.key).distinct()
        have = self.present(keys, before=seq).withColumn("_have", F.lit(True))
        status = keys.join(have, self.key, "left").select(
            *self.key, F.when(F.col("_have"), F.lit("duplicate")).otherwise(F.lit("saved")).alias("status"))
        # lineage is cut here: the status must not change when the run below is visible
        p = f"{self.path}/status/s{seq:015d}"
        status.write.mode("overwrite").parquet(p)
        status = self.spark.read.schema(status.schema).parquet(p)
        self.upsert(rows.join(status.where("status = 'saved'").select(*self.key), self.key, "left_semi"), seq, order)
        return status

    # -- reading ---------------------------------------------------------------------------------

    def files_for(self, keys: DataFrame) -> list[str]:
        """Files whose hash range holds a hash of ``keys``.

        Ranges are spread to the slots they touch (a run's files touch SLOTS slots and one more per
        file at most), a key has one slot: an equality join, whatever the size of either side."""
        def slot(h: Column) -> Column:
            return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - (SLOTS.bit_length() - 1)).cast("int")

        ranges = self.manifest().select("file", "low", "high", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))).alias("slot"))
        hashed = keys.select(self._hash().alias("h")).distinct().withColumn("slot", slot(F.col("h")))
        hit = ranges.join(hashed, "slot").where((F.col("h") >= F.col("low")) & (F.col("h") <= F.col("high")))
        return sorted(r["file"] for r in hit.select("file").distinct().collect())

    def _values(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, without ended ones."""
        latest = self._latest(rows.drop(HASH), [SEQ])
        return latest.where(~F.col(GONE)).select(*self.schema.fieldNames())

    def present(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of ``keys`` that have a value: as :func:`lookup`, but the payload is neither read nor shuffled."""
        rows = self._rows_for(keys, before)
        if rows is None:
            return self.spark.createDataFrame([], self.schema).select(*self.key)
        last = rows.select(*self.key, SEQ, GONE).groupBy(*self.key).agg(F.max(F.struct(SEQ, GONE)).alias("_last"))
        return last.where(~F.col(f"_last.{GONE}")).select(*self.key)

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Values of ``keys`` (S-05, S-08), from the files that can hold them; ``before``: as of the
        writes with smaller sequence numbers."""
        rows = self._rows_for(keys, before)
        return self.spark.createDataFrame([], self.schema) if rows is None else self._values(rows)

    def _rows_for(self, keys: DataFrame, before: int | None) -> DataFrame | None:
        """Stored rows of ``keys`` (and ``before``) from the files that can hold them; None without such files."""
        files = self.files_for(keys)
        if not files:
            return None
        rows = self.spark.read.schema(self.stored_schema).parquet(*files)
        if before is not None:
            rows = rows.where(F.col(SEQ) < before)
        return rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def view(self) -> DataFrame:
        """The value of every key (S-09: last writer wins)."""
        files = [r["file"] for r in self.manifest().select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored_schema).parquet(*files)
        return self._values(rows)

    # -- upkeep ----------------------------------------------------------------------------------

    def compact(self, fanout: int = 4, full: bool = False) -> list[str]:
        """Merge the newest runs while the next older one has at most ``fanout`` times the rows merged
        so far, if ``fanout`` runs come together (``full``: all runs).  Returns the runs merged.

        Every key keeps its newest row with its sequence number; tombstones go only if the oldest
        run is merged too, since an older run could hold a value they end."""
        runs = self.runs()
        take, size = [], 0
        for r in runs:
            if take and not full and r["n"] > fanout * max(size, 1):
                break
            take.append(r["run"])
            size += r["n"]
        if len(take) < (2 if full else fanout):
            return []
        files = [r["file"] for r in self.manifest().where(F.col("run").isin(*take)).select("file").collect()]
        rows = self._latest(self.spark.read.schema(self.stored_schema).parquet(*files), [SEQ])
        if len(take) == len(runs):
            rows = rows.where(~F.col(GONE))
        seq = max(r["seq"] for r in runs if r["run"] in take)
        replaced = {x for n in take for x in self._replaced_by(n)} | set(take)
        self._write_run(rows.select(*self.stored_schema.fieldNames()), f"c{seq:015d}-{uuid.uuid4().hex[:8]}", seq, sorted(replaced))
        return take

    def _replaced_by(self, run: str) -> list[str]:
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{run}").where("file IS NULL").select("replaces").first()
        return list(row["replaces"]) if row else []

    def vacuum(self) -> list[str]:
        """Remove the files of runs that were merged; only when no reader of them is left."""
        alive = {r["run"] for r in self.manifest().select("run").distinct().collect()}
        gone = [n for n in self._complete() if n not in alive]
        for n in gone:
            for part in ("manifest", "data"):
                p, fs = self._fs(f"{self.path}/{part}/{n}")
                fs.delete(p, True)
        return gone
