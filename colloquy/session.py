"""SparkSession construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "colloquy") -> SparkSession:
    """Session tuned for this engine: AQE on (coalescing, skew join, runtime broadcast
    conversion), UTC session time, UI off.  On a cluster, pass master=None and let
    spark-submit decide; partitions then come from the cluster's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("COLLOQUY_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Unset, a local session gets a fresh scratch folder;
    on a cluster it is an error, since executors do not share local folders."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="colloquy-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(ensure_checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def bounded_tasks(spark: SparkSession, partitions: int, split_bytes: int):
    """Inside, every exchange has ``partitions`` partitions at least and a scan's task reads ``split_bytes`` of a
    file at most; the session's own settings hold where they make smaller tasks, and are set back."""
    shuffle, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    old = {key: spark.conf.get(key) for key in (shuffle, split)}
    spark.conf.set(shuffle, str(max(int(old[shuffle]), partitions)))
    spark.conf.set(split, str(min(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), split_bytes)))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
