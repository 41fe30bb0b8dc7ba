"""Event-time KPIs over streams: sliding windows under a watermark, and a stream-stream join.

A row that is late by no more than ``delay`` still counts in its windows; one that comes after the
watermark has passed its window is dropped by the aggregation, and :func:`late_groups` reports how
many such groups a query has dropped, so that nothing vanishes unseen.  The join holds each side only
as long as the other can still match it: state is bounded by ``within`` plus ``delay``, not by the
stream.

``collected`` runs a stream over what is there and gives its output as a table; updates of a window
replace each other there (the latest micro-batch wins), so the result equals the batch aggregate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import ensure_checkpoint_dir


def event_time(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as timestamps, which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


@contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no micro-batch without data: with processing-time timers, a run over
    what is there would otherwise go on for ever."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def table_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The files of a Parquet table as a stream; its schema is read from them once.  The table may be
    one file: as a pattern (of one name) the path need not be a folder."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def sliding_kpi(events: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str, delay: str) -> DataFrame:
    """Count, integer hundredths of the sum and extremes of ``value`` per sliding window and ``keys``."""
    hundredths = F.round(F.col(value) * 100).cast("long")
    return (event_time(events, ts).withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("window"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(hundredths).alias("sum_h"), F.min(value).alias("low"), F.max(value).alias("high")))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Rows of ``right`` at most ``within`` after a row of ``left`` with the same key.  Column names of
    the two sides must differ but for the key.  ``left_outer`` rows without a match come once the
    watermark says that none can follow."""
    other = event_time(right, right_ts).withColumnRenamed(key, "_right_key").withWatermark(right_ts, delay)
    on = ((F.col(key) == F.col("_right_key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}")))
    return event_time(left, left_ts).withWatermark(left_ts, delay).join(other, on, how).drop("_right_key")


def late_groups(query) -> int:
    """(Window, key) groups of late rows that a query has dropped so far, by its progress reports."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def collected(stream: DataFrame, name: str, keys: list[str] | None = None, path: str | None = None, checkpoint: str | None = None,
              mode: str | None = None, timers: bool = False) -> DataFrame:
    """The output of ``stream`` over all that is there now, as a table.  With ``keys`` (an aggregation)
    the last update of a key stands; without, rows are appended.  A restart with the same ``path``
    and ``checkpoint`` goes on where the last run ended; a replayed batch overwrites its own rows.
    ``timers``: the stream has processing-time timers, which then do not fire."""
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{root}/out", checkpoint or f"{root}/checkpoint"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    writer = (stream.writeStream.outputMode(mode or ("update" if keys else "append")).foreachBatch(put)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    with data_batches_only(spark) if timers else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return table_of(spark, path, stream, keys)


def table_of(spark: SparkSession, path: str, stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What the batches under ``path`` hold."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{path}/*")
    if not keys:
        return rows.select(*stream.columns)
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])
