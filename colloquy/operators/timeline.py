"""As-of joins, running sums and trailing range frames in time blocks.

A window function over a key sorts all rows of that key in one task.  Here the time axis is cut in
``parts`` blocks: rows are sorted per (key, block), and what a block needs from the ones before (the
last row, or the sum) comes from one row per (key, block), of which a key has ``parts`` at most.  So a
key that holds a third of all rows is spread over the blocks, and nothing is collected.

Rows whose key or time is null keep their row and match nothing; of equal times, a right row counts
for a left one, and of right rows at one time the greatest by ``order`` is taken; an empty side gives
no matches.  Helper columns start with ``_t_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _blocked(rows: DataFrame, parts: int) -> DataFrame:
    """Adds the block of ``_t_at``; the ends of the axis are one small aggregate."""
    ends = rows.agg(F.min("_t_at").alias("a"), F.max("_t_at").alias("b")).first()
    low, width = (ends["a"] or 0), max(1, -(-((ends["b"] or 0) - (ends["a"] or 0) + 1) // parts))
    return rows.withColumn("_t_block", F.floor((F.col("_t_at") - F.lit(low)) / F.lit(width)).cast("int"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str],
              order: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """Every row of ``left`` with ``take`` of the last row of ``right`` with its keys and a time not
    after its own (null: there is none).  Names of ``take`` must not be among the columns of ``left``."""
    known = [F.col(k).isNotNull() for k in keys]
    usable = known[0]
    for k in known[1:]:
        usable = usable & k
    picked = F.struct(*take).alias("_t_right")
    r = right.where(usable & F.col(right_time).isNotNull()).select(
        *keys, _micros(F.col(right_time)).alias("_t_at"), F.lit(0).alias("_t_side"),
        picked, F.struct(*(order or [F.lit(0).alias("_t_none")])).alias("_t_tie"))
    own = F.struct(*left.columns).alias("_t_left")
    matched = left.where(usable & F.col(left_time).isNotNull()).select(
        *keys, _micros(F.col(left_time)).alias("_t_at"), F.lit(1).alias("_t_side"), own)
    rows = _blocked(matched.unionByName(r, allowMissingColumns=True), parts)
    here = Window.partitionBy(*keys, "_t_block").orderBy("_t_at", "_t_side", "_t_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_t_near", F.last("_t_right", ignorenulls=True).over(here)).where("_t_side = 1")
    # the last right row of each block, carried to the later blocks of its key
    last = rows.groupBy(*keys, "_t_block").agg(F.max(F.when(F.col("_t_side") == 0, F.struct("_t_at", "_t_tie", "_t_right"))).alias("_t_last"))
    before = Window.partitionBy(*keys).orderBy("_t_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_t_block", F.last("_t_last", ignorenulls=True).over(before)["_t_right"].alias("_t_carry"))
    found = near.join(carry, [*keys, "_t_block"], "left").withColumn("_t_got", F.coalesce("_t_near", "_t_carry"))
    out = found.select("_t_left.*", *[F.col(f"_t_got.{c}").alias(c) for c in take])
    rest = left.where(~F.coalesce(usable & F.col(left_time).isNotNull(), F.lit(False)))
    types = {f.name: f.dataType for f in right.schema.fields}
    return out.unionByName(rest.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in take]))


def running_sums(df: DataFrame, keys: list[str], time: str, values: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """Per distinct (keys, time): the sums of ``values`` (integers) over all rows of the keys up to that
    time.  Rows of one key and time are combined map-side first."""
    once = df.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time)).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    rows = _blocked(once.withColumn("_t_at", _micros(F.col(time))), parts)
    here = Window.partitionBy(*keys, "_t_block").orderBy("_t_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.groupBy(*keys, "_t_block").agg(*[F.sum(n).alias(n) for n in values])
    before = Window.partitionBy(*keys).orderBy("_t_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*keys, "_t_block", *[F.sum(n).over(before).alias(f"_t_{n}") for n in values])
    inside = rows.select(*keys, time, "_t_block", *[F.sum(n).over(here).alias(n) for n in values])
    return inside.join(carry, [*keys, "_t_block"]).select(*keys, time, *[(F.col(n) + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in values])


def trailing(df: DataFrame, keys: list[str], time: str, values: dict[str, Column], span: str, parts: int = PARTS) -> DataFrame:
    """Per distinct (keys, time): the sums of ``values`` over the rows of the keys from ``span`` before that
    time to it, both ends included: the running sum less the one before the span."""
    sums = running_sums(df, keys, time, values, parts)
    start = (F.col(time).cast("timestamp") - F.expr(f"INTERVAL {span}") - F.expr("INTERVAL 0.000001 SECONDS")).alias("_before")
    old = sums.select(*keys, F.col(time).alias("_old_time"), *[F.col(n).alias(f"_old_{n}") for n in values])
    both = asof_join(sums.select("*", start), old, keys, "_before", "_old_time", [f"_old_{n}" for n in values], parts=parts)
    return both.select(*keys, time, *[(F.col(n) - F.coalesce(f"_old_{n}", F.lit(0))).alias(n) for n in values])
