"""Helpers shared by the operators of this subpackage.

Rows travel as Arrow batches; inside a task the bytes of many texts are joined in one numpy
buffer, so that tokenising and hashing are array operations.  ``stage`` writes a table to the
folder named by ``spark.checkpoint.dir``: it cuts the lineage and is read by every executor.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.session import ensure_checkpoint_dir

#: Odd 64-bit multiplier of the polynomial hashes, its inverse modulo 2**64, and a mixer.
MULT = 0x9E3779B97F4A7C15 | 1
MULT_INV = pow(MULT, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, drop: str, ddl: str) -> StructType:
    """The fields of ``df`` without ``drop``, then those of ``ddl``."""
    return StructType([f for f in df.schema.fields if f.name != drop] + StructType.fromDDL(ddl).fields)


def as_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, text): all columns of ``docs`` in one struct, so that no name clashes."""
    named = [F.col(c) for c in ("doc_id", "source", "text") if c in docs.columns]
    return docs.select(F.struct("*").alias("row"), *named)


def from_rows(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``row``, its text replaced if one is given."""
    fields = rows.schema["row"].dataType.fieldNames()
    return rows.select(*((text if n == "text" and text is not None else F.col("row").getField(n)).alias(n) for n in fields))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def count_of(total_bytes: int | None, unit: int) -> int:
    return max(1, -(-int(total_bytes or 0) // unit))


def powers(n: int, mult: int = MULT) -> np.ndarray:
    """mult**0 .. mult**(n-1) modulo 2**64; the longest array asked for is kept."""
    have = _POWERS.get(mult)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), mult, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[mult] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (buf[j] + 1) * MULT**j over j < i, modulo 2**64."""
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(len(buf))
    np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end], whatever stands before it."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), MULT_INV)[start]


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, even for hashes that are small or share low bits."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    mixed *= MIX
    return ((mixed >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... (lengths[0] of them), then those of starts[1], ..."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    out += np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths)
    return out


def one_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if not isinstance(col, pa.ChunkedArray):
        return col
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def joined(arr: pa.Array, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column in one buffer, ``gap`` zero bytes after each value; starts, ends."""
    arr = one_array(arr)
    if not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=arr.offset * 8)
    flat = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not gap:
        return flat, off[:-1].copy(), off[1:].copy()
    starts = off[:-1] + gap * np.arange(n)
    lengths = np.diff(off)
    out = np.zeros(len(flat) + gap * n, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    ends = starts + lengths
    for g in range(gap):
        keep[ends + g] = False
    out[keep] = flat
    return out, starts, ends


def binary_array(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(buf))])


def shards(batches, column: str, limit: int):
    """Cut the record batches of a task in slices whose ``column`` holds about ``limit`` bytes
    (a longer text is a slice of its own); small batches are put together first."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        begin = 0
        for i, add in enumerate(lengths.tolist()):
            if size and size + add > limit:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, i
            size += add
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def words_of(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes whose class is true; the buffer's texts are
    parted by at least one byte of class false."""
    flag = np.zeros(len(buf) + 2, dtype=np.int8)
    flag[1:-1] = is_word[buf]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t
