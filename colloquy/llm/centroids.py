"""Centroid clustering of integer vectors by equal-average equal-variance search.

Vectors with exactly ``DIMS`` finite components become integers floor(1024 * x).  The first
centroids are the ``k`` kept vectors with the smallest hashes; every round assigns each vector to
its nearest centroid (squared distance, ties to the smaller number) and replaces each centroid by
the exact floor of its vectors' mean; a centroid without vectors stays.

The search keeps the centroids sorted by component sum.  A vector starts at its own sum and takes
the nearer of the next centroid below and above.  With S the sum of the components, Q that of
their squares and U = sqrt(DIMS * Q - S**2),

    DIMS * distance >= (Sx - Sc)**2 + (Ux - Uc)**2,

so a side ends where the squared gap of the sums alone exceeds DIMS times the best distance (exact
integers), and a centroid is rejected where both gaps do (in floats, with a margin above their
rounding error).  What is left gets its distance in integers.  All vectors of a batch take one
step together.

A round is one pass over the table: tasks return sums per centroid, which one small aggregation
adds; only ``k`` rows come back to the driver.  Components of 2**24 and more are computed in
Python's integers; a distance or inertia that does not fit a long is null.

Vectors that are null, of another length, or hold a null or a non-finite component are not kept
and give no row.  Repeated rows give a row each; a null id is hashed as the word null; equal hashes
are ordered by the components.  With fewer than ``k`` vectors there are fewer centroids, with none
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stage

DIMS, CLUSTERS, ROUNDS = 64, 8, 10
#: Vectors per step of the search.
BATCH = 1 << 15
_LONG = 1 << 63

#: Sums of one task: n vectors of a centroid, component sums and summed distance as decimal text.
PARTIAL = "cluster int, n long, sums string, inertia string"


def small(dims: int) -> int:
    """Components below this bound keep every product of the search in 64 bits."""
    return (1 << 30) // dims


def kept(vectors: DataFrame, column: str = "embedding", dims: int = DIMS) -> DataFrame:
    """Rows whose ``column`` has exactly ``dims`` finite components, as doubles."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vectors.where(v.isNotNull() & (F.size(v) == dims)).where(~bad).withColumn(column, v.cast("array<double>"))


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): int64 where every component is small, Python's integers otherwise."""
    if not x.size or np.abs(x).max() * 1024 < small(x.shape[1]):
        return np.floor(x * 1024).astype(np.int64)
    return np.array([[math.floor(math.ldexp(v, 10)) if abs(v) < 2.0 ** 53 else int(v) << 10 for v in row] for row in x.tolist()], dtype=object)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def _spread_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and U of each vector."""
    s, q = v.sum(axis=1), (v * v).sum(axis=1)
    u = v.shape[1] * q - s * s
    if v.dtype != object:
        return s, np.sqrt(u.astype(np.float64))
    return s, np.array([math.isqrt(int(x)) for x in u], dtype=object)


class Search:
    """Centroids sorted by component sum."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, dtype=object)
        fits = all(abs(x) < small(len(c)) for c in centroids for x in c)
        self.v = exact.astype(np.int64) if fits else exact
        order = sorted(range(len(centroids)), key=lambda c: (sum(centroids[c]), c))
        self.order = np.array(order, dtype=np.int64)
        self.v = self.v[self.order]
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, per row of ``x``."""
        v = self.v
        if x.dtype == object or v.dtype == object:
            x, v = x.astype(object), v.astype(object)
        n, k, dims = len(x), len(v), v.shape[1]
        s, u = _spread_of(x)
        cs, cu = _spread_of(v)
        high = np.searchsorted(cs, s)
        low = high - 1
        best = np.zeros(n, dtype=x.dtype)
        number = np.full(n, -1, dtype=np.int64)
        live = np.arange(n)
        for _ in range(k):
            lo, hi = low[live], high[live]
            gap_lo = np.abs(s[live] - cs[np.maximum(lo, 0)])
            gap_hi = np.abs(s[live] - cs[np.minimum(hi, k - 1)])
            down = (hi >= k) | ((lo >= 0) & (gap_lo <= gap_hi))
            at, gap = np.where(down, lo, hi), np.where(down, gap_lo, gap_hi)
            # the nearer side's gap bounds every centroid that is left
            going = (at >= 0) & (at < k)
            going &= (number[live] < 0) | (gap * gap <= dims * best[live])
            live, at, gap, down = live[going], at[going], gap[going], down[going]
            if not len(live):
                break
            if x.dtype == object:
                far = np.array([abs(int(p) - int(q)) - 1 for p, q in zip(u[live], cu[at])], dtype=object)
                reject = gap * gap + np.where(far > 0, far * far, 0) > dims * best[live]
            else:
                apart = u[live] - cu[at]
                wide = gap.astype(np.float64) ** 2
                slack = 1e-9 * ((u[live] + cu[at]) ** 2 + wide) + 1
                reject = wide + apart * apart - slack > dims * best[live].astype(np.float64)
            near = (number[live] < 0) | ~reject.astype(bool)
            who, which = live[near], at[near]
            d = _distance(x[who], v[which])
            self.compared += len(who)
            num = self.order[which]
            won = (number[who] < 0) | (d < best[who]) | ((d == best[who]) & (num < number[who]))
            best[who[won]], number[who[won]] = d[won], num[won]
            low[live[down]] -= 1
            high[live[~down]] += 1
        return number, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return np.asarray(flat).astype(np.float64, copy=False).reshape(-1, dims)


def _batches(batches, column: str, dims: int):
    """(record batch, integer vectors) in steps of at most BATCH rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, to_integers(_matrix(part.column(part.schema.get_field_index(column)), dims))


def _text(numbers) -> str:
    return ",".join(str(int(x)) for x in numbers)


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def _add(rows) -> tuple[int, list[int], int]:
    """Sum of partial rows (n, sums, inertia)."""
    n, total, inertia = 0, None, 0
    for m, sums, part in rows:
        values = _numbers(sums)
        n, inertia = n + m, inertia + int(part)
        total = values if total is None else [a + b for a, b in zip(total, values)]
    return n, total or [], inertia


def _partial_rows(held: dict[int, tuple[int, list[int], int]]) -> pa.RecordBatch:
    rows = sorted(held.items())
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.int64()),
         pa.array([_text(v[1]) for _, v in rows], pa.string()), pa.array([str(v[2]) for _, v in rows], pa.string())],
        names=["cluster", "n", "sums", "inertia"])


def round_sums(vectors: DataFrame, column: str, centroids: list[list[int]]) -> dict[int, tuple[int, list[int], int]]:
    """Per centroid: vectors nearest to it, their component sums and summed distance."""
    search = vectors.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids[0])

    def assign(batches):
        index, held = Search(search.value), {}
        for _, x in _batches(batches, column, dims):
            number, d = index.nearest(x)
            for c in np.unique(number).tolist():
                mine = number == c
                new = (int(mine.sum()), _text(x[mine].sum(axis=0)), str(int(d[mine].astype(object).sum())))
                old = held.get(c)
                held[c] = _add([new] + ([(old[0], _text(old[1]), old[2])] if old else []))
        if held:
            yield _partial_rows(held)

    def merge(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        return pa.Table.from_batches([_partial_rows({got[0]["cluster"]: _add((r["n"], r["sums"], r["inertia"]) for r in got)})])

    sums = vectors.select(column).mapInArrow(assign, PARTIAL).groupBy("cluster").applyInArrow(merge, PARTIAL)
    return {r.cluster: (r.n, _numbers(r.sums), int(r.inertia)) for r in sums.collect()}


def first_centroids(vectors: DataFrame, id_col: str, column: str, k: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``3:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("_key"), F.col(column).alias("_v")).orderBy("_key", "_v").limit(k).collect()
    return [[int(x) for x in to_integers(np.array([r["_v"]], dtype=np.float64))[0]] for r in rows]


def fit(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over all of ``vectors`` (rows as :func:`kept` gives them)."""
    centroids = first_centroids(vectors, id_col, column, k)
    for _ in range(rounds if centroids else 0):
        sums = round_sums(vectors, column, centroids)
        moved = [[x // sums[c][0] for x in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]
        if moved == centroids:  # every later round would repeat this one
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, cluster, distance of every row; distances that do not fit a long are null."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids[0]) if centroids else DIMS
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("_v"))

    def run(batches):
        if not held.value:
            return
        index = Search(held.value)
        for part, x in _batches(batches, "_v", dims):
            number, d = index.nearest(x)
            d = pa.array([int(y) if y < _LONG else None for y in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), d], names=["vec_id", "cluster", "distance"])

    kind = src.schema["vec_id"].dataType.simpleString()
    return src.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    rows = kept(vectors, column, dims).select(id_col, column)
    centroids = fit(rows, id_col, column, k, rounds)
    placed = stage(assign(rows, centroids, id_col, column), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # a null distance makes its sums null; the result has at most k rows
    total = F.when(F.count("*") == F.count("distance"), wide)
    sums = [(r.cluster, r.total) for r in placed.groupBy("cluster").agg(total.alias("total")).collect()]
    whole = None if any(t is None for _, t in sums) else sum(int(t) for _, t in sums)
    fits = [(c, int(t) if t is not None and t < _LONG else None) for c, t in sums]
    digest = [hashlib.sha256(_text(c).encode()).hexdigest() for c in centroids]
    inertia, sha = F.lit(None).cast("long"), F.lit(None).cast("string")
    for c, t in fits:
        inertia = F.when(F.col("cluster") == c, F.lit(t).cast("long")).otherwise(inertia)
        sha = F.when(F.col("cluster") == c, F.lit(digest[c])).otherwise(sha)
    return placed.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"),
                         F.lit(whole if whole is not None and whole < _LONG else None).cast("long").alias("inertia"), sha.alias("centroid_sha256"))
