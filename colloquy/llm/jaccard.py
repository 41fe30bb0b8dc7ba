"""N-gram Jaccard self-join by chosen paths (similarity 0.8 or more on five-word shingles).

Texts with equal shingle sets are one representative with a weight.  Every representative holds a
MinHash signature: coordinate k samples one token of its set, the same token for every set that
shares it and has it as the smallest.  A run splits the representatives recursively: at each node
the path so far draws one coordinate, and sometimes a second (1 / THRESHOLD on average), and the
members go to the child of their sampled token.  A bucket of at most ``LEAF`` members is a leaf.
Of a larger one about ``SAMPLE`` members are compared: if their signatures agree in ``ALIKE`` of the
coordinates on average (its members are alike, so splitting would hardly part them), or ``DEPTH``
levels are reached, it is a mass; otherwise it is split again.  Runs are repeated until a pair at
0.8 is missed by all with probability ``MISS`` at most: it stays together with probability 0.84 a
split, so ``RUNS`` (12) are enough for three splits; the members of buckets that are split more
often get further runs among themselves, as many as the deepest of those needs.

Masses of all runs that share a member are one group.  Its members are dealt to blocks of about
``BLOCK`` members or ``BLOCK_BYTES`` of shingles, and every pair of blocks is compared once, whatever
the number of runs that found the group; a block travels as one row.  Leaves are compared inside
tasks, first by signatures alone (pairs with fewer than ``AGREE`` of 64 equal coordinates are far
below 0.8), then the members that have a partner left get their texts' shingles and the pairs are
verified exactly.  A pair counts in one place only: in their group if both have the same one, else
in the smallest leaf that both share.  No pair of documents is ever a row: each leaf or pair of
blocks gives, per member, its weighted number of partners and an edge to the smallest member of its
component; the edges are joined to classes by alternating large-star and small-star steps.

Result per row: class_id (smallest doc_id of the connected component) and n_links (other documents
with similarity 0.8 or more, copies counted).  Words are lower-case ``[^\\x20\\x09-\\x0D]+``; a
text of one to four words is one shingle.  Rows without words or with a null doc_id are a class of
their own (class_id = doc_id, no links).  Repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import (MIX, as_rows, count_of, from_rows, joined, one_array, lower_table, prefix_hash, ragged, range_hash, shards, stage,
                                 text_bytes, words_of)

SHINGLE = 5
#: Similarity as a fraction: a pair is linked if NUM * |union| <= DEN * |intersection|.
NUM, DEN = 4, 5
COORDS = 64
RUNS, LEAF, DEPTH, ALIKE, SAMPLE = 12, 1024, 8, 0.5, 128
#: Members and bytes of shingles of a block of a group of masses.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Bound of the probability that every run parts a pair at 0.8.
MISS = 2.5e-5
#: 51 of 64 coordinates are expected to agree at 0.8, with a deviation of 3.2.
AGREE = 30
SLICE_BYTES = 4 << 20
LEAVES_PER_TASK = 20_000
#: Bytes of shingles and members that a verifying task reads, about.
TASK_BYTES, TASK_MEMBERS = 8 << 20, 2_000
#: Parts that the rows of one group are dealt to when its total is joined back to them (at most 31).
SALTS = 16

_LOWER = lower_table()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x9, 0xE)]] = False
_IS_WORD[0] = False  # parts the texts of a buffer; a NUL inside a text ends a word as well


def _salts() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: flat values, and how many each text has."""
    buf, starts, ends = joined(data, gap=1)
    n = len(starts)
    buf = _LOWER[buf]
    a, b = words_of(buf, _IS_WORD)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    doc = np.searchsorted(starts, a, side="right") - 1
    word = range_hash(prefix_hash(buf), a, b)
    word ^= word >> np.uint64(31)
    word *= MIX
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    many = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    at = ragged(first, many)
    owner = np.repeat(np.arange(n), many)
    size = np.minimum(count, SHINGLE)[owner]
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(SHINGLE):
        on = j < size
        h[on] = (h[on] ^ word[at[on] + j]) * np.uint64(0x9FB21C651E98DF25)
        h[on] ^= h[on] >> np.uint64(28)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n)


def signatures(flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MinHash signature (COORDS 32-bit values) of each non-empty set, zeros for empty ones."""
    out = np.zeros((len(count), COORDS), dtype=np.uint32)
    some = np.flatnonzero(count)
    if len(some):
        head = (np.cumsum(count) - count)[some]
        for k, salt in enumerate(_salts()):
            x = flat * salt
            x ^= x >> np.uint64(32)
            x *= MIX
            low = np.minimum.reduceat(x, head)
            out[some, k] = (low ^ (low >> np.uint64(32))).astype(np.uint32)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, rep (digest of the shingle set, null without words), n_shingles, signature."""
    src = docs.select("doc_id", text_bytes().alias("_data"))

    def run(batches):
        for part in shards(batches, "_data", SLICE_BYTES):
            flat, count = shingle_sets(one_array(part.column("_data")))
            sig = signatures(flat, count)
            end = np.cumsum(count)
            reps = [hashlib.blake2b(flat[e - c:e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(end.tolist(), count.tolist())]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in part.column("_data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [one_array(part.column("doc_id")), pa.array(keys, pa.binary()), pa.array(reps, pa.binary()),
                 pa.array(count, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "text_key", "rep", "n_shingles", "signature"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text_key binary, rep binary, n_shingles int, signature binary")


def _token(path: Column, coord: Column) -> Column:
    """Child of a node: the path, the coordinate and the token that the set has there."""
    return F.xxhash64(path, coord, F.substring(F.col("signature"), coord * 4 + 1, F.lit(4)))


def _children(path: Column) -> Column:
    """Children of a node for one set: one drawn coordinate, and a second for one node in four."""
    a = F.pmod(F.xxhash64(path, F.lit("a")), F.lit(COORDS)).cast("int")
    b = F.pmod(F.xxhash64(path, F.lit("b")), F.lit(COORDS)).cast("int")
    two = F.pmod(F.xxhash64(path, F.lit("c")), F.lit(NUM)) == 0
    return F.when(two & (a != b), F.array(_token(path, a), _token(path, b))).otherwise(F.array(_token(path, a)))


def with_total(rows: DataFrame, key: str, by: str, total: Column, name: str) -> DataFrame:
    """Every row with the total of its ``key`` group.  The rows of a group are dealt to SALTS parts by
    a hash of ``by``; the total, combined map-side, goes to the parts that the group has."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    totals = salted.groupBy(key).agg(total.alias(name), F.expr("bit_or(shiftleft(1, _salt))").alias("_salts"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("_salts", k) == 1)
    return salted.join(totals.select(key, name, F.explode(parts).alias("_salt")), [key, "_salt"]).drop("_salt")


def runs_for(splits: int) -> int:
    """Runs after which a pair at 0.8 is missed with probability MISS at most, if each run has ``splits`` splits."""
    one = NUM / DEN
    together = one * (1 - 1 / NUM) + (1 - (1 - one) ** 2) / NUM  # one coordinate, or either of two
    return math.ceil(math.log(MISS) / math.log1p(-together ** splits))


def _alike(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(leaf, alike) of every large bucket, from about SAMPLE of its members, chosen by a hash."""
    chosen = large.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.ceil(F.col("size") / SAMPLE)) == 0)

    def judge(t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint32).reshape(t.num_rows, COORDS)
        n = len(sig)
        share = (_agreement(sig).astype(np.int64).sum() - n * COORDS) / (max(1, n * (n - 1)) * COORDS)
        return pa.table({"leaf": t.column("leaf").slice(0, 1), "alike": pa.array([bool(share >= ALIKE)])})

    return (chosen.join(reps.select("rep", "signature"), "rep").select("leaf", "signature")
            .groupBy("leaf").applyInArrow(judge, "leaf long, alike boolean"))


def _with_value(rows: DataFrame, key: str, by: str, values: DataFrame) -> DataFrame:
    """Left join of ``values``, a row per key; the rows of a key are dealt to SALTS parts by a hash of ``by``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(parts, [key, "_salt"], "left").drop("_salt")


def _paths(reps: DataFrame, runs: range, leaf: int, depth: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """Of the given runs: (leaf, rep) rows of leaves, and of masses (None: there are none); the
    members of buckets split more often than all runs so far allow (or None); levels of splitting."""
    roots = F.array(*[F.xxhash64(F.lit("run"), F.lit(r)) for r in runs])
    rows = reps.select("rep", F.explode(F.flatten(F.transform(roots, _children))).alias("leaf"))
    out, masses, deep, level = None, None, None, 0
    while True:
        sized = stage(with_total(rows, "leaf", "rep", F.count("*"), "size").where("size > 1"), f"paths-{level}")
        done = sized.where(F.col("size") <= leaf).select("leaf", "rep")
        out = done if out is None else out.unionByName(done)
        large = sized.where(F.col("size") > leaf)
        if large.isEmpty():
            return out, masses, deep, level
        large = _with_value(large, "leaf", "rep", stage(_alike(large, reps), f"alike-{level}"))
        ends = F.coalesce(F.col("alike"), F.lit(False)) | F.lit(level >= depth)
        mass = large.where(ends).select("leaf", "rep")
        if not mass.isEmpty():
            masses = mass if masses is None else masses.unionByName(mass)
        if level >= depth:
            return out, masses, deep, level
        level += 1
        split = stage(large.where(~ends).select("leaf", "rep").join(reps.select("rep", "signature"), "rep"), f"split-{level}")
        if runs_for(level) > runs.stop:
            members = split.select("rep")
            deep = members if deep is None else deep.unionByName(members)
        rows = split.select("rep", F.explode(_children(F.col("leaf"))).alias("leaf"))


def leaves(reps: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, rep) rows of the leaves of all runs, and of the masses (None: there are none)."""
    out, masses, deep, level = _paths(reps, range(runs), leaf, depth)
    done = runs
    while deep is not None and runs_for(level) > done:
        members = stage(reps.join(deep.distinct(), "rep", "left_semi"), "deep")
        more, mass, deep, reached = _paths(members, range(done, runs_for(level)), leaf, depth)
        done, level = runs_for(level), max(level, reached)
        out = out.unionByName(more)
        if mass is not None:
            masses = mass if masses is None else masses.unionByName(mass)
    return out, masses


def groups(masses: DataFrame) -> DataFrame:
    """(rep, grp) of all members of masses: masses that share a member are one group."""
    low = stage(masses.groupBy("rep").agg(F.min("leaf").alias("low"), F.collect_set("leaf").alias("all")), "mass-members")
    # the edges are between masses, of which there are at most runs * documents / LEAF
    edges = low.select(F.col("low").alias("u"), F.explode("all").alias("v")).distinct()
    roots = components(edges).select(F.col("node").alias("low"), "root")
    return stage(_with_value(low.select("rep", "low"), "low", "rep", roots).select("rep", F.coalesce("root", "low").alias("grp")), "groups")


def _first_leaf(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether no smaller leaf than this one has both members of a pair."""
    n = len(lists)
    ok = np.ones((n, n), dtype=bool)
    at: dict[int, list[int]] = {}
    for m, own in enumerate(lists):
        for x in own[own < leaf].tolist():
            at.setdefault(x, []).append(m)
    for members in at.values():
        if len(members) > 1:
            ok[np.ix_(members, members)] = False
    return ok


def _agreement(sig: np.ndarray) -> np.ndarray:
    if len(sig) <= 24:
        return (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
    out = np.zeros((len(sig), len(sig)), dtype=np.uint8)
    for k in range(sig.shape[1]):
        col = sig[:, k]
        out += col[:, None] == col[None, :]
    return out


def _candidates(leaf: int, lists: list[np.ndarray], sig: np.ndarray, grp: np.ndarray) -> np.ndarray:
    """Pairs of a leaf that this leaf has to judge (``grp``: group of each member, -1 without)."""
    pairs = np.triu(_agreement(sig) >= AGREE, 1)
    if pairs.any():
        pairs &= (grp[:, None] != grp[None, :]) | (grp < 0)[:, None]
        pairs &= _first_leaf(lists, leaf)
    return pairs


def _intersections(sets: list[np.ndarray], cut: int | None = None) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets: all, or those of the first ``cut`` with the others."""
    n, size = len(sets), np.array([len(x) for x in sets])
    value, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = times[which] > 1
    owner, which = owner[common], np.unique(which[common], return_inverse=True)[1]
    rows, cols = (slice(0, n), slice(0, n)) if cut is None else (slice(0, cut), slice(cut, n))
    out = np.zeros((rows.stop, n - cols.start), dtype=np.float32)
    width = int(which.max()) + 1 if len(which) else 0
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    for at in range(0, width, 2048):  # float32 holds whole numbers up to 2**24 exactly
        a, b = np.searchsorted(which, [at, at + 2048])
        block = np.zeros((n, min(2048, width - at)), dtype=np.float32)
        block[owner[a:b], which[a:b] - at] = 1
        out += block[rows] @ block[cols].T
    return out.astype(np.int32)


def _parts(t: pa.Table):
    """Leaves in a task's table, and the rows of each."""
    leaf = t.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    head = np.flatnonzero(np.diff(leaf[order], prepend=leaf[order[0]] - 1)) if len(order) else order
    for a, b in zip(head.tolist(), np.append(head[1:], len(order)).tolist()):
        yield int(leaf[order[a]]), order[a:b]


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    arr = one_array(col)
    off, values = arr.offsets.to_numpy(), arr.values.to_numpy()
    return [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint32).reshape(t.num_rows, COORDS)


def _filter_part(t: pa.Table) -> pa.Table:
    """Members of leaves that have a partner left, judged by their signatures."""
    lists, sig, grp = _lists(t.column("own_leaves")), _signatures(t), t.column("grp").to_numpy()
    keep = np.zeros(t.num_rows, dtype=bool)
    for leaf, rows in _parts(t):
        if len(rows) > 1:
            pairs = _candidates(leaf, [lists[r] for r in rows], sig[rows], grp[rows])
            keep[rows[pairs.any(axis=0) | pairs.any(axis=1)]] = True
    at = t.schema.get_field_index("own_leaves")
    kind = pa.list_(pa.field("element", pa.int64()))
    return t.set_column(at, pa.field("own_leaves", kind), t.column(at).cast(kind)).filter(pa.array(keep))


LINKS = "rep binary, root binary, links long"


class _Links:
    """Links found by one task: per member, the weight of its partners and the root of its component."""

    def __init__(self):
        self.rep, self.root, self.links = [], [], []

    def add(self, links: np.ndarray, reps: list[bytes], weight: np.ndarray) -> None:
        """``links``: symmetric matrix of the members ``reps``."""
        some = np.flatnonzero(links.any(axis=1))
        if not len(some):
            return
        order = sorted(some.tolist(), key=lambda m: reps[m])
        part = links[np.ix_(order, order)]
        # the smallest label spreads over the links; columns sorted by label, the first link is the smallest
        label = np.arange(len(order))
        while True:
            by = np.argsort(label, kind="stable")
            new = np.minimum(label, label[by[part[:, by].argmax(axis=1)]])
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = weight[order]
        total = np.concatenate([part[k:k + 256] @ own for k in range(0, len(order), 256)])
        for m, r, n in zip(order, label.tolist(), total.tolist()):
            self.rep.append(reps[m]), self.root.append(reps[order[r]]), self.links.append(int(n))

    def table(self) -> pa.Table:
        return pa.table({"rep": pa.array(self.rep, pa.binary()), "root": pa.array(self.root, pa.binary()), "links": pa.array(self.links, pa.int64())})


def _similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (NUM + DEN) * inter >= NUM * (a[:, None] + b[None, :]).astype(np.int32)


def _verify_part(t: pa.Table) -> pa.Table:
    """Links of the members of leaves."""
    lists, sig, grp, weight = _lists(t.column("own_leaves")), _signatures(t), t.column("grp").to_numpy(), t.column("weight").to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
    reps = t.column("rep").to_pylist()
    out = _Links()
    for leaf, rows in _parts(t):
        if len(rows) < 2:
            continue
        pairs = _candidates(leaf, [lists[r] for r in rows], sig[rows], grp[rows])
        if pairs.any():
            size = np.array([len(sets[r]) for r in rows])
            pairs &= _similar(_intersections([sets[r] for r in rows]), size, size)
            out.add(pairs | pairs.T, [reps[r] for r in rows], weight[rows])
    return out.table()


BLOCK_ROW = "grp long, block int, tiles int, reps binary, weights binary, signatures binary, counts binary, shingles binary"


def _pack(t: pa.Table) -> pa.Table:
    """A block's members as one row."""
    sets = t.column("shingles").to_pylist()
    cells = {"reps": b"".join(t.column("rep").to_pylist()), "weights": t.column("weight").to_numpy().astype(np.int64).tobytes(),
             "signatures": b"".join(t.column("signature").to_pylist()), "counts": np.array([len(x) // 8 for x in sets], dtype=np.int64).tobytes(),
             "shingles": b"".join(sets)}
    first = {c: t.column(c).slice(0, 1) for c in ("grp", "block", "tiles")}
    return pa.table(first | {c: pa.array([x], pa.binary()) for c, x in cells.items()})


def _compare_blocks(t: pa.Table) -> pa.Table:
    """Links between the members of two blocks, or inside one."""
    reps, weight, sig, sets, cut = [], [], [], [], []
    for r in t.sort_by("block").to_pylist():
        reps += [r["reps"][k:k + 16] for k in range(0, len(r["reps"]), 16)]
        weight.append(np.frombuffer(r["weights"], dtype=np.int64))
        sig.append(np.frombuffer(r["signatures"], dtype=np.uint32).reshape(-1, COORDS))
        flat, ends = np.frombuffer(r["shingles"], dtype=np.uint64), np.cumsum(np.frombuffer(r["counts"], dtype=np.int64))
        sets += np.split(flat, ends[:-1])
        cut.append(len(sets))
    size = np.array([len(x) for x in sets])
    out, n = _Links(), len(sets)
    links = np.zeros((n, n), dtype=bool)
    if len(cut) == 2:
        k = cut[0]
        cross = np.zeros((k, n - k), dtype=np.uint8)
        for c in range(COORDS):
            cross += sig[0][:, c][:, None] == sig[1][:, c][None, :]
        pairs = cross >= AGREE
        if pairs.any():
            pairs &= _similar(_intersections(sets, k), size[:k], size[k:])
        links[:k, k:], links[k:, :k] = pairs, pairs.T
    elif n > 1 and t.column("i")[0].as_py() == t.column("j")[0].as_py():
        links = (_agreement(sig[0]) >= AGREE) & _similar(_intersections(sets), size, size)
        np.fill_diagonal(links, False)
    out.add(links, reps, np.concatenate(weight))
    return out.table()


def group_links(members: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links inside the groups, as (rep, root, links), from (grp, rep, weight, signature, shingles)."""
    sized = with_total(members, "grp", "rep", F.struct(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")), "_of")
    tiles = F.greatest(F.ceil(F.col("_of.n") / block), F.ceil(F.col("_of.bytes") / block_bytes)).cast("int")
    sized = sized.withColumn("tiles", tiles).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("tiles")).cast("int"))
    blocks = sized.select("grp", "block", "tiles", "rep", "weight", "signature", "shingles").groupBy("grp", "block").applyInArrow(_pack, BLOCK_ROW)
    blocks = stage(blocks, "blocks")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, F.col("block")).alias("i"), F.greatest(t, F.col("block")).alias("j")))).alias("p")
    return blocks.select("*", pairs).select("*", "p.i", "p.j").drop("p").groupBy("grp", "i", "j").applyInArrow(_compare_blocks, LINKS)


def _shingles(texts: DataFrame) -> DataFrame:
    """Shingles of the texts that have the representative's set (an id may stand before other texts too)."""
    def run(batches):
        for part in shards(batches, "_data", SLICE_BYTES):
            flat, count = shingle_sets(one_array(part.column("_data")))
            sets = [flat[e - c:e].tobytes() for e, c in zip(np.cumsum(count).tolist(), count.tolist())]
            got = [(r, x) for r, x in zip(part.column("rep").to_pylist(), sets) if hashlib.blake2b(x, digest_size=16).digest() == r]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())],
                                             names=["rep", "shingles"])

    return texts.mapInArrow(run, "rep binary, shingles binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected component, by large-star and small-star steps."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest one of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (with_total(both, "u", "v", F.least(F.min("v"), F.col("u")), "m").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        small = (with_total(large, "u", "v", F.min("v"), "m")
                 .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        edges = stage(small, "edges")
        was, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _bucket(tasks: int) -> Column:
    return F.pmod(F.xxhash64("leaf"), F.lit(tasks)).cast("int").alias("bucket")


def join(docs: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, class_id, n_links per row of ``docs``."""
    prints = stage(fingerprints(docs), "fingerprints")
    known = prints.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull())
    reps = stage(known.groupBy("rep").agg(F.min("doc_id").alias("low"), F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles"),
                                          F.first("signature").alias("signature")), "reps")
    rows, masses = leaves(reps, runs, leaf, depth)
    grouped = groups(masses) if masses is not None else None
    own = rows.groupBy("rep").agg(F.collect_list("leaf").alias("own_leaves"))  # bounded by the runs and their branches
    tasks = max(1, -(-rows.count() // LEAVES_PER_TASK))
    names = ["leaf", "rep", "grp", "own_leaves", "weight", "n_shingles", "signature"]
    schema = "leaf long, rep binary, grp long, own_leaves array<long>, weight long, n_shingles int, signature binary"
    kept = reps.select("rep", "weight", "n_shingles", "signature")
    kept = kept.join(grouped, "rep", "left") if grouped is not None else kept.withColumn("grp", F.lit(None).cast("long"))
    # groups are named by a hash: without its sign bit, -1 stands for none
    kept = kept.withColumn("grp", F.coalesce(F.col("grp").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(-1).cast("long")))
    members = rows.join(own, "rep").join(kept, "rep").select(*names, _bucket(tasks))
    left = stage(members.groupBy("bucket").applyInArrow(lambda t: _filter_part(t.select(names)), schema), "partners")
    chosen = left.select("rep")
    if grouped is not None:
        chosen = chosen.unionByName(grouped.select("rep"))
    chosen = chosen.distinct().join(reps.select("rep", "low"), "rep")
    texts = docs.select(F.col("doc_id").alias("low"), text_bytes().alias("_data")).join(chosen, "low").select("rep", "_data")
    sets = _shingles(texts).dropDuplicates(["rep"])
    n, total = left.agg(F.count("*"), F.sum(F.col("n_shingles").cast("long") * 8)).first()
    tasks = max(count_of(n, TASK_MEMBERS), count_of(total, TASK_BYTES))
    verified = left.join(sets, "rep").select(*names, "shingles", _bucket(tasks)).groupBy("bucket").applyInArrow(
        lambda t: _verify_part(t.select([*names, "shingles"])), LINKS)
    if grouped is not None:
        inside = kept.where("grp >= 0").select("grp", "rep", "weight", "signature").join(sets, "rep")
        verified = verified.unionByName(group_links(inside, block))
    verified = stage(verified, "links")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    labelled = (reps.select("rep", "low", "weight").join(links, "rep", "left")
                .join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    final = with_total(labelled, "root", "rep", F.min("low"), "class_id").select(
        "rep", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    identified = F.when(F.col("doc_id").isNotNull(), F.col("rep"))
    return (prints.select("doc_id", "text_key", identified.alias("rep")).join(final, "rep", "left")
            .select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def digest(joined_rows: DataFrame) -> DataFrame:
    return joined_rows.select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id (null ids all stay; of rows
    that repeat id and text one stays); columns as given."""
    low = join(docs).where(F.col("doc_id") == F.col("class_id")).select("doc_id", F.lit(True).alias("_low")).distinct()
    rows = as_rows(docs).select("row", "doc_id", F.xxhash64(text_bytes()).alias("_text"))
    known = rows.where(F.col("doc_id").isNotNull()).join(low, "doc_id", "left_semi").dropDuplicates(["doc_id", "_text"])
    return from_rows(known.unionByName(rows.where(F.col("doc_id").isNull())))
