"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A document descends the tree: at each level every child draws ``-ln(u) / weight`` with ``u`` a
hash of (doc_id, child), and the smallest draw wins (weighted rendezvous).  A child's draws do
not depend on its siblings, so changing one subtree's weight moves rows only into that subtree
(weight up) or out of it (weight down); the placement inside every other subtree stays.  A new
shard opens a subtree of its own (a new region of weight 1), hence one more shard takes rows only
into itself.  The law is ``key``: the id and the tree decide, sizes and contents do not.

Null ids are hashed as the string 'null' and share one shard; repeated ids share a shard and get
a slot each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import stage, text_bytes


@dataclass(frozen=True)
class Node:
    """Inner node (children) or leaf (shard number)."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def topology(n_shards: int, regions: int = 2, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """``n_shards`` dealt over regions and racks; a node weighs as much as its shards."""
    w = weights or {}
    tree = []
    for r in range(regions):
        region = []
        for k in range(racks):
            leaves = tuple(Node(f"shard{s}", w.get(s, 1.0), (), s) for s in range(n_shards)
                           if s * regions * racks // n_shards == r * racks + k)
            if leaves:
                region.append(Node(f"region{r}/rack{k}", sum(x.weight for x in leaves), leaves))
        if region:
            tree.append(Node(f"region{r}", sum(x.weight for x in region), tuple(region)))
    return Node("root", sum(x.weight for x in tree), tuple(tree))


def with_new_shard(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    leaf = Node(f"shard{shard}", weight, (), shard)
    rack = Node(f"region-of-{shard}/rack0", weight, (leaf,))
    region = Node(f"region-of-{shard}", weight, (rack,))
    return Node(root.name, root.weight + weight, (*root.children, region))


def place(key: Column, root: Node) -> Column:
    """Shard of a key: descend the tree by weighted draws.  One expression, no join."""
    if not root.children:
        return F.lit(root.shard)
    if len(root.children) == 1:
        return place(key, root.children[0])
    # 53 random bits in (0, 1), so that the logarithm is finite
    u = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(c.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
         for c in root.children]
    draws = [-F.log(x) / F.lit(float(c.weight)) for x, c in zip(u, root.children)]
    best = F.array_position(F.array(*draws), F.array_min(F.array(*draws)))
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(root.children, 1))):
        out = F.when(best == i, place(key, c)).otherwise(out)
    return out


def assign(docs: DataFrame, root: Node, grown: Node | None = None, rows_per_piece: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``.

    Slots: each shard is cut in pieces of about ``rows_per_piece`` rows by a hash; the piece counts
    are summed along each shard (a small table), and rows are numbered inside their piece, so no
    shard is numbered by one task.  Many rows of one id are spread by their scan task's number.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    data = text_bytes()
    rows = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"),
        place(key, root).cast("int").alias("shard"),
        (place(key, grown).cast("int") if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("_task"))
    rows = stage(rows, "placed")
    pieces = max(1, -(-rows.count() // rows_per_piece))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "_task"), F.lit(pieces)).cast("int"))
    sizes = rows.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    base = sizes.select("shard", "_piece", (F.sum("_n").over(W.partitionBy("shard").orderBy("_piece")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(W.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("_i", inside - 1)
    return numbered.join(base, ["shard", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_base") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
