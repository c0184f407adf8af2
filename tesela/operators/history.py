"""History of a changing attribute from periodic snapshots (problem 5).

Snapshots are compared by a Merkle tree: rows hash into leaf buckets, buckets into
inner nodes up to one root per period. Two consecutive periods are compared from the
root down, level by level, and only nodes under a differing parent are compared; rows of
unchanged leaf buckets are never diffed. The changes of all period pairs then chain into
versions. The tree has as many leaves as keep their buckets small, whatever the number of keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.session import durable

FANOUT_BITS = 4
LEAF_KEYS = 4  # keys of a leaf bucket, about


def snapshot(rows: DataFrame, key: str, period: str, value: str, order: str) -> DataFrame:
    """``key, period, value``: per key and period the row with the greatest ``order``.

    Rows with null key, period or value are ignored; a tie takes the greatest value.
    """
    kept = rows.select(F.col(key).alias("key"), F.col(period).alias("period"), F.col(value).alias("value"), F.col(order).alias("ord")).dropna(subset=["key", "period", "value"])
    best = kept.groupBy("key", "period").agg(F.max(F.struct("ord", "value")).alias("best"))
    return best.select("key", "period", F.col("best.value").alias("value"))


def _leaf(bits: int):
    return F.pmod(F.xxhash64("key"), F.lit(1 << bits)).cast("int")


def tree_depth(snap: DataFrame, fanout_bits: int = FANOUT_BITS) -> int:
    """Levels below the root at which a leaf bucket holds about ``LEAF_KEYS`` keys; a leaf number stays under 2**28."""
    keys = snap.agg(F.approx_count_distinct("key").alias("n")).collect()[0]["n"]
    return min(max(1, math.ceil(math.log2(max(keys / LEAF_KEYS, 1)) / fanout_bits)), 28 // fanout_bits)


def tree(snap: DataFrame, fanout_bits: int, depth: int) -> DataFrame:
    """``period, level, node, h``: the hashes of all nodes. What a snapshot's hashes are stored as: the next snapshot needs no more of it."""
    leaves = snap.groupBy("period", _leaf(fanout_bits * depth).alias("leaf")).agg(F.expr("bit_xor(xxhash64(key, value))").alias("h"), F.count(F.lit(1)).alias("n"))
    path = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col("leaf"), (F.lit(depth) - i) * fanout_bits).alias("node")))
    return leaves.select("period", F.xxhash64("leaf", "h", "n").alias("h"), F.explode(path).alias("at")).groupBy("period", "at.level", "at.node").agg(F.expr("bit_xor(h)").alias("h"))


def changed_leaves(nodes: DataFrame, fanout_bits: int, depth: int) -> DataFrame:
    """``period, leaf``: leaf buckets whose content in ``period`` differs from that of the period before, found from the roots down."""
    differing = None
    for level in range(depth + 1):
        here = nodes.where(F.col("level") == level).select("period", "node", "h")
        sides = here.select("period", "node", F.col("h").alias("h1"), F.lit(None).cast("long").alias("h0")).unionByName(here.select((F.col("period") + 1).alias("period"), "node", F.lit(None).cast("long").alias("h1"), F.col("h").alias("h0")))
        if differing is not None:
            sides = sides.withColumn("parent", F.shiftright("node", fanout_bits)).join(differing.withColumnRenamed("node", "parent"), ["period", "parent"], "left_semi")
        unequal = sides.groupBy("period", "node").agg(F.max("h1").alias("h1"), F.max("h0").alias("h0")).where(~F.col("h1").eqNullSafe(F.col("h0")))
        differing = unequal.select("period", "node")
    return differing.withColumnRenamed("node", "leaf")


def descent(snap: DataFrame, fanout_bits: int = FANOUT_BITS, depth: int | None = None) -> DataFrame:
    """``period, leaves, entered``: leaf buckets of a period and of the one before, and how many of them are diffed at all."""
    depth = depth or tree_depth(snap, fanout_bits)
    nodes = durable(tree(snap, fanout_bits, depth), eager=True)
    leaves = nodes.where(F.col("level") == depth).select("period", "node")
    either = leaves.unionByName(leaves.select((F.col("period") + 1).alias("period"), "node")).distinct().groupBy("period").agg(F.count(F.lit(1)).alias("leaves"))
    entered = changed_leaves(nodes, fanout_bits, depth).groupBy("period").agg(F.count(F.lit(1)).alias("entered"))
    return either.join(entered, "period", "left").select("period", "leaves", F.coalesce("entered", F.lit(0)).alias("entered"))


def versions(snap: DataFrame, fanout_bits: int = FANOUT_BITS, depth: int | None = None) -> DataFrame:
    """``key, value, valid_from, valid_to``: longest runs of consecutive periods with one value.

    A period without a row ends the version. Groups by key hold at most two rows per
    period, since the snapshot has one.
    """
    snap = durable(snap, eager=True)
    depth = depth or tree_depth(snap, fanout_bits)
    bits = fanout_bits * depth
    leaves = changed_leaves(durable(tree(snap, fanout_bits, depth), eager=True), fanout_bits, depth)
    rows = snap.withColumn("leaf", _leaf(bits))
    sides = rows.select("key", "period", "leaf", F.col("value").alias("new"), F.lit(None).cast("string").alias("old")).unionByName(
        rows.select("key", (F.col("period") + 1).alias("period"), "leaf", F.lit(None).cast("string").alias("new"), F.col("value").alias("old"))
    )
    changes = (
        sides.join(leaves, ["period", "leaf"], "left_semi")
        .groupBy("key", "period")
        .agg(F.max("new").alias("new"), F.max("old").alias("old"))
        .where(~F.col("new").eqNullSafe(F.col("old")))
    )
    chained = changes.groupBy("key").agg(
        F.sort_array(F.expr("collect_list(struct(period, new)) filter (where new is not null)")).alias("starts"),
        F.sort_array(F.expr("collect_list(period - 1) filter (where old is not null)")).alias("ends"),
    )
    return chained.select("key", F.explode(F.arrays_zip("starts", "ends")).alias("v")).select(
        "key", F.col("v.starts.new").alias("value"), F.col("v.starts.period").alias("valid_from"), F.col("v.ends").alias("valid_to")
    )
