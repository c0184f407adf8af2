"""Filling containers of fixed capacity with items that are not split (problem 9).

The plan is made over the histogram of lengths: best-fit decreasing places counts of equal
items into groups of equal containers, so its work is bounded by the capacity, not by the
number of items. Items then take their slots by a join on length and rank within length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256  # parts in which the items of one length are ranked


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit-decreasing plan: ``(size, rank_from, rank_to, first_container, per_container, first_order)`` and the number of containers.

    Items of ``size`` with ranks in ``[rank_from, rank_to)`` go ``per_container`` each into
    consecutive containers. Equal to placing the items one by one, longest first, each into the
    fullest container it fits in. Items of size 0 spread evenly over all containers.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_groups: dict[int, list[tuple[int, int, int]]] = {}  # space left -> (first container, containers, items in each)
    spaces: list[int] = []
    n_containers = 0

    def put(space: int, first: int, count: int, items: int) -> None:
        if count:
            if space not in open_groups:
                open_groups[space] = []
                bisect.insort(spaces, space)
            open_groups[space].append((first, count, items))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                first, count, items = open_groups[space].pop()
                if not open_groups[space]:
                    del open_groups[space]
                    spaces.pop(at)
            else:
                space, first, items = capacity, n_containers, 0
                count = -(-left // (capacity // size))
                n_containers += count
            per = space // size
            full = min(count, left // per)
            if full:
                slots.append((size, rank, rank + full * per, first, per, items))
                rank, left = rank + full * per, left - full * per
                put(space - per * size, first, full, items + per)
            rest = min(left, per) if full < count else 0
            if rest:
                slots.append((size, rank, rank + rest, first + full, rest, items))
                rank, left = rank + rest, left - rest
                put(space - rest * size, first + full, 1, items + rest)
            used = full + (1 if rest else 0)
            put(space, first + used, count - used, items)
    empty = histogram.get(0, 0)
    if empty:
        if not n_containers:
            slots.append((0, 0, empty, 0, empty, 0))
            return slots, 1
        per, rank = -(-empty // n_containers), 0
        for groups in list(open_groups.values()):
            for first, count, items in groups:
                take = min(count * per, empty - rank)
                if take:
                    slots.append((0, rank, rank + take, first, per, items))
                    rank += take
    return slots, n_containers


def cut_pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece_no, start, size``: items as they are, larger ones cut into full pieces and a rest."""
    last = F.greatest(F.ceil(F.col(size) / capacity) - 1, F.lit(0)).cast("long")
    pieces = sizes.select(key, F.col(size).alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return pieces.select(key, "piece_no", start.alias("start"), F.least(F.col("_n") - start, F.lit(capacity)).cast("int").alias("size"))


def rank_within_size(pieces: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` (from 0) among the pieces of one size.

    Each size is ranked in parts: ranks inside a part plus the sizes of the parts before it, so a
    size that a third of all items share is not sorted in one task.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")
    offsets = parts.select("size", "salt", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "piece_no")) - 1
    return salted.withColumn("inside", inside).join(offsets, ["size", "salt"]).withColumn("rank", F.col("offset") + F.col("inside")).drop("salt", "inside", "offset")


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece_no, start, size, container, item_order`` for every item or piece.

    The histogram (at most ``capacity`` + 1 rows) comes to the driver and the plan (a few rows per
    size) is broadcast; items do not. Keys must be unique. Null sizes count as 0.
    """
    spark = sizes.sparkSession
    plain = sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).alias("_size"))
    pieces = cut_pieces(plain, "_key", "_size", capacity)
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan_slots(histogram, capacity)
    plan = spark.createDataFrame(slots, "slot_size int, rank_from long, rank_to long, first_container long, per_container long, first_order long")
    ranked = rank_within_size(pieces, "_key")
    placed = ranked.join(F.broadcast(plan), (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        F.col("_key").alias(key),
        "piece_no",
        "start",
        "size",
        (F.col("first_container") + F.floor(step / F.col("per_container"))).alias("container"),
        (F.col("first_order") + F.pmod(step, F.col("per_container"))).cast("int").alias("item_order"),
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of capacity in use."""
    total = packed.agg(F.countDistinct("container").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("n_tokens"))
    return total.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * capacity))
