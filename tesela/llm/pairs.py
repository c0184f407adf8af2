"""Items that appear together: pair counts and association over all records (problem 4).

Items get dense 32-bit codes, a pair is one 64-bit code. Each task fills a buffer of pair
codes, sorts it and emits it as a run of (code, count); the shuffle sorts the runs outside
memory (Spark's sorter spills sorted runs and merges them) and a streaming run-length pass
sums equal codes. No task holds more than its buffer, whatever the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.session import durable

BUFFER = 1 << 21  # pair codes sorted at a time
BUCKETS = 1024  # id = rank in bucket * BUCKETS + bucket


def encode_items(items: DataFrame, min_records: int) -> DataFrame:
    """``field_name, item, n, id``: items in at least ``min_records`` records, with a dense id.

    Ids are ranks within hash buckets, so no step numbers all items in one task.
    """
    counts = items.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_records)
    bucket = F.pmod(F.xxhash64("field_name", "item"), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("field_name", "item"))
    return counts.withColumn("bucket", bucket).withColumn("id", rank.cast("long") * BUCKETS + F.col("bucket")).drop("bucket")


def _run(codes: list[np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["code", "n"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        lists = batch.column(0)
        offsets = np.asarray(lists.offsets)
        ids = np.asarray(lists.values)
        lengths = np.diff(offsets)
        for n in np.unique(lengths):
            if n < 2:
                continue
            starts = offsets[:-1][lengths == n]
            a, b = np.triu_indices(int(n), 1)
            step = max(1, BUFFER // len(a))
            for at in range(0, len(starts), step):
                rows = starts[at : at + step, None]
                held.append(((ids[rows + a] << 32) | ids[rows + b]).ravel())
                size += held[-1].size
                if size >= BUFFER:
                    yield _run(held)
                    held, size = [], 0
    if held:
        yield _run(held)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        keys, sums = code[heads], np.add.reduceat(n, heads)
        if last is not None and keys[0] == last:
            sums[0] += total
        elif last is not None:
            keys, sums = np.concatenate(([last], keys)), np.concatenate(([total], sums))
        last, total = keys[-1], sums[-1]
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], ["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["code", "n"])


def pair_counts(records: DataFrame, key: str, fields: list[str], min_pair: int = 5) -> DataFrame:
    """``field_name, item_a, item_b, n_a, n_b, n_ab``: pairs of items in at least ``min_pair`` records.

    records: one row per record, ``fields`` hold normal items (repeats and order do not
    matter). Items in fewer than ``min_pair`` records cannot be in such a pair and leave
    before pairs form; that loses nothing. item_a < item_b by code point.
    """

    def tagged(field: str) -> Column:
        return F.transform(F.array_distinct(field), lambda x: F.struct(F.lit(field).alias("field_name"), x.alias("item")))

    each = records.select(F.col(key).alias("_record"), F.explode(F.concat(*map(tagged, fields))).alias("t")).select("_record", "t.*")
    codes = durable(encode_items(each, min_pair), eager=True)
    baskets = each.join(codes.select("field_name", "item", "id"), ["field_name", "item"]).groupBy("_record", "field_name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    runs = baskets.where(F.size("ids") > 1).select("ids").mapInArrow(_sorted_runs, "code long, n long")
    counted = runs.repartition(F.col("code")).sortWithinPartitions("code").mapInArrow(_merge_runs, "code long, n long")
    frequent = counted.where(F.col("n") >= min_pair).select(F.shiftright("code", 32).alias("id_x"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_y"), F.col("n").alias("n_ab"))
    x = codes.select(F.col("id").alias("id_x"), "field_name", F.col("item").alias("item_x"), F.col("n").alias("n_x"))
    y = codes.select(F.col("id").alias("id_y"), F.col("item").alias("item_y"), F.col("n").alias("n_y"))
    both = frequent.join(x, "id_x").join(y, "id_y")
    first = F.col("item_x") < F.col("item_y")
    return both.select(
        "field_name",
        F.least("item_x", "item_y").alias("item_a"),
        F.greatest("item_x", "item_y").alias("item_b"),
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
        "n_ab",
    )


def association(pairs: DataFrame, n_records: Column) -> DataFrame:
    """Adds ``lift`` (times more often than chance) and ``odds_ratio`` with a continuity correction of one half."""
    a, b, ab, n = F.col("n_a"), F.col("n_b"), F.col("n_ab"), n_records
    odds = ((ab + 0.5) * (n - a - b + ab + 0.5)) / ((a - ab + 0.5) * (b - ab + 0.5))
    return pairs.withColumn("lift", ab * n / (a * b)).withColumn("odds_ratio", odds)
