"""Sparse weighted vectors and their distributed cosine join.

A vector is a set of hashed features (character n-grams and the like); a feature weighs the square
root of its inverse document frequency. Two vectors whose cosine reaches the threshold share a
feature among the heaviest ones of both (the prefix filter), so only those are posted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # features are hashed to so many numbers, which bounds the table of weights whatever the data


def hashed(*parts: Column) -> Column:
    """Number of a feature."""
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def gram_features(text: Column, n: Column | int, *tags: Column) -> Column:
    """Distinct character n-grams of a text with its ends marked, as features; equal n-grams of different tags differ."""
    n = F.lit(n) if isinstance(n, int) else n
    marked = F.concat(F.lit("#"), text, F.lit("#"))
    count = F.greatest(F.length(marked) - n + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: hashed(*tags, n, F.substr(marked, i, n))))


def feature_weights(vectors: DataFrame, column: str = "features", times: Column | None = None) -> np.ndarray:
    """Weight of every feature number; a row counts ``times`` (once, if not given). The counts that come to the driver are ``BUCKETS`` at most."""
    counts = np.zeros(BUCKETS)
    rows = vectors.select(F.explode(column).alias("f"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    seen = rows.groupBy("f").agg(F.sum("times").alias("n")).toArrow()
    counts[np.asarray(seen["f"])] = np.asarray(seen["n"])
    most = max(counts.max(), 1.0)
    return np.sqrt(np.log1p(most / np.maximum(counts, 1.0)) + 0.1).astype(np.float32)


def cosine(left: pa.ListArray, right: pa.ListArray, weights: np.ndarray) -> np.ndarray:
    """Cosines of paired vectors."""

    def flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        offsets, values = np.asarray(x.offsets), np.asarray(x.values)
        rows = np.repeat(np.arange(len(x)), np.diff(offsets))
        values = values[offsets[0] : offsets[-1]]
        return rows * np.int64(BUCKETS) + values, np.bincount(rows, weights[values].astype(float) ** 2, len(x))

    (a, na), (b, nb) = flat(left), flat(right)
    both = np.intersect1d(a, b, assume_unique=True)
    dot = np.bincount(both // BUCKETS, weights[both % BUCKETS].astype(float) ** 2, len(left))
    return dot / np.sqrt(np.maximum(na * nb, 1e-12))


def posted(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``vectors`` once per posted feature, which comes as ``feature`` in place of ``features``; ``least`` is the cosine that counts."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    rest = [f for f in vectors.schema.fields if f.name != "features"]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("features"))
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            rows, values = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), values[offsets[0] : offsets[-1]]
            mass = w[values].astype(float) ** 2
            order = np.lexsort((values, -mass, rows))
            rows, values, mass = rows[order], values[order], mass[order]
            total = np.bincount(rows, mass, batch.num_rows)
            before = np.cumsum(mass) - mass
            starts = np.concatenate(([0.0], np.cumsum(total)))[:-1]
            left = total[rows] - (before - starts[rows])  # squared length of what is left from here on
            least = np.asarray(batch.column(batch.schema.get_field_index("least")))
            keep = left >= least[rows] ** 2 * total[rows] * (1 - 1e-9)
            at = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)).take(at) for n in names], pa.array(values[keep], pa.int32())], [*names, "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return vectors.mapInArrow(run, f"{schema}, feature int")


def cosine_join(left: DataFrame, right: DataFrame, weights: np.ndarray, threshold: float | Column, where: Column, features: Callable[[str], Column], top_n: int | None = None) -> DataFrame:
    """Pairs of rows whose vectors have a cosine of at least ``threshold``: ``a``, ``b`` (structs of the rows) and ``cosine``.

    Both sides have ``id`` and ``features``, which do not travel with the postings: ``features`` makes
    them again from the columns of ``a`` or ``b`` for the pairs that met. A threshold that is a column must be equal on both sides
    of all pairs that ``where`` admits. ``where`` is a condition on ``a`` and ``b`` that is checked
    while postings meet, before any cosine is taken. A feature that very many vectors post is a
    skewed key, which adaptive execution splits. Exact: no pair at the threshold that ``where``
    admits is lost, unless ``top_n`` keeps only the best ones of every row of the left side.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small postings may meet in many pairs: no coalescing

    def side(df: DataFrame, name: str) -> DataFrame:
        least = F.lit(threshold) if isinstance(threshold, float) else threshold
        rows = posted(df.withColumn("least", least.cast("double")), weights)
        return rows.select("feature", F.struct(*[c for c in df.columns if c != "features"], "least").alias(name)).repartition(n, "feature")

    met = side(left, "a").join(side(right, "b"), "feature").where((F.col("a.id") != F.col("b.id")) & where)
    pairs = met.select("a", "b").distinct().select("a", "b", features("a").alias("x"), features("b").alias("y"))

    found = similar(pairs, weights)
    if top_n is None:
        return found
    best = Window.partitionBy("a.id").orderBy(F.desc("cosine"), "b.id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).drop("rank")


def similar(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``a, b, cosine`` of pairs ``a, b`` (structs) with vectors ``x, y`` whose cosine reaches the field ``least`` of ``a``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = cosine(batch.column(2), batch.column(3), shared.value)
            keep = pa.array(c >= np.asarray(batch.column(0).field("least")))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(c).filter(keep)], ["a", "b", "cosine"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.select("a", "b", "x", "y").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, cosine double")
