"""Vector search and matrix normalisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, POINT_CHUNK, SLICE = 4096, 16_384, 128  # a task holds one slice of a block against a chunk: 16 MB of distances


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """``query, neighbour, distance, rank``: the k nearest other points of every query, exactly.

    Queries go in blocks against all points in chunks; a (block, chunk) pair is one task that compares
    a slice of its queries at a time and yields k candidates per query, and the chunks' candidates
    merge by rank.
    """
    n_q, n_p = queries.count(), points.count()
    blocks, chunks = max(1, math.ceil(n_q / QUERY_BLOCK)), max(1, math.ceil(n_p / POINT_CHUNK))
    h = lambda m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), h(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    p = points.select(F.col(key).alias("p"), F.col(vector).alias("v"), h(chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        every, y, other = np.stack(a.v.to_numpy()).astype(float), np.stack(b.v.to_numpy()).astype(float), b.p.to_numpy()
        if metric == "cosine":
            every, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (every, y))
        squares, take, near, far = (y**2).sum(1), min(k, len(y)), [], []
        for start in range(0, len(every), SLICE):
            x = every[start : start + SLICE]
            d = 1 - x @ y.T if metric == "cosine" else np.sqrt(np.maximum((x**2).sum(1)[:, None] + squares - 2 * x @ y.T, 0))
            d[a.q.to_numpy()[start : start + SLICE, None] == other] = np.inf
            at = np.argpartition(d, take - 1, axis=1)[:, :take]
            near.append(other[at].ravel())
            far.append(np.take_along_axis(d, at, 1).ravel())
        return pd.DataFrame({"query": np.repeat(a.q.to_numpy(), take), "neighbour": np.concatenate(near), "distance": np.concatenate(far)})

    found = q.groupBy("block", "chunk").cogroup(p.groupBy("block", "chunk")).applyInPandas(search, "query long, neighbour long, distance double").where(F.col("distance") < float("inf"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def column_stats(rows: DataFrame) -> DataFrame:
    """Statistics per dimension of long rows ``id, dim, v``."""
    return rows.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.abs("v")).alias("top"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.expr("percentile(v, array(0.25D, 0.5D, 0.75D))").alias("q"))


def normalise(rows: DataFrame, method: str) -> DataFrame:
    """Long rows ``id, dim, v`` scaled per dimension: divmax, minmax, zscore (population), robust (IQR), none.

    Null and NaN values become 0 before scaling; a spread under 1e-12 divides by 1.
    """
    clean = rows.withColumn("v", F.when(F.col("v").isNull() | F.isnan("v"), 0.0).otherwise(F.col("v")))
    if method == "none":
        return clean
    s = column_stats(clean)
    guard = lambda c: F.when(F.abs(c) < 1e-12, 1.0).otherwise(c)
    j = clean.join(s, "dim")
    form = {
        "divmax": F.col("v") / guard(F.col("top")),
        "minmax": (F.col("v") - F.col("lo")) / guard(F.col("hi") - F.col("lo")),
        "zscore": (F.col("v") - F.col("mean")) / guard(F.col("std")),
        "robust": (F.col("v") - F.col("q")[1]) / guard(F.col("q")[2] - F.col("q")[0]),
    }[method]
    return j.select("id", "dim", form.alias("v"))


def long_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.posexplode(vector).alias("dim", "x")).select("id", "dim", F.col("x").cast("double").alias("v"))


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and second-moment matrix of a vector column; D x D numbers per task, whatever the rows."""

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))
            if len(x):
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0)], "m": [(x.T @ x).ravel()]})

    parts = df.select(vector).mapInPandas(run, "n long, s array<double>, m array<double>")
    sums = parts.select("n", F.posexplode(F.concat("s", "m")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        return 0, np.zeros(0), np.zeros((0, 0))
    v = np.array([r["v"] for r in sums])
    dim = int((math.isqrt(1 + 4 * len(v)) - 1) // 2)
    return int(sums[0]["n"]), v[:dim], v[dim:].reshape(dim, dim)


def spectrum(df: DataFrame, vector: str, centred: bool = True) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, mean, descending eigenvalues and eigenvectors of the (co)moment matrix."""
    n, s, m = gram(df, vector)
    mean = s / n if n else s
    cov = m / n - np.outer(mean, mean) if centred else m / n
    w, u = np.linalg.eigh(cov)
    return n, mean, np.maximum(w[::-1], 0), u[:, ::-1]
