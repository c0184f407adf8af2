"""Self-organising maps on hexagonal grids, with distributed batch and online training."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.vectors import spectrum


def grid(rows: int, cols: int) -> np.ndarray:
    """Centres of a flat-topped hexagonal grid: 1.5 between columns, sqrt(3) between rows, odd columns shifted by half a row."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    return np.stack([c * 1.5, (r + 0.5 * (c % 2)) * math.sqrt(3)], 1)


def distances(x: np.ndarray, w: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "manhattan":
        return np.abs(x[:, None] - w[None]).sum(-1)
    if metric == "canberra":
        return (np.abs(x[:, None] - w[None]) / (np.abs(x[:, None]) + np.abs(w[None]) + 1e-15)).sum(-1)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (w**2).sum(1) - 2 * x @ w.T, 0))


def grid_size(n: int, ratio: float, rule: str = "big") -> tuple[int, int]:
    """Rows and columns: 10 N neurons (``big``) or 5 sqrt(N) (``small``), aspect by the ratio of singular values in [1/3, 3] or [0.2, 5]."""
    neurons = 10 * n if rule == "big" else 5 * math.sqrt(n)
    lo, hi = (1 / 3, 3.0) if rule == "big" else (0.2, 5.0)
    ratio = min(max(ratio, lo), hi)
    cols = max(2, round(math.sqrt(neurons / ratio)))
    return max(2, round(neurons / cols)), cols


def epochs(n_samples: int, n_neurons: int, batch: bool = True) -> int:
    """100 for batch training, else 500 M / N kept in [20, 2000]."""
    return 100 if batch else int(min(max(500 * n_neurons / max(n_samples, 1), 20), 2000))


def initial_weights(df: DataFrame, vector: str, rows: int, cols: int, init: str = "pca", seed: int = 42) -> np.ndarray:
    """Start weights: on the plane of the two main components, uniform in the mean +- 2 deviations, or zeros."""
    n, mean, values, axes = spectrum(df, vector)
    if init == "zeros":
        return np.zeros((rows * cols, len(mean)))
    if init == "random":
        return mean + np.random.default_rng(seed).uniform(-2, 2, (rows * cols, len(mean))) * np.sqrt((axes**2 @ values))
    at = grid(rows, cols)
    at = (at - at.mean(0)) / np.maximum(np.abs(at - at.mean(0)).max(0), 1e-9)
    out = mean + np.outer(at[:, 0], axes[:, 0] * math.sqrt(values[0]))
    return out + np.outer(at[:, 1], axes[:, 1] * math.sqrt(values[1])) if len(values) >= 2 else out


def train_batch(df: DataFrame, vector: str, rows: int, cols: int, iterations: int = 10, sigma_start: float | None = None, weights: np.ndarray | None = None, metric: str = "euclidean") -> np.ndarray:
    """Batch training: every step sums inputs and counts per best neuron in the tasks, the neighbourhood kernel is applied to the sums.

    What a step returns is neurons x dimensions numbers, independent of the rows.
    """
    spark = df.sparkSession
    w = initial_weights(df, vector, rows, cols) if weights is None else weights.copy()
    at = grid(rows, cols)
    apart = ((at[:, None] - at[None]) ** 2).sum(-1)
    sigma0 = sigma_start or 0.5 * (rows + cols) / 2
    for t in range(iterations):
        shared = spark.sparkContext.broadcast(w)

        def step(batches: Iterator[pd.DataFrame], b=shared) -> Iterator[pd.DataFrame]:
            sums, counts = np.zeros_like(b.value), np.zeros(len(b.value))
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[vector].to_numpy()).astype(float)
                    best = distances(x, b.value, metric).argmin(1)
                    np.add.at(sums, best, x)
                    counts += np.bincount(best, minlength=len(counts))
            hit = np.flatnonzero(counts)
            yield pd.DataFrame({"i": hit, "n": counts[hit], "s": list(sums[hit])})

        parts = df.select(vector).mapInPandas(step, "i int, n double, s array<double>").select("i", F.posexplode(F.concat(F.array("n"), "s")).alias("d", "v")).groupBy("i", "d").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((len(w), w.shape[1] + 1))
        for r in parts:
            total[r["i"], r["d"]] = r["v"]
        sigma = max(0.1, sigma0 * math.exp(-t / max(iterations, 1)))
        kernel = np.exp(-apart / (2 * sigma**2))
        mass = kernel @ total[:, 0]
        w = np.where(mass[:, None] > 1e-12, (kernel @ total[:, 1:]) / np.maximum(mass[:, None], 1e-12), w)
    return w


def train_online(df: DataFrame, vector: str, rows: int, cols: int, rate: float = 0.5, sigma_start: float | None = None, seed: int = 42) -> np.ndarray:
    """Online training: each task updates its own copy of the map with every one of its rows, in the order of a hash, and the copies are averaged by rows seen.

    Learning rate and radius fall with the rows a task has seen of its expected share, so the sizes
    of Arrow batches change nothing.
    """
    w0 = initial_weights(df, vector, rows, cols)
    shared, at = df.sparkSession.sparkContext.broadcast(w0), grid(rows, cols)
    apart = ((at[:, None] - at[None]) ** 2).sum(-1)
    sigma0 = sigma_start or 0.5 * (rows + cols) / 2
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(df.count() / parts, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, n = shared.value.copy(), 0
        for pdf in batches:
            for v in np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else ():
                t = min(n / share, 1.0)
                best = int(((w - v) ** 2).sum(1).argmin())
                h = np.exp(-apart[best] / (2 * max(0.1, sigma0 * math.exp(-3 * t)) ** 2)) * rate * max(1 - t, 0.01)
                w += h[:, None] * (v - w)
                n += 1
        yield pd.DataFrame({"n": [float(n)], "w": [w.ravel() * n]})

    mixed = df.select(vector, F.xxhash64(vector, F.lit(seed)).alias("_order")).repartition(parts, "_order").sortWithinPartitions("_order").select(vector)
    sums = mixed.mapInPandas(run, "n double, w array<double>").select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    return (np.array([r["v"] for r in sums]) / max(sums[0]["n"], 1.0)).reshape(w0.shape)


def neighbours(rows: int, cols: int) -> np.ndarray:
    at = grid(rows, cols)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    return (d < 1.85) & (d > 0)


def assign(df: DataFrame, key: str, vector: str, weights: np.ndarray, rows: int, cols: int, metric: str = "euclidean") -> DataFrame:
    """``id, bmu, second, qe, violation`` of every row."""
    shared, near = df.sparkSession.sparkContext.broadcast(weights), neighbours(rows, cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf[vector].to_numpy()).astype(float), shared.value, metric)
                order = np.argsort(d, 1)[:, :2]
                yield pd.DataFrame({"id": pdf[key], "bmu": order[:, 0], "second": order[:, 1], "qe": d[np.arange(len(d)), order[:, 0]], "violation": ~near[order[:, 0], order[:, 1]]})

    return df.select(key, vector).mapInPandas(run, "id long, bmu int, second int, qe double, violation boolean")


def umatrix(weights: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean distance of each neuron to its hexagonal neighbours."""
    near = neighbours(rows, cols)
    d = distances(weights, weights)
    return (d * near).sum(1) / np.maximum(near.sum(1), 1)


def neurons(spark, weights: np.ndarray, rows: int, cols: int, hits: DataFrame | None = None) -> DataFrame:
    """Neuron table: position, weights, U-matrix value, and hits and mean error scaled by their maximum."""
    at, u = grid(rows, cols), umatrix(weights, rows, cols)
    base = spark.createDataFrame([(int(i), int(i // cols), int(i % cols), float(at[i, 0]), float(at[i, 1]), [float(v) for v in weights[i]], float(u[i])) for i in range(len(weights))], "idx int, row int, col int, x double, y double, w array<double>, u double")
    if hits is None:
        return base
    h = hits.groupBy(F.col("bmu").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.avg("qe").alias("q"))
    top = h.agg(F.max("n").alias("n"), F.max("q").alias("q"))
    return base.join(h.crossJoin(F.broadcast(top.withColumnsRenamed({"n": "tn", "q": "tq"}))), "idx", "left").select(*base.columns, F.coalesce(F.col("n") / F.col("tn"), F.lit(0.0)).alias("frequency"), F.coalesce(F.col("q") / F.col("tq"), F.lit(0.0)).alias("qe"))


def drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Weight change of each neuron, scaled by the largest."""
    d = np.linalg.norm(after - before, axis=1)
    return d / max(d.max(), 1e-12)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters of a neuron table (bounded by the grid)."""
    groups = {i: ([i], x[i].copy()) for i in range(len(x))}
    while len(groups) > k:
        keys = list(groups)
        c = np.stack([groups[i][1] for i in keys])
        n = np.array([len(groups[i][0]) for i in keys], float)
        cost = ((c[:, None] - c[None]) ** 2).sum(-1) * (n[:, None] * n[None]) / (n[:, None] + n[None])
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        a, b = keys[i], keys[j]
        merged = groups[a][0] + groups[b][0]
        groups[a] = (merged, x[merged].mean(0))
        del groups[b]
    out = np.zeros(len(x), int)
    for label, (members, _) in enumerate(groups.values()):
        out[members] = label
    return out


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
    return label


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters of a neuron table; -1 is noise."""
    near = distances(x, x) <= eps
    core, label, current = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                p = todo.pop()
                if label[p] < 0:
                    label[p] = current
                    if core[p]:
                        todo += list(np.flatnonzero(near[p] & (label < 0)))
            current += 1
    return label


def quality_of(x: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of a labelling of a neuron table."""
    ks = np.unique(label)
    d = distances(x, x)
    sil = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min((d[i, label == k].mean() for k in ks if k != label[i]), default=0.0)
        sil.append((b - a) / max(a, b, 1e-12) if own.sum() > 1 else 0.0)
    c = np.stack([x[label == k].mean(0) for k in ks])
    s = np.array([np.linalg.norm(x[label == k] - c[i], axis=1).mean() for i, k in enumerate(ks)])
    m = distances(c, c)
    np.fill_diagonal(m, np.inf)
    db = float(((s[:, None] + s[None]) / m).max(1).mean()) if len(ks) > 1 else 0.0
    n = np.array([(label == k).sum() for k in ks])
    between, within = (n * ((c - x.mean(0)) ** 2).sum(1)).sum(), sum(((x[label == k] - c[i]) ** 2).sum() for i, k in enumerate(ks))
    ch = float(between / max(len(ks) - 1, 1) / max(within / max(len(x) - len(ks), 1), 1e-12))
    return float(np.mean(sil)), db, ch


def k_curve(x: np.ndarray, most: int) -> list[tuple[int, float, float, float]]:
    return [(k, *quality_of(x, ward(x, k))) for k in range(2, most + 1)]


def choose_k(curve: list[tuple[int, float, float, float]], strategy: str = "global", manual: int | None = None) -> int:
    """Global silhouette maximum, first local maximum beyond 2, or the evaluated k nearest to a manual one."""
    if strategy == "manual" and manual:
        return min((abs(k - manual), k) for k, *_ in curve)[1]
    if strategy == "local":
        for a, b, c in zip(curve, curve[1:], curve[2:]):
            if b[0] > 2 and b[1] >= a[1] and b[1] >= c[1]:
                return b[0]
    return max(curve, key=lambda r: r[1])[0]
