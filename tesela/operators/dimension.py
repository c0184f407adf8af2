"""Intrinsic dimension of vectors: estimates in the neighbourhoods of query points, and global ones from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.operators.vectors import POINT_CHUNK, QUERY_BLOCK, nearest
from tesela.session import durable


def eigen_rules(values: np.ndarray) -> dict[str, float]:
    """Dimension by rules on descending eigenvalues."""
    v = np.maximum(values, 1e-15)
    share, n = v / v.sum(), len(v)
    gaps = v[:-1] / v[1:]
    sticks = np.cumsum(1 / np.arange(n, 0, -1))[::-1] / n
    return {
        "lpca_fo": float((v > 0.05 * v[0]).sum()), "lpca_fan": float(min((v >= v[0] / 10).sum(), np.searchsorted(np.cumsum(share), 0.8) + 1)), "lpca_maxgap": float(gaps.argmax() + 1) if n > 1 else 1.0,
        "lpca_ratio": float(np.searchsorted(np.cumsum(share), 0.95) + 1), "lpca_participation": float(v.sum() ** 2 / (v**2).sum()), "lpca_kaiser": float((v > v.mean()).sum()), "lpca_broken_stick": float((share > sticks).sum()),
    }


def tle(near: np.ndarray, eps: float = 1e-4) -> float:
    """Tight local estimate from all pairs of neighbours; near holds neighbour vectors minus the query."""
    r = np.linalg.norm(near, axis=1)
    big, k = r.max(), len(r)
    if big <= 0:
        return 0.0
    terms = []
    d2 = ((near[:, None] - near[None]) ** 2).sum(-1)
    r2 = r**2
    for v2 in (d2, 2 * r2[:, None] + 2 * r2[None] - d2):
        a = r2[:, None] + v2 - r2[None]
        room = big**2 - r2[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(room > 1e-12, big * (np.sqrt(np.maximum(a**2 + 4 * v2 * room, 0)) - a) / (2 * room), big * v2 / np.where(np.abs(a) > 1e-12, a, np.nan))
        ok = ~np.eye(k, dtype=bool) & np.isfinite(s) & (s > eps * big)
        terms.append(np.log(np.minimum(s[ok] / big, 1.0)))
    own = np.log(np.maximum(r / big, eps))
    total, n = sum(t.sum() for t in terms) + own.sum(), sum(map(len, terms)) + k
    return float(-n / total) if total < 0 else 0.0


def simplex_skewness(near: np.ndarray) -> float:
    """Mean sine of angles between neighbour pairs weighted by their lengths."""
    n = np.linalg.norm(near, axis=1)
    g = near @ near.T
    w = n[:, None] * n[None]
    area = np.sqrt(np.maximum(w**2 - g**2, 0))
    up = np.triu_indices(len(n), 1)
    return float(area[up].sum() / max(w[up].sum(), 1e-12))


def _skewness_of_ball(d: int) -> float:
    """Expected sine between random directions in d dimensions."""
    return math.exp(2 * math.lgamma(d / 2) - math.lgamma((d + 1) / 2) - math.lgamma((d - 1) / 2)) if d > 1 else 0.0


def dimension_of_skewness(s: float, most: int = 100) -> float:
    table = [_skewness_of_ball(d) for d in range(1, most + 1)]
    return float(np.interp(s, table, range(1, most + 1)))


def local_estimates(points: DataFrame, queries: DataFrame, k: int = 15, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per query with the estimates from its k nearest neighbours.

    Neighbourhoods hold k rows each; they are gathered by query with the neighbours' vectors.
    """
    found = nearest(points, queries, k, key, vector)
    with_vectors = found.join(points.select(F.col(key).alias("neighbour"), F.col(vector).alias("nv")), "neighbour").join(queries.select(F.col(key).alias("query"), F.col(vector).alias("qv")), "query")
    packed = with_vectors.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "nv"))).alias("n"), F.first("qv").alias("qv"))
    names = ["mle", "mom", "mada", "mind_mli", "tle", "ess", "r1", "r2", "lpca_fo", "lpca_fan", "lpca_maxgap", "lpca_ratio", "lpca_participation", "lpca_kaiser", "lpca_broken_stick"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, n, qv in zip(pdf["query"], pdf["n"], pdf["qv"]):
                r = np.array([x["distance"] for x in n])
                near = np.array([x["nv"] for x in n], float) - np.asarray(qv, float)
                r = np.maximum(r, 1e-12)
                mle = (len(r) - 1) / max(np.log(r[-1] / r[:-1]).sum(), 1e-12)
                m1 = r.mean()
                half = r[len(r) // 2 - 1]
                est = {"mle": mle, "mom": -m1 / (m1 - r[-1]) if m1 < r[-1] else 0.0, "mada": math.log(2) / math.log(r[-1] / half) if r[-1] > half else 0.0, "mind_mli": -math.log(max(r[0] / r[-1], 1e-12)), "tle": tle(near), "ess": dimension_of_skewness(simplex_skewness(near - near.mean(0))), "r1": r[0], "r2": r[1] if len(r) > 1 else r[0]}
                c = near - near.mean(0)
                est |= eigen_rules(np.linalg.svd(c, compute_uv=False) ** 2)
                out.append({"query": q, **est})
            yield pd.DataFrame(out, columns=["query", *names])

    return packed.mapInPandas(run, "query long, " + ", ".join(f"{x} double" for x in names))


def summary(local: DataFrame, column: str) -> DataFrame:
    """Median, 90th and 95th percentile, maximum and mean of a local estimate, and the dimension (ceiling of the 95th)."""
    return local.agg(*[F.expr(f"percentile({column}, {p})").alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"))], F.max(column).alias("max"), F.avg(column).alias("mean")).withColumn("dimension", F.ceil("p95"))


def two_nn(local: DataFrame, discard: float = 0.1) -> DataFrame:
    """Slope through the origin of -ln(1 - F(mu)) on ln(mu), mu = r2 / r1, without the largest tenth.

    The empirical distribution is taken by rank over the queries.
    """
    mu = local.where(F.col("r1") > 0).select((F.col("r2") / F.col("r1")).alias("mu")).withColumn("i", F.row_number().over(Window.orderBy("mu"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = mu.where(F.col("i") <= F.floor(F.col("n") * (1 - discard)))
    x, y = F.ln("mu"), -F.ln(1 - F.col("i") / F.col("n"))
    return kept.agg((F.sum(x * y) / F.sum(x * x)).alias("dimension"))


def correlation_dimension(found: DataFrame, k1: int = 5, k2: int = 15) -> DataFrame:
    """Log ratio of pair counts within the median k1-th and k2-th neighbour distances over the log ratio of these radii."""
    r1 = found.where(F.col("rank") == k1).agg(F.expr("percentile(distance, 0.5)")).scalar()
    r2 = found.where(F.col("rank") == k2).agg(F.expr("percentile(distance, 0.5)")).scalar()
    return found.select("distance", r1.alias("a"), r2.alias("b")).agg((F.ln(F.count_if(F.col("distance") <= F.col("b")) / F.count_if(F.col("distance") <= F.col("a"))) / F.ln(F.max("b") / F.max("a"))).alias("dimension"))


def mind_ml(local: DataFrame, k: int, most: int = 64) -> DataFrame:
    """Maximum likelihood of the dimension from the ratios of first to k-th neighbour distances, over integer candidates."""
    rows = local.select(F.exp(-F.col("mind_mli")).alias("rho")).where((F.col("rho") > 0) & (F.col("rho") < 1))
    cand = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d")
    ll = rows.select("rho", cand).groupBy("d").agg(F.sum(F.ln(F.lit(float(k)) * F.col("d")) + (F.col("d") - 1) * F.ln("rho") + (k - 1) * F.ln(1 - F.pow("rho", F.col("d").cast("double")))).alias("ll"))
    return ll.agg(F.max_by("d", "ll").alias("dimension"))


def graph_length(points: DataFrame, queries: DataFrame, k: int = 2, sizes: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), gamma: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Dimension whose power law fits the length of the neighbour graph over samples of the points best.

    Neighbours are found again inside every sample. The length of a sample is estimated from its
    queries (a stated set); for a dimension m it should grow with the power (m - gamma) / m of the
    sample's size. One row per integer dimension with the residual, the best one marked.
    """
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1000)) / 1000.0
    rows = []
    for s in sizes:
        sample = points.where(h < s)
        asked = queries.where(h < s)
        n, q = sample.count(), asked.count()
        total = nearest(sample, asked, k, key, vector).agg(F.sum(F.pow("distance", F.lit(gamma)))).collect()[0][0]
        if n and q and total:
            rows.append((n, total * n / q))
    spark = points.sparkSession
    width = points.select(F.size(vector).alias("d")).limit(1).collect()
    out = []
    if len(rows) > 1:
        p, length = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
        for m in range(1, width[0]["d"] + 1):
            powers = p ** ((m - gamma) / m)
            c = (powers @ length) / (powers @ powers)
            out.append((m, float(((length - c * powers) ** 2).sum())))
    best = min(out, key=lambda r: r[1])[0] if out else None
    return spark.createDataFrame([(m, e, m == best) for m, e in out], "dimension int, residual double, best boolean")


def danco(local: DataFrame, k: int, most: int = 32) -> DataFrame:
    """Dimension whose expected neighbour-distance and angle statistics are closest to the observed ones.

    Distances enter by the maximum-likelihood dimension, angles by the mean simplex skewness.
    """
    stats = local.agg(F.avg("mle").alias("d"), F.avg("ess").alias("a"))
    cand = stats.select("d", "a", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("c"))
    gap = F.pow(F.ln(F.col("d") / F.col("c")), 2.0) + F.pow(F.ln(F.col("a") / F.col("c")), 2.0)
    return cand.agg(F.min_by("c", gap).alias("dimension"))


def inseparable_pairs(points: DataFrame, queries: DataFrame, alphas: tuple[float, ...]) -> dict[float, int]:
    """Per margin the number of (query, other point) pairs whose product reaches it. points, queries: ``id, v`` of unit length.

    All pairs are compared: queries in blocks against points in chunks, as in ``nearest``, a slice of
    queries at a time; one row of counts per task leaves it.
    """
    blocks, chunks = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(points.count() / POINT_CHUNK))
    h = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    q = queries.select(F.col("id").alias("q"), F.col("v").alias("x"), h(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    p = points.select(F.col("id").alias("p"), F.col("v").alias("y"), h(chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(alphas), int)
        if len(a) and len(b):
            x, y, other = np.stack(a.x.to_numpy()), np.stack(b.y.to_numpy()).T, b.p.to_numpy()
            for at in range(0, len(x), 128):
                s = x[at : at + 128] @ y
                s[a.q.to_numpy()[at : at + 128, None] == other] = -np.inf
                n += [int((s >= m).sum()) for m in alphas]
        return pd.DataFrame({"alpha": alphas, "n": n})

    found = q.groupBy("block", "chunk").cogroup(p.groupBy("block", "chunk")).applyInPandas(count, "alpha double, n long")
    return dict.fromkeys(alphas, 0) | {r["alpha"]: r["n"] for r in found.groupBy("alpha").agg(F.sum("n").alias("n")).collect()}


def fisher_separability(points: DataFrame, queries: DataFrame, vector: str = "embedding", alphas: tuple[float, ...] = (0.6, 0.7, 0.8, 0.88, 0.92, 0.96)) -> DataFrame:
    """Share of the pairs of a query and a point that are inseparable, per margin, and the dimension of equal share on a sphere.

    Points are whitened to the unit sphere; the query matrix (a stated set) goes in blocks of the
    session's broadcast.
    """
    from tesela.operators.vectors import spectrum

    n_points, mean, values, axes = spectrum(points, vector)
    keep = values > values[0] / 10
    w = axes[:, keep] / np.sqrt(values[keep])
    spark = points.sparkSession

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = (np.stack(pdf[vector].to_numpy()).astype(float) - mean) @ w
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": pdf.vec_id, "v": list(x)})

    p = points.select("vec_id", vector).mapInPandas(project, "id long, v array<double>")
    q = p.join(queries.select(F.col("vec_id").alias("id")), "id", "left_semi")
    n_pairs = n_points * q.count()
    counts = inseparable_pairs(p, q, alphas)
    rows = []
    for a in alphas:
        share = counts[a] / max(n_pairs, 1)
        d = None
        if 0 < share < 1:
            b = -math.log(1 - a * a)
            z = b / (2 * math.pi * share**2 * a * a * (1 - a * a))
            x = math.log(z) if z > math.e else 1.0
            for _ in range(30):
                x = x - (x * math.exp(x) - z) / (math.exp(x) * (x + 1)) if x < 50 else x
            d = x / b
        rows.append((float(a), share, d))
    return spark.createDataFrame(rows, "alpha double, inseparable double, dimension double")


def smooth_local(local: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Per query of ``found`` the mean of its local estimate and those of all its neighbours; local has all of them."""
    other = local.select(F.col("query").alias("neighbour"), F.col(column).alias("v"))
    own = found.select("query", F.col("query").alias("neighbour")).distinct()
    return found.select("query", "neighbour").unionByName(own).join(other, "neighbour").groupBy("query").agg(F.avg("v").alias("smoothed"))


def smoothed_estimates(points: DataFrame, queries: DataFrame, column: str, k: int = 15, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, smoothed``: estimates are taken at the queries and at all their neighbours, then averaged."""
    found = durable(nearest(points, queries, k, key, vector), eager=True)
    ids = found.select(F.col("query").alias(key)).union(found.select("neighbour")).distinct()
    local = local_estimates(points, durable(points.join(ids, key, "left_semi"), eager=True), k, key, vector)
    return smooth_local(local, found, column)


def manifold(spark, kind: str, n: int, d: int, seed: int = 42) -> DataFrame:
    """Synthetic points ``vec_id, embedding``: ball, sphere or swiss_roll."""
    g = [F.randn(seed + i) for i in range(d)]
    base = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*g).alias("g"), F.rand(seed + 100).alias("u"), F.rand(seed + 101).alias("h"))
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x))
    if kind == "swiss_roll":
        t = 1.5 * math.pi * (1 + 2 * F.col("u"))
        return base.select("vec_id", F.array(t * F.cos(t), 21 * F.col("h"), t * F.sin(t)).alias("embedding"))
    r = F.pow(F.col("u"), F.lit(1.0 / d)) if kind == "ball" else F.lit(1.0)
    return base.withColumn("s", r / norm).select("vec_id", F.transform("g", lambda x: x * F.col("s")).alias("embedding"))
