"""Registered queries of vectors, maps, clusters and dimension (K04, K05, X14, X15, J16, M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as tx
from tesela.functions.ids import work_key
from tesela.operators import dimension as dm
from tesela.operators import som
from tesela.operators import vectors as vc
from tesela.operators.current import current_rows
from tesela.session import durable, table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql


def points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def query_points(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return points(s, d).where(F.col("vec_id") % 100 == 0)


_PAIRS = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0)"


def _knn(s: SparkSession, d: str, metric: str = "cosine", k: int = 10) -> DataFrame:
    return vc.nearest(points(s, d), query_points(s, d), k, metric=metric)


_add("K04_knn_cosine", lambda s, d: _knn(s, d).select("query", "neighbour", "rank"), _PAIRS + " SELECT q.vec_id AS query, e.vec_id AS neighbour, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.v, e.v), e.vec_id) AS INTEGER) AS rank FROM q, e WHERE q.vec_id <> e.vec_id QUALIFY rank <= 10")
_add("K04_knn_euclidean", lambda s, d: _knn(s, d, "euclidean").select("query", "neighbour", "rank"), _PAIRS + " SELECT q.vec_id AS query, e.vec_id AS neighbour, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) AS INTEGER) AS rank FROM q, e WHERE q.vec_id <> e.vec_id QUALIFY rank <= 10")
_add("K05_knn_aggregate", lambda s, d: _knn(s, d, k=50).join(points(s, d).select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n")), _PAIRS + ", k AS (SELECT q.vec_id AS query, e.vec_id AS neighbour FROM q, e WHERE q.vec_id <> e.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.v, e.v), e.vec_id) <= 50) SELECT query, label, count(*) AS n FROM k JOIN embeddings m ON m.vec_id = k.neighbour GROUP BY 1, 2")
_add("X14_cosine_distance", lambda s, d: (lambda p: p.select("vec_id", F.round(vc.cosine_distance(F.col("embedding"), F.transform("embedding", lambda x: F.lit(1.0))), 6).alias("distance")))(points(s, d)), "SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), [1.0::DOUBLE for x in embedding]), 6) AS distance FROM embeddings")


def _centroid(s: SparkSession, d: str) -> DataFrame:
    """Similarity of points to their cluster's centroid, ten best per cluster."""
    rows = vc.long_rows(points(s, d), "vec_id", "embedding").join(points(s, d).select(F.col("vec_id").alias("id"), "label"), "id")
    c = rows.groupBy("label", "dim").agg(F.avg("v").alias("c"))
    sims = rows.join(c, ["label", "dim"]).groupBy("label", "id").agg((F.sum(F.col("v") * F.col("c")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("c") * F.col("c"))) + 1e-9)).alias("s"))
    return sims.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "id"))).where(F.col("r") <= 10).select("label", "id", F.round("s", 5).alias("similarity"))


_add("X15_centroid_similarity", _centroid)
_add("M01_unit_matrix", lambda s, d: vc.long_rows(points(s, d), "vec_id", "embedding"), "SELECT vec_id AS id, CAST(i AS INTEGER) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
_L = "WITH r AS (SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT dim, min(v) AS lo, max(v) AS hi, max(abs(v)) AS top, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS q1, median(v) AS q2, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY 1) "
for _m, _f in (("divmax", "v / top"), ("minmax", "(v - lo) / (hi - lo)"), ("zscore", "(v - mean) / std"), ("robust", "(v - q2) / (q3 - q1)")):
    _add(f"M02_{_m}", lambda s, d, _m=_m: vc.normalise(vc.long_rows(points(s, d), "vec_id", "embedding"), _m).select("id", "dim", F.round("v", 7).alias("v")), _L + f"SELECT id, r.dim, round({_f}, 7) AS v FROM r JOIN s USING (dim)")


def _svd(s: SparkSession, d: str) -> DataFrame:
    n, _, values, _ = vc.spectrum(points(s, d), "embedding")
    ratio = float(np.sqrt(values[0] / max(values[1], 1e-12)))
    rows = [(rule, ratio, *som.grid_size(n, ratio, rule), som.epochs(n, 100, rule == "big")) for rule in ("big", "small")]
    return s.createDataFrame(rows, "rule string, ratio double, grid_rows int, grid_cols int, epochs int")


_add("M03_svd_audit", _svd)
_add("M04_epochs", lambda s, d: s.createDataFrame([(n, m, som.epochs(n, m, False)) for n, m in ((100, 25), (1000, 400), (10, 900))], "n int, m int, epochs int"), "SELECT n, m, CAST(least(greatest(500 * m // n, 20), 2000) AS INTEGER) AS epochs FROM (VALUES (100, 25), (1000, 400), (10, 900)) t(n, m)")
_add("M05_hex_grid", lambda s, d: s.createDataFrame([(i, float(round(x, 9)), float(round(y, 9))) for i, (x, y) in enumerate(som.grid(6, 8))], "idx int, x double, y double"), "SELECT CAST(i AS INTEGER) AS idx, (i % 8) * 1.5::DOUBLE AS x, round((i // 8 + 0.5 * ((i % 8) % 2)) * sqrt(3), 9) AS y FROM (SELECT unnest(range(48)) AS i)")
_add("M07_metrics", lambda s, d: vc.long_rows(points(s, d), "vec_id", "embedding").groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("euclidean"), F.round(F.sum(F.abs("v")), 6).alias("manhattan"), F.round(F.sum(F.abs(F.col("v") - 1) / (F.abs("v") + 1 + 1e-15)), 6).alias("canberra")), "WITH r AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT id, round(sqrt(sum(v * v)), 6) AS euclidean, round(sum(abs(v)), 6) AS manhattan, round(sum(abs(v - 1) / (abs(v) + 1 + 1e-15)), 6) AS canberra FROM r GROUP BY 1")

ROWS, COLS = 6, 6


def _trained(s: SparkSession, d: str, n: int = 5) -> np.ndarray:
    return som.train_batch(points(s, d), "embedding", ROWS, COLS, n)


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return som.assign(points(s, d), "vec_id", "embedding", _trained(s, d), ROWS, COLS)


def _neuron_rows(s: SparkSession, w: np.ndarray) -> DataFrame:
    return som.neurons(s, w, ROWS, COLS).select("idx", "row", "col", "u")


_add("M06_initial_weights", lambda s, d: _neuron_rows(s, som.initial_weights(points(s, d), "embedding", ROWS, COLS)))
_add("M08_online_som", lambda s, d: _neuron_rows(s, som.train_online(points(s, d), "embedding", ROWS, COLS)))
_add("M09_batch_som", lambda s, d: _neuron_rows(s, _trained(s, d)))


def _longitudinal(s: SparkSession, d: str) -> DataFrame:
    """A map warm-started from an earlier period and the drift of its neurons."""
    p = points(s, d)
    first = som.train_batch(p.where(F.col("vec_id") % 2 == 0), "embedding", ROWS, COLS, 5)
    second = som.train_batch(p.where(F.col("vec_id") % 2 == 1), "embedding", ROWS, COLS, 3, sigma_start=(ROWS + COLS) / 16, weights=first)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(som.drift(first, second))], "idx int, drift double")


_add("M10_longitudinal_som", _longitudinal)
_add("M11_weight_drift", _longitudinal)
_add("M12_umatrix", lambda s, d: _neuron_rows(s, _trained(s, d)).select("idx", "u"))
_add("M13_neurons", lambda s, d: (lambda w: som.neurons(s, w, ROWS, COLS, som.assign(points(s, d), "vec_id", "embedding", w, ROWS, COLS)).select("idx", "frequency", "qe"))(_trained(s, d)))
_add("M14_map_quality", lambda s, d: _assigned(s, d).agg(F.avg("qe").alias("qe"), F.avg(F.col("violation").cast("int")).alias("topographic_error")))
_add("J16_nearest_neuron", lambda s, d: _assigned(s, d).select("id", "bmu"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    w = _trained(s, d)
    z = (w - w.mean(0)) / np.maximum(w.std(0), 1e-12)
    labels = {"ward": som.ward(w, 4), "kmeans": som.kmeans(w, 4), "dbscan": som.dbscan(z, 0.9 * float(np.sqrt(z.shape[1])), 3)}
    return s.createDataFrame([(a, i, int(v)) for a, x in labels.items() for i, v in enumerate(x)], "algorithm string, idx int, cluster int")


_add("M15_neuron_clusters", _clusters)


def _curve(s: SparkSession, d: str) -> DataFrame:
    c = som.k_curve(_trained(s, d), 8)
    chosen = {k: som.choose_k(c, k, 5) for k in ("global", "local", "manual")}
    return s.createDataFrame([(*map(float, r), *[bool(r[0] == chosen[k]) for k in ("global", "local", "manual")]) for r in c], "k double, silhouette double, davies_bouldin double, calinski_harabasz double, chosen_global boolean, chosen_local boolean, chosen_manual boolean")


_add("M16_k_curve", _curve)
_add("M17_k_choice", lambda s, d: _curve(s, d).where("chosen_global").select("k"))


def _projection(s: SparkSession, d: str) -> DataFrame:
    """Two main components of every vector (the fallback level that needs no extra library)."""
    _, mean, _, axes = vc.spectrum(points(s, d), "embedding")
    xs = [F.array(*[F.lit(float(v)) for v in axes[:, i]]) for i in (0, 1)]
    centred = F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    return points(s, d).select("vec_id", vc.dot(centred, xs[0]).alias("x"), vc.dot(centred, xs[1]).alias("y"))


_add("M18_projection", _projection)
_local = lambda s, d, k=15: dm.local_estimates(points(s, d), query_points(s, d), k)
for _name, _column in (("M19_mle", "mle"), ("M22_mom", "mom"), ("M23_mada", "mada"), ("M27_ess", "ess"), ("M29_tle", "tle")):
    _add(_name, lambda s, d, _column=_column: dm.summary(_local(s, d), _column))
_add("M20_two_nn", lambda s, d: dm.two_nn(_local(s, d)))
_add("M21_correlation", lambda s, d: dm.correlation_dimension(_knn(s, d, "euclidean", 15)))
_add("M24_graph_length", lambda s, d: dm.graph_length(points(s, d), query_points(s, d)))
_add("M25_mind_ml", lambda s, d: dm.mind_ml(_local(s, d), 15))
_add("M26_danco", lambda s, d: dm.danco(_local(s, d), 15))
_add("M28_fisher", lambda s, d: dm.fisher_separability(points(s, d), query_points(s, d)))
_add("M30_lpca", lambda s, d: _local(s, d).agg(*[F.avg(f"lpca_{r}").alias(r) for r in ("fo", "fan", "maxgap", "ratio", "participation", "kaiser", "broken_stick")]))
_add("M31_smoothed", lambda s, d: dm.smoothed_estimates(points(s, d), query_points(s, d), "mle"))
_add("M32_manifolds", lambda s, d: dm.manifold(s, "sphere", 500, 5).select("vec_id", F.round(F.sqrt(vc.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm")), "SELECT unnest(range(500)) AS vec_id, 1.0::DOUBLE AS norm")


def _hierarchy(s: SparkSession, d: str) -> DataFrame:
    """Clusters of the vectors, clusters inside each of them, and the medoid (the member nearest to the centre) of every inner one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    top_k, sub_k = 4, 3
    p = points(s, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("features", array_to_vector("x"))
    top = durable(KMeans(k=top_k, seed=42, predictionCol="cluster").fit(p).transform(p).select("vec_id", "x", "cluster"), eager=True)
    out = None
    for c in range(top_k):
        inner = top.where(F.col("cluster") == c).withColumn("features", array_to_vector("x"))
        if inner.isEmpty():
            continue
        model = KMeans(k=sub_k, seed=42, predictionCol="sub").fit(inner)
        centre = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.clusterCenters()])
        far = F.aggregate(F.zip_with("x", F.get(centre, F.col("sub")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda z, v: z + v)
        part = model.transform(inner).withColumn("far", far).groupBy("cluster", "sub").agg(F.count(F.lit(1)).alias("n"), F.min_by("vec_id", F.struct("far", "vec_id")).alias("medoid"))
        out = part if out is None else out.unionByName(part)
    return out


_add("M33_hierarchical_clusters", _hierarchy)


def _semantic_records(s: SparkSession, d: str) -> DataFrame:
    """Source, section, the whole text and the keywords of the work (of its current row)."""
    clean = F.filter(F.transform("keywords", tx.clean_text), lambda x: x != "")
    keywords = current_rows(table(s, d, "works").select("work_id", "ingested_at", "keywords"), "work_id", "ingested_at", ["keywords"]).select(F.col("work_id").alias("w"), F.nullif(F.array_join(F.array_distinct(clean), ", "), F.lit("")).alias("k"))
    docs = table(s, d, "documents").select("doc_id", "source", "section", "text", work_key(F.col("work_id")).alias("w"))
    return docs.join(keywords, "w", "left").select("doc_id", F.concat_ws(" | ", "source", "section", "text", F.concat(F.lit("Keywords: "), "k")).alias("record"))


_add("M34_semantic_records", _semantic_records, "SELECT doc_id, concat_ws(' | ', source, section, string_split(text, chr(10))[1]) AS record FROM documents")

QUERIES = Q
