"""Networks of bibliographic units as (nodes, edges) DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.session import durable


def pairs_of(items: Column) -> Column:
    """All pairs ``(a, b)``, a < b, of the distinct elements of an array."""
    s = F.sort_array(F.array_distinct(items))
    return F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def cooccurrence(records: DataFrame, field: str, fractional: bool = False) -> DataFrame:
    """``a, b, weight``: pairs within a record; a record of n items gives 1 per pair, or 1/(n-1) if fractional."""
    n = F.size(F.array_distinct(field))
    w = F.lit(1.0) / (n - 1) if fractional else F.lit(1.0)
    rows = records.where(n > 1).select(w.alias("w"), F.explode(pairs_of(F.col(field))).alias("p"))
    return rows.groupBy("p.a", "p.b").agg(F.round(F.sum("w"), 6).alias("weight"))


def node_counts(records: DataFrame, field: str) -> DataFrame:
    """``node, count``: records that have the element (repeats within a record count once)."""
    return records.select(F.explode(F.array_distinct(field)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("count"))


def top_subgraph(edges: DataFrame, nodes: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """Edges of at least a weight between the ``n`` most frequent nodes (ties by name)."""
    keep = nodes.orderBy(F.desc("count"), "node").limit(n).select("node")
    a, b = F.broadcast(keep.withColumnRenamed("node", "a")), F.broadcast(keep.withColumnRenamed("node", "b"))
    return edges.where(F.col("weight") >= least).join(a, "a", "left_semi").join(b, "b", "left_semi")


def bipartite(records: DataFrame, left: str, right: str, fractional: bool = False) -> DataFrame:
    """``a, b, weight``: elements of two fields in one record; 1 per pair, or 1/(n1*n2) if fractional."""
    n1, n2 = F.size(F.array_distinct(left)), F.size(F.array_distinct(right))
    w = F.lit(1.0) / (n1 * n2) if fractional else F.lit(1.0)
    rows = records.where((n1 > 0) & (n2 > 0)).select(w.alias("w"), F.explode(F.array_distinct(left)).alias("a"), F.col(right).alias("r")).select("w", "a", F.explode(F.array_distinct("r")).alias("b"))
    return rows.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def coupling(citing: DataFrame, fractional: bool = False) -> DataFrame:
    """Bibliographic coupling of units: ``a, b, weight`` from ``unit, ref, share``.

    Every shared reference adds 1, or the product of both units' shares. Units of a reference are
    counted before they meet, so a reference cited by very many works meets as few units.
    """
    per = citing.groupBy("unit", "ref").agg(F.sum("share").alias("s"))
    x, y = per.select("ref", F.col("unit").alias("a"), F.col("s").alias("sa")), per.select("ref", F.col("unit").alias("b"), F.col("s").alias("sb"))
    w = F.col("sa").cast("decimal(18,12)") * F.col("sb").cast("decimal(18,12)") if fractional else F.lit(1)
    return x.join(y, "ref").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(w).cast("double").alias("weight"))


def citation_edges(works: DataFrame) -> DataFrame:
    """``src, dst, year_diff``: citations between works of the corpus, without self-citations."""
    e = works.select(F.col("id").alias("src"), F.col("publication_year").alias("y"), F.explode("references").alias("dst"))
    t = works.select(F.col("id").alias("dst"), F.col("publication_year").alias("ty"))
    return e.join(t, "dst").where(F.col("src") != F.col("dst")).select("src", "dst", (F.col("y") - F.col("ty")).alias("year_diff"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree, strength`` of an undirected graph without loops."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("strength"))


def filter_edges(edges: DataFrame, low: float | None = None, high: float | None = None, loops: bool = False) -> DataFrame:
    """Edges with a weight in [low, high]; self-loops drop unless ``loops``."""
    out = edges if loops else edges.where(F.col("a") != F.col("b"))
    out = out if low is None else out.where(F.col("weight") >= low)
    return out if high is None else out.where(F.col("weight") <= high)


def triangles(edges: DataFrame) -> DataFrame:
    """One row with the number of triangles; edges point from the rarer to the more connected end, which bounds the wedges of hubs."""
    d = degrees(edges).select("node", "degree")
    e = edges.select("a", "b").join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"))
    wedges = o.select("lo", F.col("hi").alias("x")).join(o.select("lo", F.col("hi").alias("y")), "lo").where(F.col("x") < F.col("y"))
    closed = o.select(F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    return wedges.join(closed, ["x", "y"], "left_semi").agg(F.count(F.lit(1)).alias("triangles"))


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, isolates, density and transitivity of an undirected graph."""
    d = degrees(edges)
    wedges = d.agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"), F.count(F.lit(1)).alias("n")).select("w", "n")
    one = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(wedges).crossJoin(triangles(edges))
    n = F.col("n_nodes").cast("double")
    return one.select("n_nodes", "n_edges", (F.col("n_nodes") - F.col("n")).alias("n_isolates"), F.round(2 * F.col("n_edges") / (n * (n - 1)), 8).alias("density"), F.round(F.try_divide(3.0 * F.col("triangles"), F.col("w")), 8).alias("transitivity"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: the least node name reachable.

    Labels spread along edges and jump (pointer doubling) until none moves, however deep the graph
    is; each round is checkpointed.
    """
    labels = durable(nodes.select("node", F.col("node").alias("component")), eager=True)
    both = durable(both_ways(edges).select("node", "other"), eager=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other").hint("shuffle_hash"), "other").groupBy("node").agg(F.min("component").alias("m"))
        step = labels.join(near.hint("shuffle_hash"), "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = durable(step.join(jump.hint("shuffle_hash"), "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old"), eager=True)
        labels = new.select("node", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels


LEAST_GAIN = 1e-12  # modularity that a move must add, over the noise of floating sums
ONE_TASK = 500_000  # edges of a graph that one task moves as a whole; larger ones are moved by joins


def _moves(a: np.ndarray, b: np.ndarray, weight: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """Communities of the nodes 0 to n - 1 of a graph after local moves, and moves of whole communities, until none is left."""
    n = int(max(a.max(), b.max())) + 1
    member = np.arange(n)
    while True:
        apart = a != b
        src, dst = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]])
        both = np.concatenate([weight[apart], weight[apart]])
        k = np.bincount(a, weight, n) + np.bincount(b, weight, n)
        nodes = np.arange(n)
        c, idle, r = nodes.copy(), 0, 0

        def quality(c: np.ndarray, a=a, b=b, weight=weight, k=k) -> float:
            return weight[c[a] == c[b]].sum() / total - resolution * (np.bincount(c, k) ** 2).sum() / (4 * total * total)

        now = quality(c)
        while idle < 2:
            tot = np.bincount(c, k, n)
            pair, at = np.unique(np.concatenate([src * n + c[dst], nodes * n + c]), return_inverse=True)
            node, to = pair // n, pair % n
            inside = np.bincount(at, np.concatenate([both, np.zeros(n)]))
            gain = np.round(inside - resolution * k[node] * (tot[to] - np.where(to == c[node], k[node], 0.0)) / (2 * total), 9)
            stay = gain[to == c[node]]  # one row per node, in their order
            order = np.lexsort((to, gain, node))
            last = order[np.append(node[order][1:] != node[order][:-1], True)]
            more, new = gain[last] - stay, to[last]
            go = nodes[(more > LEAST_GAIN * total) & ((new < c) if r % 2 == 0 else (new > c))]
            idle, r = (0 if len(go) else idle + 1), r + 1
            if not len(go):
                continue
            moved = c.copy()
            moved[go] = new[go]
            if quality(moved) <= now + LEAST_GAIN:  # these moves thwart each other: each community takes part in its best one only
                ranked = go[np.lexsort((go, more[go]))]
                top = np.full(n, -1)
                for x in (c, new):
                    np.maximum.at(top, x[ranked], np.arange(len(ranked)))
                rank = np.arange(len(ranked))
                go = ranked[(top[c[ranked]] == rank) & (top[new[ranked]] == rank)]
                moved = c.copy()
                moved[go] = new[go]
            c, now = moved, quality(moved)
        member = c[member]
        if (c == nodes).all():
            return member
        pair, at = np.unique(np.minimum(c[a], c[b]) * n + np.maximum(c[a], c[b]), return_inverse=True)
        a, b, weight = pair // n, pair % n, np.bincount(at, weight)


def _communities_of_one_task(graph: DataFrame, total: float, resolution: float) -> DataFrame:
    """``node, c`` of a graph that fits in one task."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted({*pdf.a, *pdf.b}), dtype=object)
        at = {x: i for i, x in enumerate(names)}
        member = _moves(pdf.a.map(at).to_numpy(np.int64), pdf.b.map(at).to_numpy(np.int64), pdf.weight.to_numpy(float), total, resolution)
        return pd.DataFrame({"node": names, "c": names[member]})

    kind = graph.schema["a"].dataType.simpleString()
    return graph.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(move, f"node {kind}, c {kind}")


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, one_task: int = ONE_TASK) -> DataFrame:
    """``node, community``: modularity by synchronous local moves (the Louvain objective), then moves of whole communities.

    Nodes move to the neighbouring community of greatest gain; in alternate rounds only to lower or
    only to higher labels, which keeps two nodes from swapping for ever. Where all moves of a round
    together add nothing, only moves are made that no other one touches: their gains add up. So every
    round raises the modularity and this ends without a limit of rounds. Graphs of more than
    ``one_task`` edges move by joins and partial aggregations over edges; what is left of them after
    communities became nodes, and smaller ones, by the same moves in one task.
    """
    graph = durable(edges.select("a", "b", "weight"), eager=True)
    total = graph.agg(F.sum("weight")).collect()[0][0] or 0.0
    member = durable(nodes.select("node", F.col("node").alias("community")), eager=True)
    if not total:
        return member
    while True:
        if graph.count() <= one_task:
            state = durable(_communities_of_one_task(graph, total, resolution), eager=True)
            return member.join(state.select(F.col("node").alias("community"), "c"), "community", "left").select("node", F.coalesce("c", "community").alias("community"))
        both = durable(both_ways(graph.where(F.col("a") != F.col("b"))).unionByName(graph.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("b").alias("other"), (F.col("weight") * 2).alias("weight"))), eager=True)
        strength = both.groupBy("node").agg(F.sum("weight").alias("k"))
        state = durable(strength.select("node", "k", F.col("node").alias("c")), eager=True)

        def quality(state: DataFrame, both: DataFrame = both) -> float:
            c = state.select("node", "c")
            inside = both.join(c, "node").join(c.withColumnsRenamed({"node": "other", "c": "to"}), "other").where(F.col("c") == F.col("to")).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("i"))
            squares = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
            i, tt = inside.crossJoin(squares).collect()[0]
            return i / (2 * total) - resolution * tt / (4 * total * total)

        now, idle, r = quality(state), 0, 0
        while idle < 2:
            size = state.groupBy("c").agg(F.sum("k").alias("tot"))
            links = both.where(F.col("node") != F.col("other")).join(state.select(F.col("node").alias("other"), F.col("c").alias("to")), "other").select("node", "to", "weight")
            links = links.unionByName(state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("weight"))).groupBy("node", "to").agg(F.sum("weight").alias("inside"))
            options = links.join(state, "node").join(size.withColumnRenamed("c", "to"), "to")
            own = F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("inside") - F.lit(resolution) * F.col("k") * (F.col("tot") - own) / (2 * total), 9)
            best = options.withColumn("gain", gain).groupBy("node", "k", "c").agg(F.max(F.struct("gain", F.col("to"))).alias("b"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"))
            best = best.select("node", "k", "c", F.col("b.to").alias("new"), (F.col("b.gain") - F.col("stay")).alias("more"))
            go = (F.col("more") > LEAST_GAIN * total) & ((F.col("new") < F.col("c")) if r % 2 == 0 else (F.col("new") > F.col("c")))
            moved = durable(best.select("node", "k", F.when(go, F.col("new")).otherwise(F.col("c")).alias("c"), F.col("c").alias("old"), "more"), eager=True)
            going = moved.where(F.col("c") != F.col("old"))
            idle, r = (idle + 1 if going.isEmpty() else 0), r + 1
            if idle:
                continue
            if quality(moved) <= now + LEAST_GAIN:  # these moves thwart each other: each community takes part in its best one only
                ranked = going.select("node", F.struct("more", "node").alias("rank"), F.explode(F.array("old", "c")).alias("touched"))
                top = ranked.groupBy("touched").agg(F.max("rank").alias("top"))
                alone = ranked.join(top, "touched").where(F.col("rank") == F.col("top")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select("node", F.lit(True).alias("alone"))
                moved = durable(moved.join(alone, "node", "left").select("node", "k", F.when(F.col("alone"), F.col("c")).otherwise(F.col("old")).alias("c")), eager=True)
            state = moved.select("node", "k", "c")
            now = quality(state)
        member = durable(member.join(state.select(F.col("node").alias("community"), "c"), "community", "left").select("node", F.coalesce("c", "community").alias("community")), eager=True)
        names = state.select("node", "c")
        if state.where(F.col("node") != F.col("c")).isEmpty():
            return member
        graph = durable(graph.join(names.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(names.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")), eager=True)


def modularity(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of an assignment ``node, community``."""
    e = edges.join(member.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("i"))
    tot = both_ways(edges).join(member, "node").groupBy("community").agg(F.sum("weight").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    return inside.crossJoin(tot).select(F.round(F.col("i") / F.col("m") - resolution * F.col("tt") / (4 * F.col("m") * F.col("m")), 6).alias("q"))


def merge_small(edges: DataFrame, member: DataFrame, least: int) -> DataFrame:
    """Communities of fewer than ``least`` nodes join the one they have most weight to, else the largest; renumbered by size."""
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    big = size.where(F.col("n") >= least)
    largest = size.agg(F.max(F.struct("n", "community")).alias("x")).select("x.community").scalar()
    small = member.join(big.select("community"), "community", "left_anti")
    links = both_ways(edges).join(member.select(F.col("node").alias("other"), F.col("community").alias("to")), "other").join(big.select(F.col("community").alias("to")), "to", "left_semi")
    modal = small.join(links, "node").groupBy("community", "to").agg(F.sum("weight").alias("w")).groupBy("community").agg(F.max_by("to", F.struct("w", "to")).alias("to"))
    moved = member.join(modal, "community", "left").join(big.select("community", F.lit(True).alias("keep")), "community", "left")
    out = moved.select("node", F.when(F.col("keep"), F.col("community")).otherwise(F.coalesce("to", largest)).alias("community"))
    rank = out.groupBy("community").agg(F.count(F.lit(1)).alias("n")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "community")))
    return out.join(rank.select("community", "cluster"), "community").select("node", "cluster")


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Adjusted mutual information of two labellings ``key, label`` on their common keys.

    The contingency table is aggregated in Spark; its cells (labels x labels, not keys) come to the
    driver for the expectation under random labels, which sums over the counts within forty standard
    deviations of their mean (the others weigh nothing in double precision).
    """
    import math

    both = left.select(key, F.col("label").alias("x")).join(right.select(key, F.col("label").alias("y")), key).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = [(r["x"], r["y"], r["n"]) for r in both.collect()]
    n = sum(c for _, _, c in cells)
    a: dict = {}
    b: dict = {}
    for x, y, c in cells:
        a[x], b[y] = a.get(x, 0) + c, b.get(y, 0) + c
    spark = left.sparkSession
    if not n:
        return spark.createDataFrame([(0, None)], "n_common long, ami double")
    mi = sum(c / n * math.log(n * c / (a[x] * b[y])) for x, y, c in cells)
    h = lambda m: -sum(v / n * math.log(v / n) for v in m.values())

    def log_gamma(x: np.ndarray) -> np.ndarray:
        """Stirling's series, after eight steps up from small arguments."""
        shift = sum(np.log(x + i) for i in range(8))
        z = x + 8.0
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift

    expected = 0.0
    count = lambda m: {v: sum(1 for w in m.values() if w == v) for v in set(m.values())}
    for p, n_p in count(a).items():
        for q, n_q in count(b).items():
            mean, spread = p * q / n, 40 * math.sqrt(max(p * q / n * (1 - p / n) * (1 - q / n), 1.0)) + 40
            k = np.arange(max(1, p + q - n, math.floor(mean - spread)), min(p, q, math.ceil(mean + spread)) + 1, dtype=float)
            fixed = sum(math.lgamma(v + 1) for v in (p, q, n - p, n - q)) - math.lgamma(n + 1)
            term = fixed - log_gamma(k + 1) - log_gamma(p - k + 1) - log_gamma(q - k + 1) - log_gamma(n - p - q + k + 1)
            expected += n_p * n_q * float((k / n * np.log(n * k / (p * q)) * np.exp(term)).sum())
    top = (h(a) + h(b)) / 2 - expected
    return spark.createDataFrame([(n, (mi - expected) / top if abs(top) > 1e-12 else 1.0)], "n_common long, ami double")


def layout(edges: DataFrame, nodes: DataFrame, seed: int = 42, scale: float = 500.0, iterations: int = 50, most: int = 500) -> DataFrame:
    """``node, x, y, shown, total`` of a display graph by force-directed placement.

    A picture holds few nodes: it takes the ``most`` most frequent ones by definition, and every row
    says how many of the ``total`` nodes are shown.
    """
    kept = nodes.orderBy(F.desc("count"), "node").limit(most).select("node")
    sub = top_subgraph(edges, nodes, most)
    rows = kept.select(F.lit("n").alias("kind"), "node", F.lit("").alias("b"), F.lit(0.0).alias("weight")).unionByName(sub.select(F.lit("e").alias("kind"), F.col("a").alias("node"), "b", "weight")).withColumn("g", F.lit(1))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf[pdf.kind == "n"].node)
        at = {v: i for i, v in enumerate(names)}
        e = pdf[pdf.kind == "e"]
        i, j, w = e.node.map(at).to_numpy(), e.b.map(at).to_numpy(), e.weight.to_numpy()
        pos = np.random.default_rng(seed).random((len(names), 2))
        k, t = 1 / max(np.sqrt(len(names)), 1), 0.1
        for _ in range(iterations):
            d = pos[:, None] - pos[None]
            dist = np.maximum(np.sqrt((d**2).sum(-1)), 0.01)
            force = (d * (k * k / dist**2)[..., None]).sum(1)
            if len(e):
                pull = (pos[i] - pos[j]) * (w * np.sqrt(((pos[i] - pos[j]) ** 2).sum(1)) / k)[:, None]
                np.add.at(force, i, -pull)
                np.add.at(force, j, pull)
            length = np.maximum(np.sqrt((force**2).sum(1)), 0.01)
            pos += force / length[:, None] * np.minimum(length, t)[:, None]
            t -= 0.1 / (iterations + 1)
        pos = (pos - pos.mean(0)) / max(np.abs(pos - pos.mean(0)).max(), 1e-9) * scale
        return pd.DataFrame({"node": names, "x": pos[:, 0], "y": pos[:, 1]})

    placed = rows.groupBy("g").applyInPandas(place, "node string, x double, y double")
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    return placed.crossJoin(total).withColumn("shown", F.least(F.lit(most).cast("long"), "total"))


def export_json(edges: DataFrame, nodes: DataFrame, member: DataFrame, n: int = 1000, scores: DataFrame | None = None) -> DataFrame:
    """One row with the network JSON of the ``n`` most frequent nodes, and how many of all they are.

    Items have ids by sorted label, cluster (``member``: ``node, cluster``), coordinates, weights
    (documents, links, total link strength) and scores (``scores``: ``node`` and one column per score).
    """
    kept = nodes.orderBy(F.desc("count"), "node").limit(n)
    strength = degrees(top_subgraph(edges, nodes, n))
    placed = layout(edges, nodes, most=n).select("node", "x", "y")
    items = kept.join(member.select("node", "cluster"), "node", "left").join(placed, "node", "left").join(strength.select("node", "degree", "strength"), "node", "left").withColumn("id", F.row_number().over(Window.orderBy("node")))
    named = [c for c in scores.columns if c != "node"] if scores is not None else []
    items = items.join(scores, "node", "left") if named else items
    a, b = (items.select(F.col("node").alias(c), F.col("id").alias(i)) for c, i in (("a", "source_id"), ("b", "target_id")))
    links = edges.join(F.broadcast(a), "a").join(F.broadcast(b), "b")
    weights = F.struct(F.col("count").alias("Documents"), F.coalesce("degree", F.lit(0)).alias("Links"), F.coalesce("strength", F.lit(0.0)).alias("Total link strength"))
    item = F.struct("id", F.col("node").alias("label"), "x", "y", "cluster", weights.alias("weights"), *([F.struct(*named).alias("scores")] if named else []))
    left = items.agg(F.sort_array(F.collect_list(item)).alias("items"))
    right = links.agg(F.sort_array(F.collect_list(F.struct("source_id", "target_id", F.col("weight").alias("strength")))).alias("links"))
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    return left.crossJoin(right).crossJoin(total).select(F.to_json(F.struct(F.struct("items", "links").alias("network"), F.struct(F.lit("1").alias("version")).alias("config"))).alias("json"), F.least(F.lit(n).cast("long"), "total").alias("shown"), "total")
