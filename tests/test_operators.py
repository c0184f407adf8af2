"""Graphs, maps, dimension, growth, parsers and SQL guards on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of

from tesela.functions import tags
from tesela.operators import dimension as dm
from tesela.operators import indices as ix
from tesela.operators import networks as nw
from tesela.operators import som
from tesela.operators import textmining as tm
from tesela.operators import vectors as vc
from tesela.operators.growth import growth_models
from tesela.plans import predicates
from tesela.plans import vectors as plans
from tesela.sources import bibliographic as bib
from tesela.sources import packages, sinks, sql


def test_components_and_communities(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    assert {r.component for r in nw.components(edges, nodes).collect()} == {"a", "g"}
    member = nw.communities(edges, nodes)
    groups = {}
    for r in member.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {frozenset("abc"), frozenset("def"), frozenset("g")}
    assert nw.modularity(edges, member).collect()[0].q > 0.4
    assert nw.triangles(edges).collect()[0][0] == 2


def test_communities_end_and_only_gain(spark):
    """Simultaneous moves that thwart each other neither go round for ever nor lower the modularity; joins and one task agree."""
    rng = np.random.default_rng(5)
    group = rng.integers(0, 6, 60)
    rows = [(f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 9))) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.35 if group[i] == group[j] else 0.12)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    a, b, w = (np.array(x) for x in zip(*[(int(p[1:]), int(q[1:]), v) for p, q, v in rows]))
    assert len(nw._moves(a, b, w, w.sum(), 1.0)) == 60
    path = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("b", "c", 0.5)], "a string, b string, weight double")
    four = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert rows_of(nw.communities(path, four)) == rows_of(nw.communities(path, four, one_task=0))
    ring = [(f"r{i:03d}", f"r{(i + 1) % 200:03d}", 1.0) for i in range(200)]
    r = spark.createDataFrame(ring, "a string, b string, weight double")
    for e, least in ((edges, 0.15), (r, 0.8)):
        assert nw.modularity(e, nw.communities(e, nw.degrees(e).select("node"))).collect()[0].q > least


def test_agreement(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "k int, label int")
    assert nw.agreement(a, a, "k").collect()[0].ami == pytest.approx(1)
    b = spark.createDataFrame([(i, (i // 3) % 2) for i in range(30)], "k int, label int")
    assert abs(nw.agreement(a, b, "k").collect()[0].ami) < 0.2


def test_citation_indices(spark):
    works = spark.createDataFrame([(str(i), ["x", "x"], c, 2020) for i, c in enumerate([10, 8, 5, 4, 3])], "id string, author_names array<string>, cited_by_count int, publication_year int")
    r = ix.author_metrics(works, 2026).collect()[0]
    assert (r.h_index, r.g_index, round(r.e_index, 4)) == (4, 5, 3.3166)
    assert ix.gini(spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int"), "x").collect()[0].gini == pytest.approx(0.25)
    s = spark.createDataFrame([("a", t, v) for t, v in enumerate([1, 2, 4, 8])], "k string, t int, v int")
    assert [r.smoothed for r in ix.smooth(s, "k", "t", "v", 3).orderBy("t").collect()] == [1.0, 1.5, 2.75, 5.375]


def test_nearest_is_exact(spark):
    x = np.random.default_rng(0).normal(size=(300, 6))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query"], r["rank"]): r.neighbour for r in vc.nearest(p, p.where("vec_id % 100 = 0"), 5).collect()}
    for q in (0, 100, 200):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [got[q, k] for k in range(1, 6)] == list(np.argsort(d)[:5])


def test_dimension_of_a_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(1500, 2)) @ rng.normal(size=(2, 8))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    local = dm.local_estimates(p, p.where("vec_id % 10 = 0"), 20)
    r = local.agg(F.avg("mle").alias("mle"), F.avg("tle").alias("tle"), F.avg("lpca_ratio").alias("pca")).collect()[0]
    assert 1.6 < r.mle < 2.6 and 1.5 < r.tle < 2.6 and 1.5 < r.pca < 2.5
    assert 1.5 < dm.two_nn(local).collect()[0].dimension < 2.6


def test_inseparable_pairs_are_all_counted(spark):
    """Against all pairs of the whitened points; a dense vector has more than 50 inseparable partners."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal((4, 4, 4), 0.1, (150, 3))])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    _, mean, values, axes = vc.spectrum(p, "embedding")
    keep = values > values[0] / 10
    z = (x - mean) @ (axes[:, keep] / np.sqrt(values[keep]))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    s = z @ z.T
    np.fill_diagonal(s, -1)
    got = {r.alpha: r for r in dm.fisher_separability(p, p.where("vec_id % 10 = 0")).collect()}
    assert len(got) == 6 and all(r.inseparable == pytest.approx((s[::10] >= a).sum() / (35 * 350)) and r.dimension is not None for a, r in got.items())


def test_smoothing_takes_all_neighbours(spark):
    x = np.random.default_rng(5).normal(size=(200, 4))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :15]
    r = np.take_along_axis(d, order, 1)
    mle = 14 / np.log(r[:, -1:] / r[:, :-1]).sum(1)
    got = {r["query"]: r.smoothed for r in dm.smoothed_estimates(p, p.where("vec_id % 50 = 0"), "mle").collect()}
    assert got == {q: pytest.approx(np.mean([mle[q], *mle[order[q]]])) for q in (0, 50, 100, 150)}


def test_map_learns(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in (0.0, 3.0)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    w = som.train_batch(p, "embedding", 3, 4, 8)
    assert som.assign(p, "vec_id", "embedding", w, 3, 4).agg(F.avg("qe")).collect()[0][0] < 0.6
    assert len(set(som.ward(w, 2))) == 2 and som.choose_k(som.k_curve(x[::6], 4)) == 2


def test_growth_recovers_a_logistic(spark):
    t = np.arange(20)
    y = 100 / (1 + np.exp(-0.6 * (t - 9)))
    s = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(t, y)] + [("b", 1, 1.0)], "k string, t int, v double")
    r = {x.k: x for x in growth_models(s, "k", "t", "v").collect()}
    assert r["a"].model == "logistic" and r["a"].capacity == pytest.approx(100, rel=0.02) and r["b"].rate is None


def test_guards_and_paths(spark):
    with pytest.raises(ValueError):
        sql.guarded(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        sql.guarded(spark, "SELECT 1; SELECT 2")
    with pytest.raises(ValueError):
        sql.forbid_joins("SELECT * FROM a JOIN b")
    sql.forbid_joins("SELECT 'join' FROM a ARRAY JOIN x")
    assert sql.guarded(spark, "SELECT id FROM range(100)", limit=5).count() == 5
    assert sql.resolve_table(["x_works", "old_x_works", "y"], "works") == "x_works"
    assert sql.resolve_path(["a/t.parquet", "north/t.parquet", "north/dept/t.parquet"], "t.parquet", "north") == "north/t.parquet"


def test_readers(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("FN X\nVR 1.0\nPT J\nAU Perez, A\n   Gil, B\nTI A long\n   title\nSO J\nPY 2020\nC1 Inst, City, Mexico\nCR Roe J, 2001, SCIENCE\nUT W1\nER\n\nEF\n")
    r = bib.read_any(spark, str(f)).collect()[0]
    assert (r.title, r.authors, r.year, r.countries) == ("A long title", ["Perez, A", "Gil, B"], 2020, ["Mexico"])
    g = tmp_path / "p.txt"
    g.write_text("____________________________________________________________\nTitle: T\nAuthor: A; B\nPublication year: 1999\n")
    assert bib.read_proquest(spark, str(g)).collect()[0].authors == ["A", "B"]
    j = tmp_path / "w.json"
    j.write_text('{"results": [{"id": "https://x/W5", "title": "t", "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "concepts": [{"display_name": "c", "score": 0.1}, {"display_name": "d", "score": 0.9}]}]}')
    r = bib.read_any(spark, str(j)).collect()[0]
    assert (r.id, r.abstract, r.keywords) == ("W5", "a b a", ["d"])
    d = tmp_path / "d.csv"
    d.write_text('"About the data: x"\nPublication ID,Title,PubYear,Authors\np1,"A, b",2003,"X; Y"\n')
    r = bib.read_any(spark, str(d)).collect()[0]
    assert (r.id, r.title, r.year, r.authors) == ("p1", "A, b", 2003, ["X", "Y"])


def test_packages_and_stores(spark):
    inv = packages.inventory(["Authors/authors 2010-2014.csv", "Authors/authors 2015-2019.csv", "Countries/country.parquet", "Countries/country.csv"])
    assert inv["authors"]["5Years"].endswith("2015-2019.csv") and inv["countries"]["Whole"].endswith("csv")
    a = spark.createDataFrame([("k", 1, "old"), ("m", 1, "m")], "id string, at int, v string")
    b = spark.createDataFrame([("k", 1, "new")], "id string, at int, v string")
    assert rows_of(sinks.upsert(a, b, "id", "at")) == [("k", 1, "new"), ("m", 1, "m")]


def test_copyright_notices(spark, tmp_path):
    """X38 reads the texts themselves."""
    texts = {1: ("Soil use.\nThe lake. © 2020 Publisher", "Soil use.\nThe lake.", "© 2020 Publisher"), 2: ("Soil use. (c) 2019 A. Roe. All rights reserved.", "Soil use.", "(c) 2019 A. Roe. All rights reserved."), 3: ("Soil use Copyright 2021 X", "Soil use", "Copyright 2021 X"), 4: ("Soil use.\nCopyright Elsevier", "Soil use.", "Copyright Elsevier"), 5: ("mig©a|i\\n e© © fácil y copyright law", "mig©a|i\\n e© © fácil y copyright law", None), 6: ("© 2020 X.\nSoil use.", "© 2020 X.\nSoil use.", None), 7: ("Soil use. ©2020 X", "Soil use.", "©2020 X"), 8: (None, None, None), 9: ("", "", None)}
    spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.notice) for r in predicates.QUERIES["X38_copyright_split"](spark, str(tmp_path)).collect()}
    assert got == {k: (a, b) for k, (_, a, b) in texts.items()}


def test_semantic_records_are_whole(spark, tmp_path):
    docs = [(1, "https://x/w5", "first\nsecond", "J", "S"), (2, None, "alone", "J", None), (3, "W6", None, "J", "S"), (4, "W7", "text", None, None)]
    spark.createDataFrame(docs, "doc_id long, work_id string, text string, source string, section string").write.parquet(f"{tmp_path}/documents.parquet")
    works = [("W5", 1, ["old"]), ("W5", 2, ["soil  use", None, " ", "lake", "lake"]), ("W5", 2, ["soil  use", None, " ", "lake", "lake"]), ("W6", 1, ["a"]), ("W7", 1, None)]
    spark.createDataFrame(works, "work_id string, ingested_at int, keywords array<string>").write.parquet(f"{tmp_path}/works.parquet")
    assert rows_of(plans.QUERIES["M34_semantic_records"](spark, str(tmp_path))) == [(1, "J | S | first\nsecond | Keywords: soil use, lake"), (2, "J | alone"), (3, "J | S | Keywords: a"), (4, "text")]


def test_words_and_citations(spark):
    df = spark.createDataFrame([("network analyses", "Methods: soil use of the lake. © 2020 X")], "a string, b string")
    r = df.select(tm.singular(F.col("a")), tm.clean_abstract(F.col("b")), tm.noun_phrases(F.lit("Soil quality of the northern lake"))).collect()[0]
    assert r[0] == "network analysis" and r[1] == "soil use of the lake." and r[2] == ["soil quality", "northern lake"]
    c = spark.createDataFrame([("Roe J, 2001, SCIENCE, V12, P34, DOI 10.1000/x",)], "c string").select(tags.parse_citation(F.col("c")).alias("p")).collect()[0].p
    assert (c.author, c.year, c.journal, c.volume, c.page, c.doi, c.bad) == ("Roe J", 2001, "SCIENCE", "12", "34", "10.1000/x", False)
