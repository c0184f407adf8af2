"""Registered queries of networks (G, K09, K10, J09 to J12, U08) and text mining (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.operators import networks as nw
from tesela.operators import textmining as tm
from tesela.plans.corpus import corpus, mean_of, sql_mean, with_corpus
from tesela.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, raw: bool = False) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql if raw else with_corpus(sql)


def _pairs_sql(field: str, weight: str = "1.0") -> str:
    return f", i AS (SELECT id, n, unnest(l) AS x FROM (SELECT id, list_distinct({field}) AS l, len(list_distinct({field})) AS n FROM corpus)), edges AS (SELECT p.x AS a, q.x AS b, round(sum({weight}), 6) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2), nodes AS (SELECT x AS node, count(*) AS count FROM i GROUP BY 1)"


def _country(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(s, d)
    return nw.cooccurrence(c, "countries"), nw.node_counts(c, "countries")


def _terms(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(s, d)
    return nw.cooccurrence(c, "concepts"), nw.node_counts(c, "concepts")


_C, _T = _pairs_sql("countries"), _pairs_sql("concepts")
_add("G01_cooccurrence_full", lambda s, d: nw.cooccurrence(corpus(s, d), "author_keywords"), _pairs_sql("author_keywords") + " SELECT * FROM edges")
_add("G01_coauthorship_fractional", lambda s, d: nw.cooccurrence(corpus(s, d), "author_names", True), _pairs_sql("author_names", "1.0 / (p.n - 1)").replace("round(sum(1.0 / (p.n - 1)), 6)", "round(sum(CAST(1 AS DOUBLE) / (p.n - 1)), 6)") + " SELECT * FROM edges")
_add("G01_nodes", lambda s, d: _terms(s, d)[1], _T + " SELECT node, count FROM nodes")
_add("G02_bipartite", lambda s, d: nw.bipartite(corpus(s, d), "countries", "concepts"), ", x AS (SELECT id, unnest(countries) AS a FROM corpus), y AS (SELECT id, unnest(list_distinct(concepts)) AS b FROM corpus) SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM x JOIN y USING (id) GROUP BY 1, 2")
_add("G02_bipartite_fractional", lambda s, d: nw.bipartite(corpus(s, d), "countries", "concepts", True), ", x AS (SELECT id, unnest(countries) AS a, len(countries) AS n1 FROM corpus), y AS (SELECT id, unnest(list_distinct(concepts)) AS b, len(list_distinct(concepts)) AS n2 FROM corpus) SELECT a, b, round(sum(CAST(1 AS DOUBLE) / (n1 * n2)), 6) AS weight FROM x JOIN y USING (id) GROUP BY 1, 2")
_add("J11_record_cross", Q["G02_bipartite"], ", x AS (SELECT id, unnest(countries) AS a FROM corpus), y AS (SELECT id, unnest(list_distinct(concepts)) AS b FROM corpus) SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM x JOIN y USING (id) GROUP BY 1, 2")


def _citing(s: SparkSession, d: str, unit: str) -> DataFrame:
    c = corpus(s, d)
    units = F.explode(F.array_distinct(unit)) if dict(c.dtypes)[unit].startswith("array") else F.col(unit)
    rows = c.where(F.size("references") > 0).select(units.alias("unit"), "references", (1.0 / F.size("references")).cast("decimal(18,12)").alias("share"))
    return rows.where(F.col("unit").isNotNull()).select("unit", F.explode("references").alias("ref"), "share")


for _unit in ("id", "journal_name", "countries"):
    _u = "unnest(countries)" if _unit == "countries" else _unit
    _base = f", u AS (SELECT {_u} AS unit, refs, CAST(1 AS DOUBLE) / len(refs) AS share FROM corpus WHERE len(refs) > 0), r AS (SELECT unit, ref, sum(CAST(share AS DECIMAL(18,12))) AS s FROM (SELECT unit, share, unnest(refs) AS ref FROM u WHERE unit IS NOT NULL) GROUP BY 1, 2)"
    _add(f"G03_coupling_{_unit}", lambda s, d, _unit=_unit: nw.coupling(_citing(s, d, _unit)), _base + " SELECT x.unit AS a, y.unit AS b, CAST(count(*) AS DOUBLE) AS weight FROM r x JOIN r y ON x.ref = y.ref AND x.unit < y.unit GROUP BY 1, 2")
_add("G03_coupling_fractional", lambda s, d: nw.coupling(_citing(s, d, "journal_name"), True), _base.replace("unnest(countries) AS unit", "journal_name AS unit") + " SELECT x.unit AS a, y.unit AS b, CAST(sum(CAST(x.s AS DECIMAL(18,12)) * CAST(y.s AS DECIMAL(18,12))) AS DOUBLE) AS weight FROM r x JOIN r y ON x.ref = y.ref AND x.unit < y.unit GROUP BY 1, 2")
_add("J09_shared_reference_join", Q["G03_coupling_journal_name"], SQL["G03_coupling_journal_name"], raw=True)
_E = ", e AS (SELECT c.id AS src, t.id AS dst, c.publication_year - t.publication_year AS year_diff FROM (SELECT id, publication_year, unnest(refs) AS ref FROM corpus) c JOIN corpus t ON t.id = c.ref WHERE c.id <> t.id)"
_add("G04_citation_undirected", lambda s, d: nw.citation_edges(corpus(s, d)).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight")), _E + " SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM e GROUP BY 1, 2")
_add("J10_coupling_by_citation_digraph", lambda s, d: nw.coupling(nw.citation_edges(corpus(s, d)).select(F.col("src").alias("unit"), F.col("dst").alias("ref"), F.lit(1.0).alias("share"))), _E + " SELECT x.src AS a, y.src AS b, CAST(count(*) AS DOUBLE) AS weight FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2")


def _cited_journals(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    e = c.select("id", F.explode("references").alias("ref")).join(c.select(F.col("id").alias("ref"), "journal_name"), "ref").where(F.col("journal_name").isNotNull())
    return e.groupBy("id").agg(F.collect_set("journal_name").alias("cited"))


_add("G05_cocitation_sources", lambda s, d: nw.cooccurrence(_cited_journals(s, d), "cited"), ", k AS (SELECT DISTINCT c.id, t.journal_name AS x FROM (SELECT id, unnest(refs) AS ref FROM corpus) c JOIN corpus t ON t.id = c.ref WHERE t.journal_name IS NOT NULL) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM k p JOIN k q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2")
_add("G05_cocitation_references", lambda s, d: nw.cooccurrence(corpus(s, d), "references").where(F.col("weight") >= 2), _pairs_sql("refs") + " SELECT * FROM edges WHERE weight >= 2")
_add("G11_cocitation_years", lambda s, d: nw.cooccurrence(corpus(s, d).select("id", F.explode("references").alias("ref")).join(corpus(s, d).select(F.col("id").alias("ref"), "publication_year"), "ref").groupBy("id").agg(F.collect_set("publication_year").alias("years")), "years"), ", k AS (SELECT DISTINCT c.id, t.publication_year AS x FROM (SELECT id, unnest(refs) AS ref FROM corpus) c JOIN corpus t ON t.id = c.ref WHERE t.publication_year IS NOT NULL) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM k p JOIN k q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2")

FAMILIES = {
    "co_authorship": lambda c: nw.cooccurrence(c, "author_names"),
    "co_occurrence": lambda c: nw.cooccurrence(c, "keywords"),
    "co_citation": lambda c: nw.cooccurrence(c, "references"),
    "country": lambda c: nw.cooccurrence(c, "countries"),
    "institution": lambda c: nw.cooccurrence(c, "affiliations"),
    "bipartite": lambda c: nw.bipartite(c, "author_names", "keywords"),
}


def network(works: DataFrame, family: str, n: int, least: float) -> DataFrame:
    """The network of a family, cut to the strongest ``n`` nodes and a least weight."""
    edges = FAMILIES[family](works).where(F.col("weight") >= least)
    nodes = nw.degrees(edges).select("node", F.col("strength").alias("count"))
    return nw.top_subgraph(edges, nodes, n, least)


_add("G06_network_dispatch", lambda s, d: network(corpus(s, d), "institution", 40, 2.0), _pairs_sql("affiliations") + ", f AS (SELECT * FROM edges WHERE weight >= 2), k AS (SELECT node FROM (SELECT a AS node, weight FROM f UNION ALL SELECT b, weight FROM f) GROUP BY 1 ORDER BY round(sum(weight), 6) DESC, node LIMIT 40) SELECT * FROM f WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")


def _adjacency(s: SparkSession, d: str) -> DataFrame:
    """Adjacency rows (both directions) of the country network."""
    return nw.both_ways(_country(s, d)[0])


_add("G06_adjacency", _adjacency, _C + " SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges")
_add("G06_temporal_networks", lambda s, d: (lambda c: c.where(F.size("countries") > 1).select((F.floor(F.col("publication_year") / 3) * 3).cast("int").alias("window"), F.explode(nw.pairs_of(F.col("countries"))).alias("p")).groupBy("window", "p.a", "p.b").agg(F.count(F.lit(1)).alias("weight")))(corpus(s, d)), ", i AS (SELECT id, CAST(publication_year // 3 * 3 AS INTEGER) AS \"window\", unnest(countries) AS x FROM corpus) SELECT p.\"window\", p.x AS a, q.x AS b, count(*) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2, 3")
_add("G07_record_pipeline", lambda s, d: nw.top_subgraph(*_terms(s, d), 30, 2.0), _T + ", k AS (SELECT node FROM nodes ORDER BY count DESC, node LIMIT 30) SELECT * FROM edges WHERE weight >= 2 AND a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
_add("G08_corpus_coauthors", lambda s, d: (lambda c: nw.top_subgraph(nw.cooccurrence(c, "author_names"), nw.node_counts(c, "author_names"), 200, 1.0))(corpus(s, d)), _pairs_sql("author_names") + ", k AS (SELECT node FROM nodes ORDER BY count DESC, node LIMIT 200) SELECT * FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
_add("G09_first_authors", lambda s, d: (lambda c: nw.top_subgraph(nw.cooccurrence(c, "author_names"), nw.node_counts(c, "author_names"), 45))(corpus(s, d).withColumn("author_names", F.slice("author_names", 1, 8))), ", i AS (SELECT id, unnest(list_distinct(author_names[1:8])) AS x FROM corpus), edges AS (SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2), k AS (SELECT x AS node FROM i GROUP BY 1 ORDER BY count(*) DESC, x LIMIT 45) SELECT * FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
_add("G10_coauthors_short", lambda s, d: nw.cooccurrence(corpus(s, d).withColumn("short", F.transform("author_names", lambda a: F.lower(F.substring_index(a, ",", 1)))), "short"), ", i AS (SELECT DISTINCT id, lower(split_part(unnest(author_names), ',', 1)) AS x FROM corpus) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2")
_add("G12_citation_directed", lambda s, d: nw.citation_edges(corpus(s, d)), _E + " SELECT * FROM e")
_add("G13_one_mode_ordered", lambda s, d: corpus(s, d).select("id", F.posexplode("author_keywords").alias("i", "x")).alias("p").join(corpus(s, d).select("id", F.posexplode("author_keywords").alias("j", "y")), "id").where(F.col("i") < F.col("j")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight")), ", k AS (SELECT id, unnest(author_keywords) AS x, generate_subscripts(author_keywords, 1) AS i FROM corpus) SELECT p.x, q.x AS y, count(*) AS weight FROM k p JOIN k q ON p.id = q.id AND p.i < q.i GROUP BY 1, 2")
_add("G14_two_mode", lambda s, d: corpus(s, d).where(F.col("journal_name").isNotNull()).select(F.col("journal_name").alias("src"), F.explode(F.array_distinct("concepts")).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")), "SELECT src, dst, count(*) AS weight FROM (SELECT journal_name AS src, unnest(list_distinct(concepts)) AS dst FROM corpus WHERE journal_name IS NOT NULL) GROUP BY 1, 2")


def _multi(s: SparkSession, d: str) -> DataFrame:
    """One graph of the elements of three fields, tagged by field."""
    def tagged(name):
        return F.transform(name, lambda x: F.concat(F.lit(name + ":"), x))

    return nw.cooccurrence(corpus(s, d).withColumn("all", F.concat(tagged("countries"), tagged("concepts"), tagged("topics"))), "all")


_add("G15_multi_mode", _multi, ", i AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(list_concat(['countries:' || c for c in countries], ['concepts:' || c for c in concepts], ['topics:' || c for c in topics])) AS x FROM corpus)) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2")


def _co_institution(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "authorships").where(F.col("institution_id").isNotNull() & (F.trim("institution_id") != "") & F.col("work_id").isNotNull()).groupBy("work_id").agg(F.collect_set("institution_id").alias("i"))
    return nw.cooccurrence(rows, "i")


_add("G16_co_institution", _co_institution, "WITH k AS (SELECT DISTINCT work_id, institution_id AS x FROM authorships WHERE institution_id IS NOT NULL AND trim(institution_id) <> '' AND work_id IS NOT NULL) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM k p JOIN k q ON p.work_id = q.work_id AND p.x < q.x GROUP BY 1, 2", raw=True)


def _diffusion(s: SparkSession, d: str) -> DataFrame:
    """From the journals of cited works to those of citing works."""
    c = corpus(s, d)
    e = c.select(F.col("journal_name").alias("target"), F.explode("references").alias("ref")).join(c.select(F.col("id").alias("ref"), F.col("journal_name").alias("source")), "ref")
    return e.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


_DIF = "SELECT t.journal_name AS source, c.journal_name AS target, count(*) AS weight FROM (SELECT journal_name, unnest(refs) AS ref FROM corpus) c JOIN corpus t ON t.id = c.ref WHERE t.journal_name IS NOT NULL AND c.journal_name IS NOT NULL GROUP BY 1, 2"
_add("G17_diffusion", _diffusion, _DIF)
_add("J12_diffusion_join", _diffusion, _DIF)
_add("G18_diffusion_counts", lambda s, d: _diffusion(s, d).groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("diffusion")), f", x AS ({_DIF}) SELECT source AS node, CAST(sum(weight) AS BIGINT) AS diffusion FROM x GROUP BY 1")
_add("G19_expand_records", lambda s, d: corpus(s, d).select("id", F.posexplode("author_names").alias("p", "author")).select(F.concat_ws("#", "id", F.col("p").cast("string")).alias("node"), "author"), "SELECT id || '#' || CAST(generate_subscripts(author_names, 1) - 1 AS VARCHAR) AS node, unnest(author_names) AS author FROM corpus")
_DEG = ", w AS (SELECT a AS node, weight FROM edges UNION ALL SELECT b, weight FROM edges), dg AS (SELECT node, count(*) AS degree, round(sum(weight), 6) AS strength FROM w GROUP BY 1)"
_add("G20_degrees", lambda s, d: nw.degrees(_country(s, d)[0]), _C + _DEG + " SELECT * FROM dg")
_add("G21_degree_distribution", lambda s, d: nw.degrees(_terms(s, d)[0]).groupBy("degree").agg(F.count(F.lit(1)).alias("n")), _T + _DEG + " SELECT degree, count(*) AS n FROM dg GROUP BY 1")
_add("G22_statistics", lambda s, d: nw.statistics(*_terms(s, d)), _T + _DEG + ", t AS (SELECT count(*) AS tri FROM edges p JOIN edges q ON p.b = q.a JOIN edges r ON r.a = p.a AND r.b = q.b) SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM dg) AS n_isolates, round(2 * (SELECT count(*) FROM edges) / (CAST((SELECT count(*) FROM nodes) AS DOUBLE) * ((SELECT count(*) FROM nodes) - 1)), 8) AS density, round(3.0 * tri / (SELECT sum(degree * (degree - 1) / 2) FROM dg), 8) AS transitivity FROM t")
_add("G23_node_scores", lambda s, d: corpus(s, d).select(F.explode(F.array_distinct("concepts")).alias("node"), "publication_year", "cited_by_count").groupBy("node").agg(mean_of("publication_year").alias("mean_year"), mean_of("cited_by_count").alias("mean_cites")), f"SELECT node, {sql_mean('publication_year')} AS mean_year, {sql_mean('cited_by_count')} AS mean_cites FROM (SELECT *, unnest(list_distinct(concepts)) AS node FROM corpus) GROUP BY 1")
_add("G24_communities", lambda s, d: nw.communities(*_country(s, d)))
_add("G24_modularity", lambda s, d: (lambda e, n: nw.modularity(e, nw.communities(e, n)))(*_country(s, d)))
_add("G25_merge_small", lambda s, d: (lambda e, n: nw.merge_small(e, nw.communities(e, n), 3))(*_country(s, d)))
_add("G26_components", lambda s, d: (lambda e, n: nw.components(nw.filter_edges(e, 2.0), n))(*_terms(s, d)), with_corpus(_T + ", u AS (SELECT a, b FROM edges WHERE weight >= 2 UNION SELECT b, a FROM edges WHERE weight >= 2), r(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1), raw=True)
_add("G27_layout", lambda s, d: nw.layout(*_terms(s, d)))


def _ami(s: SparkSession, d: str) -> DataFrame:
    """Stability of the countries' communities between the works of two spans of years."""
    c = corpus(s, d).where(F.col("publication_year").isNotNull())

    def labels(part: DataFrame) -> DataFrame:
        return nw.communities(nw.cooccurrence(part, "countries"), nw.node_counts(part, "countries").select("node")).withColumnRenamed("community", "label")

    return nw.agreement(labels(c.where(F.col("publication_year") < 2018)), labels(c.where(F.col("publication_year") >= 2018)), "node")


_add("G28_agreement", _ami)
_add("G29_front_ranking", lambda s, d: corpus(s, d).select(F.explode(F.array_distinct("topics")).alias("front"), "fwci").groupBy("front").agg(F.count(F.lit(1)).alias("n"), mean_of("fwci").alias("fwci")).orderBy(F.desc("n"), "front").limit(10), f"SELECT front, count(*) AS n, {sql_mean('fwci')} AS fwci FROM (SELECT fwci, unnest(list_distinct(topics)) AS front FROM corpus) GROUP BY 1 ORDER BY n DESC, front LIMIT 10")
_add("G30_json_export", lambda s, d: (lambda e, n: nw.export_json(e, n, nw.merge_small(e, nw.communities(e, n), 3), 1000, corpus(s, d).select(F.explode(F.array_distinct("countries")).alias("node"), "publication_year", "cited_by_count").groupBy("node").agg(mean_of("publication_year").alias("mean_year"), mean_of("cited_by_count").alias("mean_cites"))))(*_country(s, d)))
_add("K09_top_subgraph", lambda s, d: nw.top_subgraph(*_country(s, d), 8), _C + ", k AS (SELECT node FROM nodes ORDER BY count DESC, node LIMIT 8) SELECT * FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
_add("K10_bipartite_top", lambda s, d: (lambda e: e.join(F.broadcast(e.groupBy("b").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "b").limit(10).select("b")), "b", "left_semi"))(nw.bipartite(corpus(s, d), "countries", "concepts")), ", x AS (SELECT id, unnest(countries) AS a FROM corpus), y AS (SELECT id, unnest(list_distinct(concepts)) AS b FROM corpus), e AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM x JOIN y USING (id) GROUP BY 1, 2) SELECT * FROM e WHERE b IN (SELECT b FROM e GROUP BY 1 ORDER BY sum(weight) DESC, b LIMIT 10)")
_add("U08_graph_merge", lambda s, d: (lambda c: nw.cooccurrence(c.where(F.col("publication_year") < 2018), "countries").unionByName(nw.cooccurrence(c.where(F.col("publication_year") >= 2018), "countries")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))(corpus(s, d).where(F.col("publication_year").isNotNull())), _C.replace("FROM corpus)),", "FROM corpus WHERE publication_year IS NOT NULL)),") + " SELECT * FROM edges")
_add("F19_edge_weight_filter", lambda s, d: nw.filter_edges(_country(s, d)[0], 5.0, 200.0), _C + " SELECT * FROM edges WHERE weight BETWEEN 5 AND 200")
_add("F20_degree_filter", lambda s, d: nw.degrees(_country(s, d)[0]).where(F.col("degree").between(5, 15)).select("node"), _C + _DEG + " SELECT node FROM dg WHERE degree BETWEEN 5 AND 15")
_add("F21_count_filter", lambda s, d: _country(s, d)[1].where(F.col("count") >= 50).select("node"), _C + " SELECT node FROM nodes WHERE count >= 50")

# Text mining
_add("T01_clean_abstract", lambda s, d: table(s, d, "documents").select("doc_id", tm.clean_abstract(F.col("text")).alias("clean")), r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*(?:background|objectives?|methods?|results?|conclusions?|introducci[oó]n|m[eé]todos?|resultados?)[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*:[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*', '', 'g'), '(?i)[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*(?:©|\(c\)[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|copyright[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|all rights reserved).*$', '', 'g'), '[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS clean FROM documents", raw=True)
_add("T02_singular", lambda s, d: corpus(s, d).select(F.explode("author_keywords").alias("t")).distinct().select("t", tm.singular(F.lower("t")).alias("s")))
_add("T03_noun_phrases", lambda s, d: corpus(s, d).select("id", F.explode(tm.noun_phrases(F.col("title"))).alias("phrase")))
_REL = _T + ", p AS (SELECT node, count, count / sum(count) OVER () AS p FROM nodes), c AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), k AS (SELECT c.node, p.p, c.weight / sum(c.weight) OVER (PARTITION BY c.node) AS pc FROM c JOIN p ON p.node = c.other), r AS (SELECT node, round(sum(pc * ln(pc / p)), 4) AS score FROM k GROUP BY 1)"
_add("T04_relevance", lambda s, d: tm.relevance(corpus(s, d), "concepts"), _REL + " SELECT node AS term, count AS n, coalesce(score, 0) AS score FROM nodes LEFT JOIN r USING (node)")
_add("T05_relevant_terms", lambda s, d: tm.relevant_terms(tm.relevance(corpus(s, d), "concepts"), 3, 0.6), _REL + ", z AS (SELECT node AS term, count AS n, coalesce(score, 0) AS score FROM nodes LEFT JOIN r USING (node) WHERE count >= 3) SELECT term, n, score FROM z QUALIFY row_number() OVER (ORDER BY score DESC, n DESC, term) <= ceil(count(*) OVER () * 0.6)")


def _thesaurus(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("study", "<ignore>"), ("Research", "investigation"), ("science", "")], "label string, replacement string")
    return tm.apply_thesaurus(corpus(s, d).select("id", F.col("author_keywords").alias("terms")), "terms", t).select("id", F.array_join("terms", "|").alias("terms"))


_add("T06_thesaurus", _thesaurus, ", k AS (SELECT id, unnest(author_keywords) AS term, generate_subscripts(author_keywords, 1) AS i FROM corpus), r AS (SELECT id, i, CASE lower(term) WHEN 'study' THEN NULL WHEN 'science' THEN NULL WHEN 'research' THEN 'investigation' ELSE term END AS t FROM k), f AS (SELECT id, t, min(i) AS i FROM r WHERE t IS NOT NULL GROUP BY 1, 2) SELECT id, string_agg(t, '|' ORDER BY i) AS terms FROM f GROUP BY 1")
_add("T07_cluster_keywords", lambda s, d: tm.cluster_keywords(table(s, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("unknown"))), "lang", "text"))
_add("T08_embedding_text", lambda s, d: corpus(s, d).select("id", F.concat(F.lit("Title: "), "title", F.lit(" | Keywords: "), F.array_join("keywords", ", ")).alias("text")), "SELECT id, 'Title: ' || title || ' | Keywords: ' || array_to_string(keywords, ', ') AS text FROM corpus")
_add("T10_nlp_table", lambda s, d: corpus(s, d).select("id", F.col("publication_year").alias("year"), F.lower("title").alias("title"), F.array_join(F.transform("keywords", F.lower), "|").alias("keywords")), "SELECT id, publication_year AS year, lower(title) AS title, array_to_string([lower(k) for k in keywords], '|') AS keywords FROM corpus")
_add("T11_burst_table", lambda s, d: corpus(s, d).where(F.col("publication_year").isNotNull()).select(F.col("publication_year").alias("year"), F.explode("keywords").alias("word")), "SELECT publication_year AS year, unnest(keywords) AS word FROM corpus WHERE publication_year IS NOT NULL")
_add("T12_probable_copyright", lambda s, d: table(s, d, "documents").select("doc_id", F.col("text").rlike(r"(?i)(©|\(c\) \d{4}|copyright|all rights reserved)").alias("c")).where("c").select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(©|\(c\) \d{4}|copyright|all rights reserved)')", raw=True)
_add("T13_document_term", lambda s, d: tm.document_term_matrix(corpus(s, d), "id", "concepts"), ", e AS (SELECT id, unnest(list_distinct(concepts)) AS term FROM corpus) SELECT id, term, 1 AS value FROM e WHERE term IN (SELECT term FROM e GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 50)")


def _thematic_map(s: SparkSession, d: str) -> DataFrame:
    """Strategic map of keyword clusters: density and centrality of every community with their quadrant."""
    e, n = _terms(s, d)
    strong = nw.filter_edges(e, 3.0)
    member = nw.communities(strong, nw.degrees(strong).select("node"))
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    m = member.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    j = strong.join(m, "a").join(m.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b")
    inside = j.where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    out = j.where(F.col("ca") != F.col("cb"))
    outside = out.select(F.col("ca").alias("community"), "weight").unionByName(out.select(F.col("cb").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("outside"))
    rows = size.join(inside, "community", "left").join(outside, "community", "left").where(F.col("n") > 1)
    rows = rows.select("community", "n", (F.coalesce("inside", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"), (F.coalesce("outside", F.lit(0.0)) / F.col("n")).alias("centrality"))
    w = Window.partitionBy()
    hd, hc = F.col("density") >= F.expr("percentile(density, 0.5)").over(w), F.col("centrality") >= F.expr("percentile(centrality, 0.5)").over(w)
    return rows.withColumn("quadrant", F.when(hd & hc, "motor").when(hd, "niche").when(hc, "basic").otherwise("emerging"))


_add("A47_thematic_map", _thematic_map)

QUERIES = Q
