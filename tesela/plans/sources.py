"""Registered queries of sources and sinks (S); files are written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.plans.corpus import corpus, with_corpus
from tesela.sources import bibliographic as bib
from tesela.sources import packages, sinks, sql
from tesela.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, text: str | None = None, raw: bool = False) -> None:
    Q[name] = f
    if text:
        SQL[name] = text if raw else with_corpus(text)


def _records(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).where(F.col("journal_name").isNotNull() & F.col("publication_year").isNotNull() & (F.col("title") != "")).select("id", "title", F.col("publication_year").alias("year"), F.trim("journal_name").alias("journal"), F.col("author_names").alias("authors"), "keywords")


_BACK = "SELECT id, title, publication_year AS year, trim(journal_name) AS journal, CAST(len(author_names) AS INTEGER) AS n_authors FROM corpus WHERE journal_name IS NOT NULL AND publication_year IS NOT NULL AND title <> ''"


def _back(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "year", "journal", F.size("authors").alias("n_authors"))


def _through_text(lines, read, suffix: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = sinks.scratch(s, suffix)
        lines(_records(s, d)).write.text(path)
        return _back(read(s, path))

    return run


def _through_csv(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "csv") + ".csv"
    r = _records(s, d)
    sinks.save_corpus(r.select(F.col("authors").alias("Authors"), F.col("title").alias("Title"), F.col("year").alias("Year"), F.col("journal").alias("Source title"), F.col("keywords").alias("Author Keywords"), F.col("id").alias("EID")), path)
    return _back(bib.read_delimited(s, path))


def _through_named_csv(names: dict[str, str], sep: str = ","):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = sinks.scratch(s, "csv")
        r = _records(s, d)
        flat = r.select(*[F.array_join(c, "; ").alias(n) if c in ("authors", "keywords") else F.col(c).alias(n) for c, n in names.items()])
        flat.write.csv(path, header=True, sep=sep, escape='"')
        return _back(bib.read_delimited(s, path, sep))

    return run


def _through_json(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "json")
    r = _records(s, d)
    author = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    r.select(F.concat(F.lit("https://alex.example/"), "id").alias("id"), "title", F.col("year").alias("publication_year"), author.alias("authorships"), F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location")).write.json(path)
    return _back(bib.read_works_json(s, path))


_add("S01_register_corpus", lambda s, d: sql.register_corpus(s, f"{d}/works.parquet", "tesela_works").groupBy("source_harvester").agg(F.count(F.lit(1)).alias("n")), "SELECT source_harvester, count(*) AS n FROM works GROUP BY 1", raw=True)
_add("S02_parameterised_sql", lambda s, d: sql.run_sql(s, "SELECT work_id FROM {w} WHERE publication_year = :y AND is_oa", {"y": 2018}, w=table(s, d, "works")), "SELECT work_id FROM works WHERE publication_year = 2018 AND is_oa", raw=True)
_add("S03_guarded_sql", lambda s, d: sql.guarded(s, "SELECT author_id, count(*) AS n FROM {a} GROUP BY author_id ORDER BY n DESC, author_id", joins=False, a=table(s, d, "authorships")), "SELECT author_id, count(*) AS n FROM authorships GROUP BY 1 ORDER BY n DESC, author_id NULLS FIRST LIMIT 50", raw=True)
_STATEMENTS = {"SELECT a FROM t": True, "SELECT a FROM t JOIN u USING (k)": False, "SELECT a FROM t ARRAY JOIN xs AS x": True, "SELECT 'left join' AS a FROM t -- join": True, "WITH v AS (SELECT 1) SELECT * FROM t inner\njoin v": False}


def _join_ban(s: SparkSession, d: str) -> DataFrame:
    def allowed(query: str) -> bool:
        try:
            sql.forbid_joins(query)
        except ValueError:
            return False
        return True

    return s.createDataFrame([(q, allowed(q)) for q in _STATEMENTS], "statement string, allowed boolean")


_add("S04_join_ban", _join_ban, "SELECT * FROM (VALUES " + ", ".join(f"('{q.replace(chr(39), chr(39) * 2)}', {str(v).lower()})" for q, v in _STATEMENTS.items()) + ") t(statement, allowed)", raw=True)
_add("S05_open_select", lambda s, d: sql.guarded(s, "WITH x AS (SELECT i.country_code AS country, a.author_id FROM {a} a JOIN {i} i ON i.id = a.institution_id) SELECT country, count(DISTINCT author_id) AS n FROM x GROUP BY country ORDER BY n DESC, country", a=table(s, d, "authorships"), i=table(s, d, "institutions")), "SELECT i.country_code AS country, count(DISTINCT author_id) AS n FROM authorships a JOIN institutions i ON i.id = a.institution_id GROUP BY 1 ORDER BY n DESC, country NULLS FIRST LIMIT 50", raw=True)
_add("S07_agent_sql", lambda s, d: sql.guarded(s, "SELECT lang, section, count(*) AS n, sum(n_chars) AS chars FROM {t} GROUP BY lang, section ORDER BY n DESC, lang, section", 30, joins=False, t=table(s, d, "documents")), "SELECT lang, section, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2 ORDER BY n DESC, lang NULLS FIRST, section NULLS FIRST LIMIT 30", raw=True)
_add("S08_service_sql", lambda s, d: sql.guarded(s, "SELECT journal_name, count(*) AS n FROM {w} WHERE publication_year >= :y GROUP BY journal_name ORDER BY n DESC, journal_name LIMIT 20", joins=False, params={"y": 2015}, w=table(s, d, "works")), "SELECT journal_name, count(*) AS n FROM works WHERE publication_year >= 2015 GROUP BY 1 ORDER BY n DESC, journal_name NULLS FIRST LIMIT 20", raw=True)
_add("S06_guarded_without_vectors", lambda s, d: sql.guarded(s, "SELECT * FROM {e} ORDER BY vec_id LIMIT 20", drop_vectors=True, e=table(s, d, "embeddings")), "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 20", raw=True)
_add("S09_filtered_scan", lambda s, d: sql.filtered_scan(table(s, d, "author_profiles").select("id", "display_name", "institution").distinct(), {"institution": "tlaravila", "display_name": "al"}, "id"), "SELECT DISTINCT id, display_name, institution FROM author_profiles WHERE contains(lower(institution), 'tlaravila') AND contains(lower(display_name), 'al')", raw=True)


def _json_lookup(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "lookup")
    table(s, d, "snii_llm_verified_matches").write.json(path)
    m = s.read.schema("snii_cvu string, matched_orcid string").json(path)
    return m.where(F.col("snii_cvu") == m.agg(F.min("snii_cvu")).scalar()).limit(1)


_add("S11_json_lookup", _json_lookup, "SELECT snii_cvu, matched_orcid FROM snii_llm_verified_matches ORDER BY snii_cvu LIMIT 1", raw=True)
_add("S12_direct_parquet", lambda s, d: s.sql(f"SELECT lang, count(*) AS n FROM parquet.`{d}/documents.parquet` GROUP BY lang"), "SELECT lang, count(*) AS n FROM documents GROUP BY 1", raw=True)


def _windows(s: SparkSession, d: str) -> DataFrame:
    """Five-year windows of the works, written and read back as a window file, and the one nearest to a year outside them."""
    path = sinks.scratch(s, "windows")
    years = table(s, d, "works").where(F.col("publication_year").isNotNull()).select("publication_year")
    years.groupBy(F.floor(F.col("publication_year") / 5).cast("int").alias("bin_id")).agg(F.min("publication_year").alias("y_start"), F.max("publication_year").alias("y_end"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    return sql.nearest_window(s.read.parquet(path), 1950)


_add("S13_nearest_window", _windows, "SELECT CAST(publication_year // 5 AS INTEGER) AS bin_id, min(publication_year) AS y_start, max(publication_year) AS y_end, count(*) AS n FROM works WHERE publication_year IS NOT NULL GROUP BY 1 ORDER BY greatest(min(publication_year) - 1950, 1950 - max(publication_year), 0), 1 LIMIT 1", raw=True)


def _by_path(s: SparkSession, d: str) -> DataFrame:
    """A table found by file name and directory words in a tree of folders."""
    base = sinks.scratch(s, "tree")
    every = table(s, d, "institutions").select("id", "display_name", "country_code")
    every.where(F.col("country_code") == "MX").write.parquet(f"{base}/institutions/MX/result.parquet")
    every.where(F.col("country_code") != "MX").write.parquet(f"{base}/institutions/other/result.parquet")
    tree = s.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/institutions").select(F.regexp_extract("path", r"institutions/(.*)/[^/]+$", 1).alias("p")).distinct()
    found = sql.resolve_path([r["p"] for r in tree.collect()], "result.parquet", "mx")
    return s.read.parquet(f"{base}/institutions/{found}")


_add("S10_path_resolution", _by_path, "SELECT id, display_name, country_code FROM institutions WHERE country_code = 'MX'", raw=True)
_add("S14_entity_by_id", lambda s, d: sql.entity_by_id(table(s, d, "institutions").select("id", "display_name"), "Universidad Autónoma de Tlaravila", ("id", "display_name")), "SELECT id, display_name FROM institutions WHERE display_name = 'Universidad Autónoma de Tlaravila'", raw=True)
_add("S15_scopus_csv", _through_csv, _BACK)
_add("S16_ris", _through_text(sinks.ris_lines, bib.read_ris, "ris"), _BACK)
_add("S17_wos_text", _through_text(sinks.wos_lines, bib.read_wos, "wos"), _BACK)
_add("S18_dimensions_csv", _through_named_csv({"id": "Publication ID", "title": "Title", "year": "PubYear", "journal": "Source title", "authors": "Authors", "keywords": "MeSH terms"}), _BACK)
_add("S19_lens_csv", _through_named_csv({"id": "Lens ID", "title": "Title", "year": "Publication Year", "journal": "Source Title", "authors": "Author/s", "keywords": "Keywords"}), _BACK)
_add("S20_works_csv", _through_named_csv({"id": "id", "title": "Título", "year": "Año", "journal": "Revista", "authors": "Autores", "keywords": "Palabras clave"}, "\t"), _BACK)
_add("S21_works_json", _through_json, _BACK)
_add("S25_records_loader", _through_text(sinks.ris_lines, bib.read_any, "any"), _BACK)
_add("S24_router", _through_text(sinks.wos_lines, bib.read_any, "route"), _BACK)
_add("S35_medline", _through_text(sinks.medline_lines, bib.read_medline, "medline"), _BACK)


def _network_json(s: SparkSession, d: str) -> DataFrame:
    from tesela.operators import networks as nw

    c = corpus(s, d)
    n = nw.node_counts(c, "countries")
    path = sinks.scratch(s, "net")
    nw.export_json(nw.cooccurrence(c, "countries"), n, n.select("node", F.lit(1).alias("cluster"))).select(F.col("json").alias("value")).write.text(path)
    return bib.read_network_json(s, path)[0].select("id", "label")


_add("S22_network_json", _network_json, "SELECT CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS id, x AS label FROM (SELECT DISTINCT unnest(countries) AS x FROM corpus)")
_SAMPLES = {"TY  - JOUR": "ris", "PMID- 1": "medline", "FN Export\nPT J": "wos", '{"network": {}}': "network_json", '[{"id": 1}]': "works_json", "Authors,Title,EID": "scopus_csv", "Lens ID,Title": "lens_csv", "id,title": "works_csv"}
_add("S23_sniffers", lambda s, d: s.createDataFrame([(k, bib.sniff(k)) for k in _SAMPLES], "head string, kind string"))


def _package_table(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "pkg")
    g = corpus(s, d).where(F.col("journal_name").isNotNull()).groupBy(F.trim("journal_name").alias("journal_name")).agg(F.count(F.lit(1)).alias("docs"), F.sum("cited_by_count").alias("cites"))
    g.coalesce(1).write.csv(path, header=True, sep=";")
    return packages.read_table(s, path).select("journal_name", "docs", "cites")


_PKG = "SELECT trim(journal_name) AS journal_name, CAST(count(*) AS DOUBLE) AS docs, CAST(sum(cited_by_count) AS DOUBLE) AS cites FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1"
_add("S26_indicator_csv", _package_table, _PKG)
_add("S29_metrics_reader", _package_table, _PKG)
_FILES = ["pkg/Authors/authors 2010-2014.csv", "pkg/Authors/authors 2015-2019.csv", "pkg/Authors/authors trend.csv", "pkg/Countries/country whole.parquet", "pkg/Countries/country whole.csv", "pkg/Corpus/institution baseline.csv"]
for _id in ("S27", "S30"):
    _add(f"{_id}_file_classifier", lambda s, d: s.createDataFrame([(p, *packages.classify(p)) for p in _FILES], "path string, unit string, slot string"))
for _id in ("S28", "S31"):
    _add(f"{_id}_inventory", lambda s, d: s.createDataFrame([(u, k, p) for u, v in packages.inventory(_FILES).items() for k, p in v.items()], "unit string, slot string, path string"))


def _longitudinal(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).where(F.col("journal_name").isNotNull())
    tables = {str(y): c.where(F.col("publication_year") == y).groupBy("journal_name").agg(F.count(F.lit(1)).alias("docs"), F.sum("cited_by_count").alias("cites")) for y in (2017, 2018)}
    return packages.longitudinal(tables, "journal_name")


_add("S32_longitudinal", _longitudinal, ", g AS (SELECT CAST(publication_year AS VARCHAR) AS period, journal_name AS label, CAST(count(*) AS DOUBLE) AS docs, CAST(sum(cited_by_count) AS DOUBLE) AS cites FROM corpus WHERE journal_name IS NOT NULL AND publication_year IN (2017, 2018) GROUP BY 1, 2) SELECT period, label, 'docs' AS indicator, docs AS value FROM g UNION ALL SELECT period, label, 'cites', cites FROM g")
_add("S34_tiered_search", lambda s, d: sql.filtered_scan(table(s, d, "institutions").select("id", "display_name"), {"display_name": "tlaravila"}, "id", top=25), "SELECT id, display_name FROM institutions WHERE contains(lower(display_name), 'tlaravila') ORDER BY id LIMIT 25", raw=True)


def _grants(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "grants")
    table(s, d, "orders").select(F.col("o_orderkey").alias("AwardNumber"), F.col("o_orderpriority").alias("AwardTitle"), F.col("o_custkey").alias("Investigator"), F.col("o_orderstatus").alias("Institution"), F.year("o_orderdate").alias("Year"), F.concat(F.lit("$"), F.col("o_custkey")).alias("AwardAmount")).write.csv(path, header=True)
    return bib.read_grants(s, path).select("id", "title", "year", "amount")


_add("S36_grants", _grants, "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS DOUBLE) AS amount FROM orders", raw=True)


def _sink(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = sinks.scratch(s, kind) + "." + kind
        sinks.save_corpus(_records(s, d), path)
        back = {"parquet": s.read.parquet, "json": s.read.json}[kind](path)
        return back.select("id", F.size("keywords").alias("n"))

    return run


_N = "SELECT id, CAST(len(keywords) AS INTEGER) AS n FROM corpus WHERE journal_name IS NOT NULL AND publication_year IS NOT NULL AND title <> ''"
_add("S38_canonical_sink_parquet", _sink("parquet"), _N)
_add("S38_canonical_sink_json", _sink("json"), _N)


def _split_csv(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "split")
    sinks.split_by(_records(s, d).select("id", "year"), path, "year")
    return s.read.csv(path, header=True, inferSchema=True).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


_add("S39_split_writer", _split_csv, "SELECT publication_year AS year, count(*) AS n FROM corpus WHERE journal_name IS NOT NULL AND publication_year IS NOT NULL AND title <> '' GROUP BY 1")


def _graph_files(s: SparkSession, d: str) -> DataFrame:
    from tesela.operators import networks as nw

    c, path = corpus(s, d), sinks.scratch(s, "graph")
    sinks.write_graph(nw.cooccurrence(c, "countries"), nw.node_counts(c, "countries"), path)
    return sinks.read_graph(s, path)[0]


_add("S40_graph_files", _graph_files, ", i AS (SELECT id, unnest(countries) AS x FROM corpus) SELECT p.x AS a, q.x AS b, CAST(count(*) AS DOUBLE) AS weight FROM i p JOIN i q ON p.id = q.id AND p.x < q.x GROUP BY 1, 2")
_add("S41_upsert", lambda s, d: (lambda w: sinks.upsert(w.where(F.year("ingested_at") < 2020), w.where(F.year("ingested_at") >= 2020), "work_id", "ingested_at"))(table(s, d, "works").select("work_id", "ingested_at").distinct()), "SELECT work_id, max(ingested_at) AS ingested_at FROM works GROUP BY 1", raw=True)
_add("S42_experience_search", lambda s, d: sinks.search_experiences(table(s, d, "snii_llm_verified_matches").select(F.col("snii_nombre").alias("value"), "confidence", F.col("verified_at").alias("created_at")), "alberto").select("value", "confidence"), "SELECT snii_nombre AS value, confidence FROM snii_llm_verified_matches WHERE contains(lower(snii_nombre), 'alberto') ORDER BY confidence DESC NULLS LAST, verified_at DESC NULLS LAST LIMIT 10", raw=True)
_add("S43_pattern_counts", lambda s, d: table(s, d, "authorships").where(F.lower("author_name").rlike("alberto.*")).groupBy("institution_id").agg(F.countDistinct("work_id").alias("n")), "SELECT institution_id, count(DISTINCT work_id) AS n FROM authorships WHERE regexp_matches(lower(author_name), 'alberto.*') GROUP BY 1", raw=True)

QUERIES = Q
