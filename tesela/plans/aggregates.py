"""Registered queries of the aggregate operators (inventory A01 to A31, A44 to A46, A49 to A52)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.operators import aggregates as ag
from tesela.plans.corpus import corpus, mean_of, share_of, sql_mean, sql_share, with_corpus
from tesela.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        SQL[name] = with_corpus(sql)


_OA = ", ".join(f"count(*) FILTER (WHERE oa_status = '{s}') AS n_{s}" for s in ag.OA_STATUSES)
_IMPACT = f"count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_mean('fwci')} AS mean_fwci, {sql_share('sum(is_top_10)', 'count(*)')} AS pct_top_10, sum(apc_paid_usd) AS apc_usd"

_add("A01_yearly_series", lambda s, d: ag.yearly_series(corpus(s, d)),
     f"SELECT publication_year, count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_mean('coalesce(fwci, 1)')} AS mean_fwci, {_OA}, count(*) FILTER (WHERE is_top_10 = 1) AS n_top_10, sum(apc_paid_usd) AS apc_usd FROM corpus WHERE publication_year IS NOT NULL GROUP BY 1")
_add("A02_oa_distribution", lambda s, d: ag.oa_distribution(corpus(s, d)),
     f"SELECT oa_status, count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites, sum(apc_paid_usd) AS apc_usd, {sql_share('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM corpus GROUP BY 1")
_add("A03_top_authors", lambda s, d: ag.by_element(corpus(s, d), "author_names", "author").where(F.length("author") > 2).orderBy(F.desc("n_works"), F.desc("cites"), "author").limit(100),
     f"SELECT author, {_IMPACT} FROM (SELECT *, unnest(list_distinct(author_names)) AS author FROM corpus) WHERE length(author) > 2 GROUP BY 1 ORDER BY n_works DESC, cites DESC, author LIMIT 100")
_add("A04_yearly_raw_impact", lambda s, d: corpus(s, d).where(F.col("publication_year") > 1960).groupBy("publication_year").agg(*ag.impact()),
     f"SELECT publication_year, {_IMPACT} FROM corpus WHERE publication_year > 1960 GROUP BY 1")
for _dim in ("oa_status", "language", "publisher", "journal_name", "source_harvester", "is_oa"):
    _add(f"A05_group_by_{_dim}", lambda s, d, _dim=_dim: ag.by_dimension(corpus(s, d), _dim), f"SELECT {_dim}, {_IMPACT} FROM corpus GROUP BY 1")


def _merged_terms(s: SparkSession, d: str) -> DataFrame:
    merged = F.array_distinct(F.concat("author_keywords", "concepts"))
    return corpus(s, d).select(F.explode(merged).alias("term"), "cited_by_count").groupBy("term").agg(ag.n_works(), F.sum("cited_by_count").alias("cites"))


_add("A06_union_of_fields", _merged_terms, "SELECT term, count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites FROM (SELECT cited_by_count, unnest(list_distinct(list_concat(author_keywords, concepts))) AS term FROM corpus) GROUP BY 1")
_add("A07_entity_group_by", lambda s, d: table(s, d, "author_profiles").dropDuplicates(["id"]).groupBy("country_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("country_code")).limit(100),
     "SELECT country_code, count(*) AS n FROM (SELECT DISTINCT id, country_code FROM author_profiles) GROUP BY 1 ORDER BY n DESC, country_code NULLS LAST LIMIT 100")
SQL["A07_entity_group_by"] = "SELECT country_code, count(*) AS n FROM (SELECT id, any_value(country_code) AS country_code FROM author_profiles GROUP BY id) GROUP BY 1 ORDER BY n DESC, country_code NULLS LAST LIMIT 100"


def _topic_institutions(s: SparkSession, d: str) -> DataFrame:
    works = corpus(s, d).where(F.exists("topics", lambda t: F.lower(t).contains("mobility")))
    rows = ag.by_element(works, "affiliations", "institution")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_works"), F.desc("cites"), "institution")))


_add("A08_top_institutions_on_topic", _topic_institutions,
     f", g AS (SELECT institution, {_IMPACT} FROM (SELECT *, unnest(list_distinct(affiliations)) AS institution FROM corpus WHERE list_contains([contains(lower(t), 'mobility') for t in topics], true)) GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n_works DESC, cites DESC, institution) AS INTEGER) AS rank FROM g")
_add("A09_work_dedup", lambda s, d: table(s, d, "works").groupBy("work_id").agg(F.max_by("title", "ingested_at").alias("title"), F.max("cited_by_count").alias("cites"), F.count(F.lit(1)).alias("n_rows")))
SQL["A09_work_dedup"] = "SELECT work_id, max_by(title, ingested_at) AS title, max(cited_by_count) AS cites, count(*) AS n_rows FROM works GROUP BY 1"
_add("A10_author_dedup", lambda s, d: table(s, d, "author_profiles").groupBy("id").agg(F.max("display_name").alias("display_name"), F.max("works_count").alias("works_count"), F.max("h_index").alias("h_index")))
SQL["A10_author_dedup"] = "SELECT id, max(display_name) AS display_name, max(works_count) AS works_count, max(h_index) AS h_index FROM author_profiles GROUP BY 1"


def _fronts(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).select(F.explode(F.array_distinct("topics")).alias("topic"), "fwci", "cited_by_count")
    return rows.groupBy("topic").agg(ag.n_works(), mean_of("fwci").alias("mean_fwci"), F.sum("cited_by_count").alias("cites"), share_of(F.count_if(F.col("fwci") >= 1.5), F.count(F.lit(1))).alias("pct_frontier"))


_add("A11_front_aggregate", _fronts, f"SELECT topic, count(*) AS n_works, {sql_mean('fwci')} AS mean_fwci, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_share('count(*) FILTER (WHERE fwci >= 1.5)', 'count(*)')} AS pct_frontier FROM (SELECT *, unnest(list_distinct(topics)) AS topic FROM corpus) GROUP BY 1")
_add("A12_two_period_growth", lambda s, d: ag.two_period_growth(corpus(s, d), "concepts", (2010, 2016), (2017, 2025), 3),
     f", g AS (SELECT item, count(*) FILTER (WHERE publication_year BETWEEN 2010 AND 2016) AS n1, count(*) FILTER (WHERE publication_year BETWEEN 2017 AND 2025) AS n2, {sql_mean('CASE WHEN publication_year BETWEEN 2017 AND 2025 THEN fwci END')} AS fwci2 FROM (SELECT *, unnest(list_distinct(concepts)) AS item FROM corpus) GROUP BY 1), h AS (SELECT *, {sql_share('n2 - n1', 'n1')} AS growth_pct FROM g WHERE n1 + n2 >= 3) SELECT *, CASE WHEN n1 = 0 AND n2 > 0 THEN 'emerging' WHEN n2 = 0 THEN 'vanished' WHEN growth_pct > 20 THEN 'growing' WHEN growth_pct < -20 THEN 'shrinking' ELSE 'stable' END AS event FROM h")
_add("A13_collaboration_matrix", lambda s, d: ag.collaboration_matrix(corpus(s, d), "MX"),
     f", e AS (SELECT id, fwci, unnest(countries) AS country, list_contains(countries, 'MX') AS mx FROM corpus), sz AS (SELECT country, count(*) AS n_partner FROM e GROUP BY 1), t AS (SELECT count(*) AS n_home FROM corpus WHERE list_contains(countries, 'MX')), j AS (SELECT country, count(*) AS n_joint, {sql_mean('fwci')} AS mean_fwci FROM e WHERE mx AND country <> 'MX' GROUP BY 1) SELECT country, n_joint, mean_fwci, {sql_share('n_joint', 'n_home')} AS pct, round(n_joint / sqrt(n_home * CAST(n_joint AS DOUBLE) * 1.5), 6) AS salton_proxy, round(n_joint / sqrt(CAST(n_home AS DOUBLE) * n_partner), 6) AS salton FROM j JOIN sz USING (country), t")
_add("A13_block_shares", lambda s, d: ag.block_shares(corpus(s, d)),
     " UNION ALL ".join(f"SELECT '{k}' AS block, count(*) AS n_works, {sql_share('count(*)', '(SELECT count(*) FROM corpus)')} AS pct FROM corpus WHERE list_has_any(countries, [{', '.join(repr(x) for x in v)}]) HAVING count(*) > 0" for k, v in ag.BLOCKS.items()))
_add("A14_oa_transition", lambda s, d: corpus(s, d).where(F.col("publication_year").isNotNull()).groupBy("publication_year").agg(ag.n_works(), *ag.oa_counts(), F.sum("apc_paid_usd").alias("apc_usd")).withColumn("pct_open", share_of(F.col("n_works") - F.col("n_closed"), F.col("n_works"))),
     f"SELECT publication_year, count(*) AS n_works, {_OA}, sum(apc_paid_usd) AS apc_usd, {sql_share('count(*) - n_closed', 'count(*)')} AS pct_open FROM corpus WHERE publication_year IS NOT NULL GROUP BY 1")


def _last_segment(s: SparkSession, d: str) -> DataFrame:
    """Last path segment of written references, counted with shares (the SDG-URI pattern)."""
    rows = table(s, d, "works").select(F.explode("referenced_works").alias("x")).where(F.trim("x") != "").select(F.element_at(F.split(F.trim("x"), "/"), -1).alias("segment"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share_of(F.col("n"), F.sum("n").over(Window.partitionBy())))


_add("A15_last_segment_share", _last_segment)
SQL["A15_last_segment_share"] = f"SELECT segment, count(*) AS n, {sql_share('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM (SELECT string_split(trim(x), '/')[-1] AS segment FROM (SELECT unnest(referenced_works) AS x FROM works) WHERE trim(x) <> '') GROUP BY 1"
_JOURNAL = f"SELECT journal_name, count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites, CAST(coalesce(sum(fwci), 0) AS DOUBLE) / greatest(count(*), 1) AS mean_fwci, {sql_share('sum(is_top_10)', 'count(*)')} AS pct_top_10, {sql_share('count(*) FILTER (WHERE is_oa)', 'count(*)')} AS pct_oa, CASE WHEN count(*) FILTER (WHERE oa_status = 'diamond') * 2 > count(*) THEN 'diamond' WHEN count(*) FILTER (WHERE oa_status IN ('diamond', 'gold')) * 2 > count(*) THEN 'gold' WHEN count(*) FILTER (WHERE is_oa) > 0 THEN 'hybrid' ELSE 'closed' END AS pathway FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1"
_add("A16_journal_profile", lambda s, d: ag.journal_profile(corpus(s, d)), _JOURNAL)
_add("A17_journal_benchmark", lambda s, d: ag.journal_profile(corpus(s, d)).orderBy(F.desc("mean_fwci"), "journal_name").limit(10), _JOURNAL + " ORDER BY mean_fwci DESC, journal_name LIMIT 10")
_add("A18_editorial_landscape", lambda s, d: corpus(s, d).select(F.explode("countries").alias("country"), "publisher", "is_oa", "cited_by_count").groupBy("country", "publisher").agg(ag.n_works(), F.sum("cited_by_count").alias("cites"), share_of(F.count_if("is_oa"), F.count(F.lit(1))).alias("pct_oa")),
     f"SELECT country, publisher, count(*) AS n_works, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_share('count(*) FILTER (WHERE is_oa)', 'count(*)')} AS pct_oa FROM (SELECT *, unnest(countries) AS country FROM corpus) GROUP BY 1, 2")
_add("A19_institution_fingerprint", lambda s, d: ag.institution_fingerprint(corpus(s, d)),
     f", e AS (SELECT *, unnest(list_distinct(affiliations)) AS institution FROM corpus), t AS (SELECT institution, count(DISTINCT topic) AS n_topics FROM (SELECT institution, unnest(topics) AS topic FROM e) GROUP BY 1), g AS (SELECT institution, count(*) AS n_works, {sql_share('count(*) FILTER (WHERE is_oa)', 'count(*)')} AS pct_oa, {sql_share('sum(is_top_10)', 'count(*)')} AS pct_top_10, {sql_share('count(*) FILTER (WHERE len(author_names) = 1)', 'count(*)')} AS pct_solo, {sql_share('count(*) FILTER (WHERE len(countries) > 1)', 'count(*)')} AS pct_international FROM e GROUP BY 1) SELECT g.*, coalesce(n_topics, 0) AS n_topics, least(pct_top_10 * 5, 100.0) AS excellence_score FROM g LEFT JOIN t USING (institution)")
_add("A20_taxonomy_counts", lambda s, d: table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").limit(100))
SQL["A20_taxonomy_counts"] = "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 100"
_add("A21_topic_dynamics", lambda s, d: ag.element_by_year(corpus(s, d), "concepts"),
     ", e AS (SELECT publication_year, unnest(list_distinct(concepts)) AS item FROM corpus WHERE publication_year IS NOT NULL), y AS (SELECT unnest(range(min(publication_year), max(publication_year) + 1)) AS publication_year FROM corpus), c AS (SELECT item, publication_year, count(*) AS n FROM e GROUP BY 1, 2) SELECT i.item, CAST(y.publication_year AS INTEGER) AS publication_year, coalesce(c.n, 0) AS n_works FROM (SELECT DISTINCT item FROM e) i CROSS JOIN y LEFT JOIN c ON c.item = i.item AND c.publication_year = y.publication_year")
_add("A22_collaborating_countries", lambda s, d: corpus(s, d).where(F.array_contains("countries", "MX")).select(F.explode("countries").alias("country")).where(F.col("country") != "MX").groupBy("country").agg(ag.n_works()),
     "SELECT country, count(*) AS n_works FROM (SELECT unnest(countries) AS country FROM corpus WHERE list_contains(countries, 'MX')) WHERE country <> 'MX' GROUP BY 1")
_add("A23_keyword_vocabulary", lambda s, d: corpus(s, d).select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(200),
     "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM corpus) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 200")


def _sankey_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).select(F.explode("countries").alias("country"), "oa_status")
    return ag.with_block(rows, "country").groupBy("block", "oa_status").agg(F.count(F.lit(1)).alias("value"))


_BLOCK_CASE = "CASE " + " ".join(f"WHEN country IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in ag.BLOCKS.items()) + " ELSE 'other' END"
_add("A24_sankey_blocks", _sankey_blocks, f"SELECT {_BLOCK_CASE} AS block, oa_status, count(*) AS value FROM (SELECT oa_status, unnest(countries) AS country FROM corpus) GROUP BY 1, 2")


def _entity_profile(s: SparkSession, d: str) -> DataFrame:
    """Institutions with their most frequent topic."""
    works = corpus(s, d)
    base = ag.by_element(works, "affiliations", "institution")
    topics = works.select(F.explode(F.array_distinct("affiliations")).alias("institution"), "topics").select("institution", F.explode("topics").alias("topic"))
    counts = topics.groupBy("institution", "topic").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("institution").orderBy(F.desc("n"), "topic"))).where(F.col("r") == 1)
    return base.join(first.select("institution", F.col("topic").alias("top_topic")), "institution", "left")


_add("A25_entity_profile", _entity_profile, f", e AS (SELECT *, unnest(list_distinct(affiliations)) AS institution FROM corpus), b AS (SELECT institution, {_IMPACT} FROM e GROUP BY 1), t AS (SELECT institution, topic FROM (SELECT institution, unnest(topics) AS topic FROM e) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY institution ORDER BY count(*) DESC, topic) = 1) SELECT b.*, t.topic AS top_topic FROM b LEFT JOIN t USING (institution)")
_add("A26_topic_sums", lambda s, d: table(s, d, "author_profiles").groupBy("primary_topic").agg(F.sum("works_count").alias("works"), mean_of("h_index").alias("mean_h")))
SQL["A26_topic_sums"] = f"SELECT primary_topic, CAST(sum(works_count) AS BIGINT) AS works, {sql_mean('h_index')} AS mean_h FROM author_profiles GROUP BY 1"
_add("A31_health_report", lambda s, d: ag.health_report(corpus(s, d)),
     f"SELECT count(*) AS n_works, (SELECT count(DISTINCT a) FROM (SELECT unnest(author_names) AS a FROM corpus)) AS n_authors, count(DISTINCT journal_name) AS n_sources, (SELECT count(DISTINCT a) FROM (SELECT unnest(countries) AS a FROM corpus)) AS n_countries, count(*) FILTER (WHERE len(author_names) = 1) AS n_single, count(*) FILTER (WHERE len(author_names) > 1) AS n_multi, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_mean('cited_by_count')} AS cites_per_work, {sql_mean('len(author_names)')} AS authors_per_work, min(publication_year) AS first_year, max(publication_year) AS last_year FROM corpus")
_add("A44_country_collaboration", lambda s, d: ag.country_collaboration(corpus(s, d)),
     f"SELECT country, count(*) AS n_works, count(*) FILTER (WHERE len(countries) = 1) AS scp, count(*) FILTER (WHERE len(countries) > 1) AS mcp, {sql_share('mcp', 'count(*)', 1.0)} AS mcp_ratio FROM (SELECT countries, unnest(countries) AS country FROM corpus) GROUP BY 1")
_add("A45_country_institution_flow", lambda s, d: ag.pair_flow(corpus(s, d), "countries", "affiliations").orderBy(F.desc("value"), "source", "target").limit(60),
     "SELECT source, unnest(list_distinct(affiliations)) AS target FROM (SELECT affiliations, unnest(countries) AS source FROM corpus)")
SQL["A45_country_institution_flow"] = with_corpus("SELECT source, target, count(*) AS value FROM (SELECT source, unnest(list_distinct(affiliations)) AS target FROM (SELECT affiliations, unnest(countries) AS source FROM corpus)) GROUP BY 1, 2 ORDER BY value DESC, source, target LIMIT 60")
_add("A45_institution_journal_flow", lambda s, d: ag.pair_flow(corpus(s, d), "affiliations", "journal_name").orderBy(F.desc("value"), "source", "target").limit(60))
SQL["A45_institution_journal_flow"] = with_corpus("SELECT source, journal_name AS target, count(*) AS value FROM (SELECT journal_name, unnest(list_distinct(affiliations)) AS source FROM corpus WHERE journal_name IS NOT NULL) GROUP BY 1, 2 ORDER BY value DESC, source, target LIMIT 60")


def _term_growth(s: SparkSession, d: str) -> DataFrame:
    works = corpus(s, d)
    top = works.select(F.explode(F.array_distinct("keywords")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(20).select("item")
    return ag.element_by_year(works, "keywords").join(F.broadcast(top), "item", "left_semi")


_add("A46_term_growth", _term_growth, ", e AS (SELECT publication_year, unnest(list_distinct(keywords)) AS item FROM corpus), top AS (SELECT item FROM e GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 20), y AS (SELECT unnest(range(min(publication_year), max(publication_year) + 1)) AS publication_year FROM corpus), c AS (SELECT item, publication_year, count(*) AS n FROM e WHERE publication_year IS NOT NULL GROUP BY 1, 2) SELECT top.item, CAST(y.publication_year AS INTEGER) AS publication_year, coalesce(c.n, 0) AS n_works FROM top CROSS JOIN y LEFT JOIN c ON c.item = top.item AND c.publication_year = y.publication_year")


def _value_counts(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).where(F.col("journal_name").isNotNull()).groupBy("journal_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))


_add("A49_value_counts", _value_counts, "SELECT journal_name, count(*) AS n, CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS rank FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1")
_add("A50_tag_by_year", lambda s, d: corpus(s, d).groupBy("journal_name", "publication_year").agg(F.count(F.lit(1)).alias("n")), "SELECT journal_name, publication_year, count(*) AS n FROM corpus GROUP BY 1, 2")


def _glimpse(s: SparkSession, d: str) -> DataFrame:
    works = corpus(s, d)
    cells = F.concat(*map(_tagged, ("author_names", "countries", "keywords")))
    counts = works.select(F.explode(cells).alias("x")).select("x.*").groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "value"))).where(F.col("r") <= 5)


def _tagged(column: str):
    return F.transform(F.array_distinct(column), lambda x: F.struct(F.lit(column).alias("tag"), x.alias("value")))


_add("A51_glimpse", _glimpse, ", e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS tag, unnest(list_distinct({c})) AS value FROM corpus" for c in ("author_names", "countries", "keywords")) + ") SELECT tag, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, value) AS INTEGER) AS r FROM e GROUP BY 1, 2 QUALIFY r <= 5")


def _citation_table(s: SparkSession, d: str) -> DataFrame:
    """Every cited work with count, share of all citations and share of its year's."""
    works = corpus(s, d)
    cited = works.select(F.explode("references").alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    rows = cited.join(works.select(F.col("id").alias("ref"), "publication_year"), "ref", "left")
    return rows.select("ref", "publication_year", "n", share_of(F.col("n"), F.sum("n").over(Window.partitionBy()), 1.0).alias("share_total"), share_of(F.col("n"), F.sum("n").over(Window.partitionBy("publication_year")), 1.0).alias("share_year"))


_add("A52_citation_table", _citation_table, f", c AS (SELECT ref, count(*) AS n FROM (SELECT unnest(refs) AS ref FROM corpus) GROUP BY 1) SELECT ref, publication_year, n, {sql_share('n', 'sum(n) OVER ()', 1.0)} AS share_total, {sql_share('n', 'sum(n) OVER (PARTITION BY publication_year)', 1.0)} AS share_year FROM c LEFT JOIN corpus ON corpus.id = c.ref")
_add("A53_local_citations", lambda s, d: corpus(s, d).select(F.explode("references").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(corpus(s, d).select("id", "journal_name"), "id").groupBy("journal_name").agg(F.sum("n").alias("local_cites"), F.count(F.lit(1)).alias("n_cited")),
     "SELECT journal_name, CAST(sum(n) AS BIGINT) AS local_cites, count(*) AS n_cited FROM (SELECT ref AS id, count(*) AS n FROM (SELECT unnest(refs) AS ref FROM corpus) GROUP BY 1) JOIN corpus USING (id) GROUP BY 1")

QUERIES = Q
