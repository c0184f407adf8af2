"""Registered queries of projections (P), filters (F), joins (J) and scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as tx
from tesela.plans.corpus import corpus, mean_of, share_of, sql_mean, sql_share, with_corpus
from tesela.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, raw: bool = False) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql if raw else with_corpus(sql)


def _fold(c: str) -> str:
    return f"translate({c}, '{tx.ACCENTED}', '{tx.PLAIN}')"


def _key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_fold(c)}), '[,.]', '', 'g'), '-', ' ', 'g'), '\s+', ' ', 'g'))"


# Projections
_add("P01_select_alias", lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), "SELECT n_nationkey AS id, n_name AS label FROM nation", raw=True)
_add("P02_canonical_record", lambda s, d: corpus(s, d).select("id", "title", "publication_year", "cited_by_count", "is_oa", "oa_status", F.size("author_names").alias("n_authors"), F.size("references").alias("n_refs")), "SELECT id, title, publication_year, cited_by_count, is_oa, oa_status, CAST(len(author_names) AS INTEGER) AS n_authors, CAST(len(refs) AS INTEGER) AS n_refs FROM corpus")


def _empty(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).limit(0)


_add("P03_empty_frame", _empty)
_add("P04_prefix_forms", lambda s, d: corpus(s, d).where(F.col("doi").isNotNull()).select("id", F.concat(F.lit("https://doi.org/"), F.regexp_replace(F.lower("doi"), r"^https?://doi\.org/", "")).alias("doi_url")), r"SELECT id, 'https://doi.org/' || regexp_replace(lower(doi), '^https?://doi\.org/', '') AS doi_url FROM corpus WHERE doi IS NOT NULL")
_add("P05_drop_vectors", lambda s, d: (lambda e: e.select(*[c for c in e.columns if not c.startswith("embedding") and "vector" not in c]))(table(s, d, "embeddings")), "SELECT vec_id, label FROM embeddings", raw=True)
_add("P06_drop_all_null_rows", lambda s, d: table(s, d, "author_profiles").select("orcid", "snii_level", "institution").dropna(how="all"), "SELECT orcid, snii_level, institution FROM author_profiles WHERE orcid IS NOT NULL OR snii_level IS NOT NULL OR institution IS NOT NULL", raw=True)
_add("P07_derived_indicators", lambda s, d: corpus(s, d).groupBy("journal_name").agg(F.count(F.lit(1)).alias("docs"), F.sum("cited_by_count").alias("cites")).withColumn("impact_factor", share_of(F.col("cites"), F.col("docs"), 1.0)).withColumn("share_pct", share_of(F.col("docs"), F.sum("docs").over(Window.partitionBy()))), f"SELECT journal_name, count(*) AS docs, CAST(sum(cited_by_count) AS BIGINT) AS cites, {sql_share('sum(cited_by_count)', 'count(*)', 1.0)} AS impact_factor, {sql_share('count(*)', 'sum(count(*)) OVER ()')} AS share_pct FROM corpus GROUP BY 1")
_add("P08_country_of_affiliation", lambda s, d: table(s, d, "raw_records").select("record_id", tx.country_of_affiliation(F.col("c1")).alias("country")).where(F.col("country").isNotNull()), r"SELECT record_id, c AS country FROM (SELECT record_id, trim(string_split(c1, ',')[-1]) AS c FROM raw_records) WHERE length(c) > 2 AND NOT regexp_full_match(c, '\d+')", raw=True)
_add("P09_document_label", lambda s, d: corpus(s, d).select("id", F.concat(F.substr("title", F.lit(1), F.lit(50)), F.lit(" ("), F.coalesce(F.col("publication_year").cast("string"), F.lit("")), F.lit(")")).alias("label")), "SELECT id, substring(title, 1, 50) || ' (' || coalesce(CAST(publication_year AS VARCHAR), '') || ')' AS label FROM corpus")
_add("P10_code_lookup", lambda s, d: table(s, d, "institutions").select("id", F.element_at(F.create_map(*[F.lit(x) for kv in (("MX", "MEX"), ("BR", "BRA"), ("CO", "COL"), ("AR", "ARG")) for x in kv]), F.col("country_code")).alias("iso3")), "SELECT id, CASE country_code WHEN 'MX' THEN 'MEX' WHEN 'BR' THEN 'BRA' WHEN 'CO' THEN 'COL' WHEN 'AR' THEN 'ARG' END AS iso3 FROM institutions", raw=True)


# Filters
def _ids(condition):
    return lambda s, d: corpus(s, d).where(condition()).select("id")


for _name, _cond, _sql in (
    ("F01_contains_ci", lambda: F.lower("title").contains("mobility"), "contains(lower(title), 'mobility')"),
    ("F02_ilike", lambda: F.col("title").ilike("%memory%"), "title ILIKE '%memory%'"),
    ("F03_contains", lambda: F.col("doi").contains("10.5555/a"), "contains(doi, '10.5555/a')"),
    ("F04_has", lambda: F.array_contains("countries", "BR"), "list_contains(countries, 'BR')"),
    ("F05_has_any", lambda: F.arrays_overlap("countries", F.array(F.lit("AR"), F.lit("CL"))), "list_has_any(countries, ['AR', 'CL'])"),
    ("F06_exists_lambda", lambda: F.exists("keywords", lambda k: F.lower(k).contains("quantum")), "list_contains([contains(lower(k), 'quantum') for k in keywords], true)"),
    ("F07_not_empty", lambda: F.size("references") > 0, "len(refs) > 0"),
    ("F08_range_in", lambda: F.col("publication_year").between(2015, 2020) & F.col("oa_status").isin("gold", "green") & (F.col("title") != ""), "publication_year BETWEEN 2015 AND 2020 AND oa_status IN ('gold', 'green') AND title <> ''"),
    ("F13_composed_search", lambda: F.lower("title").contains("growth") & (F.col("publication_year") >= 2012) & F.array_contains("countries", "MX") & (F.col("cited_by_count") >= 1), "contains(lower(title), 'growth') AND publication_year >= 2012 AND list_contains(countries, 'MX') AND cited_by_count >= 1"),
    ("F14_fragment_rewrite", lambda: F.exists("author_names", lambda a: tx.entity_key(a) == "raquel crutijonda duyogilva"), f"list_contains([{_key('a')} = 'raquel crutijonda duyogilva' for a in author_names], true)"),
    ("F17_exclude_baseline", lambda: ~F.lower("title").contains("baseline"), "NOT contains(lower(title), 'baseline')"),
    ("F24_year_slice", lambda: F.col("publication_year").between(2010, 2014) | F.col("publication_year").isNull(), "publication_year BETWEEN 2010 AND 2014 OR publication_year IS NULL"),
    ("F25_drop_non_journals", lambda: F.col("journal_name").isNotNull() & F.col("publication_year").isNotNull(), "journal_name IS NOT NULL AND publication_year IS NOT NULL"),
):
    _add(_name, _ids(_cond), f"SELECT id FROM corpus WHERE {_sql}")

_add("F09_author_ids", lambda s, d: table(s, d, "snii_llm_verified_matches").select("snii_cvu", F.array_join(tx.author_ids(F.col("matched_openalex_id")), ",").alias("ids")), r"SELECT snii_cvu, array_to_string(regexp_extract_all(upper(matched_openalex_id), '(A\d{4,})', 1), ',') AS ids FROM snii_llm_verified_matches", raw=True)
_add("F10_name_permutations", lambda s, d: table(s, d, "author_profiles").select(F.explode(tx.name_permutations(F.col("display_name"))).alias("form")).distinct())


def _tokens_match(s: SparkSession, d: str) -> DataFrame:
    """names that have all tokens of the searched one, in any order."""
    key = tx.entity_key(F.col("display_name"))
    return table(s, d, "author_profiles").where(key.contains("alberto") & key.contains("bavepazco")).select("id").distinct()


_add("F11_order_insensitive_name", _tokens_match, f"SELECT DISTINCT id FROM author_profiles WHERE contains({_key('display_name')}, 'alberto') AND contains({_key('display_name')}, 'bavepazco')", raw=True)


def _flexible(s: SparkSession, d: str) -> DataFrame:
    """names with any pair of three tokens."""
    key, t = tx.entity_key(F.col("display_name")), ("alberto", "isabel", "brelisilin")
    has = [key.contains(x) for x in t]
    return table(s, d, "author_profiles").where((has[0] & has[1]) | (has[0] & has[2]) | (has[1] & has[2])).select("id").distinct()


_add("F12_flexible_name", _flexible, "WITH k AS (SELECT id, " + _key("display_name") + " AS n FROM author_profiles) SELECT DISTINCT id FROM k WHERE (contains(n, 'alberto') AND contains(n, 'isabel')) OR (contains(n, 'alberto') AND contains(n, 'brelisilin')) OR (contains(n, 'isabel') AND contains(n, 'brelisilin'))", raw=True)


def _alias_resolution(s: SparkSession, d: str) -> DataFrame:
    """acronym or name to institution ids, then profiles of them."""
    inst = table(s, d, "institutions").select(F.col("id").alias("institution_id"), F.explode(F.concat(F.array("display_name"), F.coalesce("acronyms", F.array()))).alias("alias"))
    people = table(s, d, "author_profiles").select("id", F.upper(F.trim("institution")).alias("alias")).distinct()
    return people.join(inst.select("institution_id", F.upper("alias").alias("alias")), "alias").select("id", "institution_id").distinct()


_add("F15_alias_resolution", _alias_resolution, "WITH i AS (SELECT id AS institution_id, upper(unnest(list_concat([display_name], coalesce(acronyms, [])))) AS alias FROM institutions) SELECT DISTINCT p.id, institution_id FROM author_profiles p JOIN i ON upper(trim(p.institution)) = i.alias", raw=True)
_add("F16_minimum_threshold", lambda s, d: corpus(s, d).groupBy("journal_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5), "SELECT journal_name, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) >= 5")
_add("F18_isin_top", lambda s, d: corpus(s, d).join(F.broadcast(corpus(s, d).where(F.col("journal_name").isNotNull()).groupBy("journal_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "journal_name").limit(5).select("journal_name")), "journal_name", "left_semi").select("id"), "SELECT id FROM corpus WHERE journal_name IN (SELECT journal_name FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, journal_name LIMIT 5)")


def _cite_filter(s: SparkSession, d: str) -> DataFrame:
    """works that cite a work of the field value given (journal contains a text)."""
    c = corpus(s, d)
    cited = c.where(F.lower("journal_name").contains("mobility")).select(F.col("id").alias("ref"))
    return c.select("id", F.explode("references").alias("ref")).join(cited, "ref", "left_semi").select("id").distinct()


_add("F22_cite_filter", _cite_filter, "SELECT DISTINCT id FROM (SELECT id, unnest(refs) AS ref FROM corpus) WHERE ref IN (SELECT id FROM corpus WHERE contains(lower(journal_name), 'mobility'))")


def _citing_top(s: SparkSession, d: str) -> DataFrame:
    """works that cite the most cited work of the corpus."""
    e = corpus(s, d).select("id", F.explode("references").alias("ref"))
    top = e.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ref").limit(1)
    return e.join(F.broadcast(top), "ref", "left_semi").select("id")


_add("F23_local_cites_of", _citing_top, ", e AS (SELECT id, unnest(refs) AS ref FROM corpus) SELECT id FROM e WHERE ref = (SELECT ref FROM e GROUP BY 1 ORDER BY count(*) DESC, ref LIMIT 1)")


def _citation_rules(s: SparkSession, d: str) -> DataFrame:
    """cited works kept if they are journal articles with authors whose title has (or lacks) a keyword."""
    c = corpus(s, d)
    kept = c.where(F.col("journal_name").isNotNull() & (F.size("author_names") > 0) & F.lower("title").contains("model")).select(F.col("id").alias("ref"))
    return c.select("id", F.explode("references").alias("ref")).join(kept, "ref", "left_semi")


_add("F26_citation_rules", _citation_rules, ", k AS (SELECT id AS ref FROM corpus WHERE journal_name IS NOT NULL AND len(author_names) > 0 AND contains(lower(title), 'model')) SELECT id, ref FROM (SELECT id, unnest(refs) AS ref FROM corpus) SEMI JOIN k USING (ref)")
_add("F27_noise_removal", lambda s, d: table(s, d, "embeddings").where(F.col("label") != -1).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT label, count(*) AS n FROM embeddings WHERE label <> -1 GROUP BY 1", raw=True)

# Joins
_add("J01_unnest", lambda s, d: corpus(s, d).select("id", F.explode("countries").alias("country")), "SELECT id, unnest(countries) AS country FROM corpus")
_add("J02_institution_lookup", lambda s, d: table(s, d, "author_profiles").select("id", "institution").distinct().join(F.broadcast(table(s, d, "institutions").select(F.col("display_name").alias("institution"), F.col("id").alias("institution_id"))), "institution", "left"), "SELECT DISTINCT p.institution, p.id, i.id AS institution_id FROM author_profiles p LEFT JOIN institutions i ON i.display_name = p.institution", raw=True)


def _author_lookup(s: SparkSession, d: str) -> DataFrame:
    """Names of authorships by id, else by equal name key."""
    a = table(s, d, "authorships").where(F.col("author_name").isNotNull()).select("author_id", "author_name").distinct()
    p = table(s, d, "author_profiles").groupBy("id").agg(F.max("display_name").alias("display_name"))
    by_name = p.groupBy(tx.entity_key(F.col("display_name")).alias("k")).agg(F.min("id").alias("by_name"))
    named = a.join(p.select(F.col("id").alias("author_id"), F.col("id").alias("by_id")), "author_id", "left").withColumn("k", tx.entity_key(F.col("author_name"))).join(by_name, "k", "left")
    return named.select("author_name", F.coalesce("by_id", "by_name").alias("profile")).distinct()


_add("J03_author_lookup", _author_lookup, f"WITH p AS (SELECT id, max(display_name) AS display_name FROM author_profiles GROUP BY 1), n AS (SELECT {_key('display_name')} AS k, min(id) AS by_name FROM p GROUP BY 1) SELECT DISTINCT author_name, coalesce(p.id, n.by_name) AS profile FROM authorships a LEFT JOIN p ON p.id = a.author_id LEFT JOIN n ON n.k = {_key('a.author_name')} WHERE author_name IS NOT NULL", raw=True)


def _names_in_arrays(s: SparkSession, d: str) -> DataFrame:
    """Ids inside an array replaced by names, order kept."""
    ids = table(s, d, "authorships").where(F.col("author_id").isNotNull() & F.col("work_id").isNotNull()).dropDuplicates(["authorship_id"]).select("work_id", "author_position", "authorship_id", F.col("author_id").alias("id"))
    names = table(s, d, "author_profiles").groupBy("id").agg(F.max("display_name").alias("name"))
    rows = ids.join(names, "id", "left").select("work_id", F.struct("author_position", "authorship_id", F.coalesce("name", "id").alias("n")).alias("x"))
    return rows.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"]), "; ").alias("names"))


_add("J04_names_in_arrays", _names_in_arrays, "WITH p AS (SELECT id, max(display_name) AS name FROM author_profiles GROUP BY 1), a AS (SELECT DISTINCT authorship_id, work_id, author_position, author_id FROM authorships WHERE author_id IS NOT NULL AND work_id IS NOT NULL) SELECT work_id, string_agg(coalesce(name, author_id), '; ' ORDER BY author_position, authorship_id) AS names FROM a LEFT JOIN p ON p.id = a.author_id GROUP BY 1", raw=True)


def _union_lookup(s: SparkSession, d: str) -> DataFrame:
    """Matched profiles first, then profiles not yet seen."""
    first = table(s, d, "snii_llm_verified_matches").select(F.regexp_extract("matched_openalex_id", r"(A\d+)", 1).alias("id")).where(F.col("id") != "").distinct()
    rest = table(s, d, "author_profiles").select("id").distinct().join(first, "id", "left_anti")
    return first.withColumn("tier", F.lit(1)).unionByName(rest.withColumn("tier", F.lit(2)))


_add("J05_union_lookup", _union_lookup, r"WITH f AS (SELECT DISTINCT regexp_extract(matched_openalex_id, '(A\d+)', 1) AS id FROM snii_llm_verified_matches WHERE regexp_extract(matched_openalex_id, '(A\d+)', 1) <> '') SELECT id, 1 AS tier FROM f UNION ALL SELECT DISTINCT id, 2 FROM author_profiles WHERE id NOT IN (SELECT id FROM f)", raw=True)
_add("J06_semi_join", lambda s, d: table(s, d, "authorships").join(table(s, d, "author_profiles").where(F.lower("display_name").contains("alberto")).select(F.col("id").alias("author_id")), "author_id", "left_semi").select("authorship_id").distinct(), "SELECT DISTINCT authorship_id FROM authorships WHERE author_id IN (SELECT id FROM author_profiles WHERE contains(lower(display_name), 'alberto'))", raw=True)


def _top_topics(s: SparkSession, d: str) -> DataFrame:
    e = corpus(s, d).select("id", F.explode(F.array_distinct("topics")).alias("topic"))
    top = e.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(5).select("topic")
    return e.join(F.broadcast(top), "topic", "left_semi")


_add("J07_in_subquery", _top_topics, ", e AS (SELECT id, unnest(list_distinct(topics)) AS topic FROM corpus) SELECT topic, id FROM e WHERE topic IN (SELECT topic FROM e GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 5)")
_EDGES = ", e AS (SELECT id, unnest(refs) AS ref FROM corpus)"
_add("J08_direct_citation", lambda s, d: corpus(s, d).select("id", F.explode("references").alias("ref")).join(corpus(s, d).select(F.col("id").alias("ref")), "ref").where(F.col("id") != F.col("ref")), _EDGES + " SELECT e.ref, e.id FROM e JOIN corpus c ON c.id = e.ref WHERE e.id <> e.ref")


def _period_alignment(s: SparkSession, d: str) -> DataFrame:
    """Journals of two periods, absent ones as zero."""
    c = corpus(s, d).where(F.col("journal_name").isNotNull())
    a, b = (c.where(F.col("publication_year").between(*p)).groupBy("journal_name").agg(F.count(F.lit(1)).alias(n)) for p, n in (((2000, 2015), "n1"), ((2016, 2030), "n2")))
    return a.join(b, "journal_name", "full").select("journal_name", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))


_add("J13_period_alignment", _period_alignment, "SELECT journal_name, count(*) FILTER (WHERE publication_year BETWEEN 2000 AND 2015) AS n1, count(*) FILTER (WHERE publication_year BETWEEN 2016 AND 2030) AS n2 FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1 HAVING n1 + n2 > 0")
_add("J15_id_intersection", lambda s, d: corpus(s, d).where(F.col("publication_year") == 2018).select(F.explode("author_names").alias("a")).intersect(corpus(s, d).where(F.col("publication_year") == 2019).select(F.explode("author_names").alias("a"))), "SELECT unnest(author_names) AS a FROM corpus WHERE publication_year = 2018 INTERSECT SELECT unnest(author_names) AS a FROM corpus WHERE publication_year = 2019")


def _stitch(s: SparkSession, d: str) -> DataFrame:
    """A researcher's registry facts with the profile and its metrics."""
    from tesela.functions.ids import registry_key

    r = table(s, d, "snii_historico").select(registry_key(F.col("cvu")).alias("cvu"), "year", "nombre").where(F.col("cvu").isNotNull()).groupBy("cvu").agg(F.max("year").alias("last_year"), F.max("nombre").alias("name"))
    m = table(s, d, "snii_llm_verified_matches").select(registry_key(F.col("snii_cvu")).alias("cvu"), F.regexp_extract("matched_openalex_id", r"(A\d+)", 1).alias("id"))
    p = table(s, d, "author_profiles").groupBy("id").agg(F.max("works_count").alias("works_count"), F.max("h_index").alias("h_index"))
    return r.join(m, "cvu", "left").join(p, "id", "left").select("cvu", "name", "last_year", "works_count", "h_index").distinct()


_CVU = r"nullif(ltrim(regexp_extract(replace(regexp_replace({c}, '[.]0+\s*$', ''), ',', ''), '(\d+)', 1), '0'), '')"
_add("J17_profile_stitch", _stitch, f"WITH r AS (SELECT {_CVU.format(c='cvu')} AS cvu, max(year) AS last_year, max(nombre) AS name FROM snii_historico GROUP BY 1), m AS (SELECT {_CVU.format(c='snii_cvu')} AS cvu, regexp_extract(matched_openalex_id, '(A\\d+)', 1) AS id FROM snii_llm_verified_matches), p AS (SELECT id, max(works_count) AS works_count, max(h_index) AS h_index FROM author_profiles GROUP BY 1) SELECT DISTINCT r.cvu, name, last_year, works_count, h_index FROM r LEFT JOIN m USING (cvu) LEFT JOIN p USING (id) WHERE r.cvu IS NOT NULL", raw=True)


def _as_of(s: SparkSession, d: str) -> DataFrame:
    """As-of join of events to the user's last purchase, as one union and one window."""
    e = table(s, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("p"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("p"), F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


_add("J18_as_of", _as_of, "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events", raw=True)

# Scalar functions
_add("X01_lower_trim_length", lambda s, d: table(s, d, "author_profiles").select("id", F.lower(F.trim("display_name")).alias("n"), F.length(F.trim("display_name")).alias("len")).distinct(), "SELECT DISTINCT id, lower(trim(display_name)) AS n, CAST(length(trim(display_name)) AS INTEGER) AS len FROM author_profiles", raw=True)
_add("X02_upper_title", lambda s, d: table(s, d, "region").select(F.upper("r_name").alias("u"), F.initcap(F.lower("r_name")).alias("t")), "SELECT upper(r_name) AS u, array_to_string([upper(w[1]) || w[2:] for w in string_split(lower(r_name), ' ')], ' ') AS t FROM region", raw=True)
_add("X03_round", lambda s, d: table(s, d, "part").select("p_partkey", F.round(F.col("p_retailprice").cast("decimal(18,4)"), 1).cast("double").alias("r")), "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS r FROM part", raw=True)
_add("X04_guarded_division", lambda s, d: corpus(s, d).groupBy("journal_name").agg((F.sum("cited_by_count").cast("double") / F.greatest(F.sum(F.size("references")), F.lit(1))).alias("ratio")), "SELECT journal_name, CAST(sum(cited_by_count) AS DOUBLE) / greatest(sum(len(refs)), 1) AS ratio FROM corpus GROUP BY 1")
_add("X05_coalesce", lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce("lang", "section", F.lit("none")).alias("v")), "SELECT doc_id, coalesce(lang, section, 'none') AS v FROM documents", raw=True)
_add("X06_boolean_sum", lambda s, d: corpus(s, d).groupBy("language").agg(F.sum(F.when(F.col("oa_status") == "gold", 1).otherwise(0)).alias("n_gold")), "SELECT language, CAST(sum(CASE WHEN oa_status = 'gold' THEN 1 ELSE 0 END) AS BIGINT) AS n_gold FROM corpus GROUP BY 1")
_add("X07_aggregate_functions", lambda s, d: corpus(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_oa").alias("n_oa"), mean_of(F.when(F.col("is_oa"), F.col("fwci"))).alias("fwci_oa"), F.min("title").alias("lo"), F.max("title").alias("hi"), F.countDistinct("publisher").alias("uniq")), f"SELECT count(*) AS n, count(*) FILTER (WHERE is_oa) AS n_oa, {sql_mean('CASE WHEN is_oa THEN fwci END')} AS fwci_oa, min(title) AS lo, max(title) AS hi, count(DISTINCT publisher) AS uniq FROM corpus")
_add("X08_filter_clause", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.expr("count(*) FILTER (WHERE o_orderstatus = 'F')").alias("n_f")), "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM orders GROUP BY 1", raw=True)
_add("X09_split_last", lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("w")), "SELECT p_partkey, string_split(p_name, ' ')[-1] AS w FROM part", raw=True)
_add("X10_array_pipeline", lambda s, d: corpus(s, d).select("id", F.array_join(F.slice(F.filter(F.transform("keywords", F.upper), lambda x: F.length(x) > 8), 1, 2), " | ").alias("v")), "SELECT id, array_to_string([upper(x) for x in keywords if length(x) > 8][1:2], ' | ') AS v FROM corpus")
_add("X11_concat_distinct", lambda s, d: corpus(s, d).select("id", F.array_join(F.array_sort(F.array_distinct(F.concat("topics", "concepts"))), "|").alias("v")), "SELECT id, array_to_string(list_sort(list_distinct(list_concat(topics, concepts))), '|') AS v FROM corpus")
_add("X12_json_extract", lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k")), "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events", raw=True)
_add("X13_json_object", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", raw=True)
_add("X16_accent_key", lambda s, d: table(s, d, "author_profiles").select("id", tx.entity_key(F.col("display_name")).alias("k")).distinct(), f"SELECT DISTINCT id, {_key('display_name')} AS k FROM author_profiles", raw=True)
_add("X17_slug", lambda s, d: table(s, d, "nation").select(tx.slug(F.col("n_name")).alias("slug")), r"SELECT regexp_replace(regexp_replace(lower(trim(n_name)), '[^a-z0-9_\s-]', '', 'g'), '[\s-]+', '_', 'g') AS slug FROM nation", raw=True)


def _prioritised(s: SparkSession, d: str) -> DataFrame:
    """Listed names with those of a known kind first, otherwise in order."""
    first = F.filter("affiliations", lambda x: F.lower(x).contains("universidad"))
    rest = F.filter("affiliations", lambda x: ~F.lower(x).contains("universidad"))
    return corpus(s, d).select("id", F.array_join(F.concat(first, rest), "; ").alias("v"))


_add("X18_prioritised_list", _prioritised, "SELECT id, array_to_string(list_concat([x for x in affiliations if contains(lower(x), 'universidad')], [x for x in affiliations if not contains(lower(x), 'universidad')]), '; ') AS v FROM corpus")
_add("X19_clean_number", lambda s, d: table(s, d, "raw_records").select("record_id", tx.clean_number(F.col("py")).alias("v")).distinct(), "SELECT DISTINCT record_id, TRY_CAST(regexp_replace(py, '[%,]', '', 'g') AS DOUBLE) AS v FROM raw_records", raw=True)
_add("X20_year", lambda s, d: table(s, d, "works").select("work_id", tx.year_of(F.col("publication_date")).alias("y")).distinct(), r"SELECT DISTINCT work_id, CAST(nullif(regexp_extract(publication_date, '((?:19|20)\d\d)', 1), '') AS INTEGER) AS y FROM works", raw=True)
_add("X21_period", lambda s, d: table(s, d, "works").select(F.regexp_extract("title", r"((?:19|20)\d\d-(?:19|20)\d\d)", 1).alias("p")).where(F.col("p") != "").groupBy("p").agg(F.count(F.lit(1)).alias("n")), r"SELECT regexp_extract(title, '((?:19|20)\d\d-(?:19|20)\d\d)', 1) AS p, count(*) AS n FROM works WHERE regexp_extract(title, '((?:19|20)\d\d-(?:19|20)\d\d)', 1) <> '' GROUP BY 1", raw=True)
_add("X22_reference_key", lambda s, d: table(s, d, "works").select(F.explode("referenced_works").alias("x")).where(F.col("x").isNotNull()).select(tx.reference_key(F.col("x")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), r"SELECT CASE WHEN regexp_extract(x, '(10\.\d{4,9}/[^\s;,]+)', 1) <> '' THEN 'doi:' || lower(regexp_extract(x, '(10\.\d{4,9}/[^\s;,]+)', 1)) WHEN regexp_extract(upper(x), '(W\d{8,11})\b', 1) <> '' THEN regexp_extract(upper(x), '(W\d{8,11})\b', 1) ELSE lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) END AS k, count(*) AS n FROM (SELECT unnest(referenced_works) AS x FROM works) WHERE x IS NOT NULL GROUP BY 1", raw=True)
_CR = "SELECT id, author_names[1] || ', ' || CAST(publication_year AS VARCHAR) || ', ' || journal_name AS cr FROM corpus WHERE len(author_names) > 0 AND publication_year IS NOT NULL AND journal_name IS NOT NULL"


def _citation_strings(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).where((F.size("author_names") > 0) & F.col("publication_year").isNotNull() & F.col("journal_name").isNotNull())
    return c.select("id", F.concat_ws(", ", F.regexp_replace(F.col("author_names")[0], ",", ""), F.col("publication_year").cast("string"), "journal_name").alias("cr"))


_CRS = _CR.replace("author_names[1]", "replace(author_names[1], ',', '')")
_add("X27_citation_string", _citation_strings, _CRS)
_add("X23_wos_reference", lambda s, d: _citation_strings(s, d).select("id", tx.parse_wos_reference(F.col("cr")).alias("p")).select("id", "p.*"), f", k AS ({_CRS}), q AS (SELECT id, regexp_split_to_array(cr, ',\\s*') AS p FROM k) SELECT id, p[1] AS author, CASE WHEN regexp_full_match(p[2], '\\d{{4}}') THEN CAST(p[2] AS INTEGER) END AS year, CASE WHEN regexp_full_match(p[2], '\\d{{4}}') THEN p[3] END AS journal FROM q".replace("{{", "{").replace("}}", "}"))


def _references_in_texts(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\S+, \S+ \(\d{4}\)\. "))
    return lines.select("doc_id", tx.parse_apa_reference(F.col("line")).alias("p")).select("doc_id", "p.*")


_add("X24_apa_reference", _references_in_texts, r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, trim(regexp_extract(line, '^(.*?)\s*\(\d{4}\)', 1)) AS author, CAST(nullif(regexp_extract(line, '\((\d{4})\)', 1), '') AS INTEGER) AS year, regexp_replace(trim(regexp_extract(line, '\(\d{4}\)[.,]?\s*(.*)$', 1)), '(?i)^in:\s*', '') AS rest FROM l WHERE regexp_matches(line, '^\S+, \S+ \(\d{4}\)\. ')", raw=True)


def _unified_references(s: SparkSession, d: str) -> DataFrame:
    """One parser for both reference styles; a text of neither keeps only the collapsed text."""
    texts = _citation_strings(s, d).select(F.col("cr").alias("x")).unionAll(table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike(r"^\S+, \S+ \(\d{4}\)\. ")))
    apa, wos = tx.parse_apa_reference(F.col("x")), tx.parse_wos_reference(F.col("x"))
    return texts.select(F.when(F.col("x").rlike(r"\(\d{4}\)"), apa["year"]).otherwise(wos["year"]).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


_add("X25_unified_reference", _unified_references)
_add("X28_topic_code", lambda s, d: table(s, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d)(\d)", 1).alias("macro"), F.regexp_extract("p_brand", r"#(\d\d)", 1).alias("meso")), r"SELECT p_partkey, regexp_extract(p_brand, '#(\d)(\d)', 1) AS macro, regexp_extract(p_brand, '#(\d\d)', 1) AS meso FROM part", raw=True)


def _inverted(s: SparkSession, d: str) -> DataFrame:
    """Titles taken apart into word positions and put together again."""
    words = corpus(s, d).select("id", F.posexplode(F.split("title", " ")).alias("p", "w")).groupBy("id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return words.select("id", tx.inverted_index_text(F.col("index")).alias("title"))


_add("X29_inverted_index", _inverted, "SELECT id, title FROM corpus")
_add("X30_clean_text", lambda s, d: table(s, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean")), r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x0B\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS clean FROM documents", raw=True)
_add("X31_doi_anywhere", lambda s, d: table(s, d, "works").select("work_id", F.regexp_extract(F.coalesce("doi", "title"), r"(10\.\d{4,9}/\S+)", 1).alias("doi")).where(F.col("doi") != "").distinct(), r"SELECT DISTINCT work_id, regexp_extract(coalesce(doi, title), '(10\.\d{4,9}/\S+)', 1) AS doi FROM works WHERE regexp_extract(coalesce(doi, title), '(10\.\d{4,9}/\S+)', 1) <> ''", raw=True)
_add("X32_null_sentinel", lambda s, d: table(s, d, "snii_historico").groupBy(tx.valid(F.col("nivel")).alias("valid")).agg(F.count(F.lit(1)).alias("n")), "SELECT coalesce(lower(trim(nivel)) NOT IN ('', 'none', 'nan', '<na>', 'null'), false) AS valid, count(*) AS n FROM snii_historico GROUP BY 1", raw=True)
_add("X37_month", lambda s, d: table(s, d, "orders").select("o_orderkey", tx.month_number(F.date_format("o_orderdate", "MMM")).alias("m")), "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders", raw=True)
_add("X38_copyright_split", lambda s, d: table(s, d, "documents").select("doc_id", tx.copyright_split(F.col("text")).alias("p")).select("doc_id", "p.*"), "SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'Abstract text.' END AS text, CASE WHEN text IS NOT NULL THEN '© 2020 Publisher' END AS notice FROM documents", raw=True)


def _bib(s: SparkSession, d: str) -> DataFrame:
    """BibTeX entries of works."""
    c = corpus(s, d)
    return c.select("id", F.concat(F.lit("@article{"), "id", F.lit(", title = {"), "title", F.lit("}, year = {"), F.coalesce(F.col("publication_year").cast("string"), F.lit("")), F.lit("}}")).alias("entry"))


_add("X39_bibtex", _bib, "SELECT id, '@article{' || id || ', title = {' || title || '}, year = {' || coalesce(CAST(publication_year AS VARCHAR), '') || '}}' AS entry FROM corpus")
_add("X40_numeric_kernels", lambda s, d: table(s, d, "supplier").agg(F.round(F.avg(F.ln(F.abs("s_acctbal") + 1)), 6).alias("l"), F.round(F.avg(F.sqrt(F.abs("s_acctbal"))), 6).alias("q"), F.expr("percentile(s_acctbal, 0.5)").alias("m")), "SELECT round(avg(ln(abs(s_acctbal) + 1)), 6) AS l, round(avg(sqrt(abs(s_acctbal))), 6) AS q, median(s_acctbal) AS m FROM supplier", raw=True)

QUERIES = Q
