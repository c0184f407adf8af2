"""Registered queries of indices, laws, registry, series, ranking and set operators (A27 to A65, W, K, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions.ids import registry_key, registry_level
from tesela.operators import history
from tesela.operators import indices as ix
from tesela.plans.corpus import corpus, mean_of, share_of, sql_mean, sql_share, with_corpus
from tesela.plans.records import _P5_SQL
from tesela.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, raw: bool = False) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql if raw else with_corpus(sql)


def registry(s: SparkSession, d: str) -> DataFrame:
    """Registry snapshots: one level per researcher and year."""
    rows = table(s, d, "snii_historico").select(registry_key(F.col("cvu")).alias("cvu"), "year", registry_level(F.col("nivel")).alias("nivel"), "loaded_at")
    return history.snapshot(rows, "cvu", "year", "nivel", "loaded_at").select(F.col("key").alias("cvu"), F.col("period").alias("year"), F.col("value").alias("nivel"))


_REG = _P5_SQL[: _P5_SQL.index("\ng AS")].rstrip().rstrip(",") + "\n"

_add("A27_registry_census", lambda s, d: registry(s, d).groupBy("year", "nivel").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share_of(F.col("n"), F.sum("n").over(Window.partitionBy("year")))),
     _REG + f"SELECT year, nivel, count(*) AS n, {sql_share('count(*)', 'sum(count(*)) OVER (PARTITION BY year)')} AS pct FROM s GROUP BY 1, 2", raw=True)


def _career(s: SparkSession, d: str) -> DataFrame:
    """First and last year, span, active years, highest level and number of level changes per researcher."""
    rank = F.when(F.col("nivel") == "C", 0).when(F.col("nivel") == "E", 4).otherwise(F.col("nivel").cast("int"))
    rows = registry(s, d).withColumn("rank", rank)
    prior = F.lag("nivel").over(Window.partitionBy("cvu").orderBy("year"))
    return rows.withColumn("changed", (prior.isNotNull() & (prior != F.col("nivel"))).cast("int")).groupBy("cvu").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), (F.max("year") - F.min("year") + 1).alias("span"), F.count(F.lit(1)).alias("n_years"), F.max_by("nivel", "rank").alias("top_level"), F.sum("changed").alias("n_changes"))


_RANK = "CASE nivel WHEN 'C' THEN 0 WHEN 'E' THEN 4 ELSE CAST(nivel AS INTEGER) END"
_add("A28_career_trajectory", _career, _REG + f", t AS (SELECT *, {_RANK.replace('ELSE CAST(nivel AS INTEGER)', 'ELSE TRY_CAST(nivel AS INTEGER)')} AS rank, lag(nivel) OVER (PARTITION BY cvu ORDER BY year) AS prior FROM s) SELECT cvu, min(year) AS first_year, max(year) AS last_year, max(year) - min(year) + 1 AS span, count(*) AS n_years, max_by(nivel, rank) AS top_level, CAST(count(*) FILTER (WHERE prior IS NOT NULL AND prior <> nivel) AS BIGINT) AS n_changes FROM t GROUP BY 1", raw=True)


def _transitions(s: SparkSession, d: str) -> DataFrame:
    """Level changes by kind (promotion, demotion) and year."""
    rank = F.when(F.col("nivel") == "C", 0).when(F.col("nivel") == "E", 4).otherwise(F.col("nivel").cast("int"))
    w = Window.partitionBy("cvu").orderBy("year")
    rows = registry(s, d).withColumn("rank", rank).withColumn("prior", F.lag("rank").over(w)).where(F.col("prior").isNotNull() & (F.col("prior") != F.col("rank")))
    return rows.groupBy("year", F.when(F.col("rank") > F.col("prior"), "promotion").otherwise("demotion").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_add("W05_level_transitions", _transitions, _REG + f", t AS (SELECT year, {_RANK.replace('ELSE CAST', 'ELSE TRY_CAST')} AS rank, lag({_RANK.replace('ELSE CAST', 'ELSE TRY_CAST')}) OVER (PARTITION BY cvu ORDER BY year) AS prior FROM s) SELECT year, CASE WHEN rank > prior THEN 'promotion' ELSE 'demotion' END AS kind, count(*) AS n FROM t WHERE prior IS NOT NULL AND prior <> rank GROUP BY 1, 2", raw=True)


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """Sums by a number from 1 to 17 found in a text, all 17 rows present."""
    rows = table(s, d, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("goal"), "p_size")
    sums = rows.groupBy("goal").agg(F.sum("p_size").alias("total"))
    return s.range(1, 18).select(F.col("id").cast("int").alias("goal")).join(F.broadcast(sums), "goal", "left").select("goal", F.coalesce("total", F.lit(0)).alias("total"))


_add("A29_numbered_goals", _numbered, "WITH t AS (SELECT CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER) AS goal, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1) SELECT CAST(r.goal AS INTEGER) AS goal, coalesce(total, 0) AS total FROM (SELECT unnest(range(1, 18)) AS goal) r LEFT JOIN t USING (goal)", raw=True)


def _quadrant_rows(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).select(F.explode(F.array_distinct("affiliations")).alias("institution"), "fwci").groupBy("institution").agg(F.count(F.lit(1)).alias("n"), mean_of("fwci").alias("fwci"))
    return ix.quadrants(rows, "institution", "n", "fwci")


_add("A30_quadrants", _quadrant_rows, f", g AS (SELECT institution, count(*) AS n, {sql_mean('fwci')} AS fwci FROM (SELECT fwci, unnest(list_distinct(affiliations)) AS institution FROM corpus) GROUP BY 1), m AS (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS cut FROM g) SELECT institution, n, fwci, CASE WHEN n >= cut AND coalesce(fwci >= 1, false) THEN 'leader' WHEN n >= cut THEN 'volume' WHEN coalesce(fwci >= 1, false) THEN 'niche' ELSE 'peripheral' END AS quadrant FROM g, m")

_METRICS = ", e AS (SELECT id, cited_by_count AS c, publication_year, unnest(list_distinct(author_names)) AS author FROM corpus), r AS (SELECT *, row_number() OVER w AS r, sum(c) OVER (PARTITION BY author ORDER BY c DESC, id ROWS UNBOUNDED PRECEDING) AS cum FROM e WINDOW w AS (PARTITION BY author ORDER BY c DESC, id)), g AS (SELECT author, count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS cites, count(*) FILTER (WHERE c >= r) AS h_index, CAST(coalesce(max(r) FILTER (WHERE cum >= r * r), 0) AS INTEGER) AS g_index, count(*) FILTER (WHERE c >= 10) AS i10_index, min(publication_year) AS first_year, coalesce(sum(c) FILTER (WHERE c >= r), 0) AS core FROM r GROUP BY 1) SELECT author, n_docs, cites, h_index, g_index, i10_index, first_year, CAST(h_index AS DOUBLE) / greatest(2026 - first_year, 1) AS m_index, sqrt(CAST(core - h_index * h_index AS DOUBLE)) AS e_index FROM g"
_add("A32_author_metrics", lambda s, d: ix.author_metrics(corpus(s, d), 2026), _METRICS)
_add("A33_h_index", lambda s, d: ix.author_metrics(corpus(s, d), 2026).select("author", "h_index"), _METRICS.replace("SELECT author, n_docs, cites, h_index, g_index, i10_index, first_year, CAST(h_index AS DOUBLE) / greatest(2026 - first_year, 1) AS m_index, sqrt(CAST(core - h_index * h_index AS DOUBLE)) AS e_index FROM g", "SELECT author, h_index FROM g"))
_add("A34_g_index", lambda s, d: ix.author_metrics(corpus(s, d), 2026).select("author", "g_index"), _METRICS.replace("SELECT author, n_docs, cites, h_index, g_index, i10_index, first_year, CAST(h_index AS DOUBLE) / greatest(2026 - first_year, 1) AS m_index, sqrt(CAST(core - h_index * h_index AS DOUBLE)) AS e_index FROM g", "SELECT author, g_index FROM g"))
_add("A35_m_e_i10", lambda s, d: ix.author_metrics(corpus(s, d), 2026).select("author", "m_index", "e_index", "i10_index"), _METRICS.replace("SELECT author, n_docs, cites, h_index, g_index, i10_index, first_year, CAST", "SELECT author, i10_index, CAST"))
_add("A36_gini", lambda s, d: ix.gini(corpus(s, d), "cited_by_count"), ", o AS (SELECT cited_by_count AS x, row_number() OVER (ORDER BY cited_by_count) AS i FROM corpus WHERE cited_by_count >= 0) SELECT CAST(sum(2 * i * x) - (count(*) + 1) * sum(x) AS DOUBLE) / CAST(count(*) * sum(x) AS DOUBLE) AS gini FROM o")
_FREQ = ", a AS (SELECT count(*) AS x FROM (SELECT unnest(list_distinct(author_names)) AS a FROM corpus) GROUP BY a), f AS (SELECT x, count(*) AS y FROM a GROUP BY 1)"
_add("A37_lotka_corpus", lambda s, d: ix.lotka_fit(ix.productivity(corpus(s, d))), _FREQ + " SELECT round(-regr_slope(ln(y), ln(x)), 8) AS beta, round(exp(regr_intercept(ln(y), ln(x))), 8) AS c, count(*) AS n_points FROM f")
_add("A37_lotka_linear_r2", lambda s, d: ix.lotka_fit(ix.productivity(corpus(s, d)), "linear_r2"), _FREQ + ", k AS (SELECT -regr_slope(ln(y), ln(x)) AS b, exp(regr_intercept(ln(y), ln(x))) AS c0, count(*) AS n_points, avg(y) AS m FROM f) SELECT round(any_value(b), 8) AS beta, round(any_value(c0), 8) AS c, max(n_points) AS n_points, round(1 - sum((y - c0 * pow(x, -b)) ** 2) / sum((y - m) ** 2), 6) AS r2 FROM f, k")
_add("A37_lotka_eda", lambda s, d: ix.lotka_fit(ix.productivity(corpus(s, d)), "eda"), _FREQ + ", p AS (SELECT x, y / sum(y) OVER () AS share FROM f), k AS (SELECT least(greatest(-regr_slope(ln(share), ln(x)), 1.1), 3.5) AS b, count(*) AS n_points FROM p WHERE x <= 15) SELECT round(b, 8) AS beta, n_points, round(1 / (SELECT sum(pow(i, -b)) FROM (SELECT unnest(range(1, 101)) AS i)), 8) AS c FROM k")
_BRAD = ", j AS (SELECT journal_name, count(*) AS n FROM corpus WHERE journal_name IS NOT NULL GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, journal_name) AS INTEGER) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, journal_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM j) SELECT journal_name, n, rank, cum, " + sql_share("cum", "total") + " AS cum_pct, "
_add("A38_bradford_inner", lambda s, d: ix.bradford(corpus(s, d)), _BRAD + "CASE WHEN (cum - n) * 3 < total OR rank = 1 THEN 1 WHEN (cum - n) * 3 < total * 2 THEN 2 ELSE 3 END AS zone FROM r")
_add("A38_bradford_within", lambda s, d: ix.bradford(corpus(s, d), "within"), _BRAD + "CASE WHEN cum * 3 <= total OR rank = 1 THEN 1 WHEN cum * 3 <= total * 2 THEN 2 ELSE 3 END AS zone FROM r")
_CITED = ", x AS (SELECT publication_year AS citing, unnest(refs) AS ref FROM corpus), y AS (SELECT citing, c.publication_year AS year FROM x JOIN corpus c ON c.id = x.ref)"
_add("A39_price_immediacy", lambda s, d: ix.price_immediacy(corpus(s, d)), _CITED + f", t AS (SELECT count(*) AS n_refs, count(*) FILTER (WHERE citing - year <= 5 AND citing >= year) AS n_recent FROM y WHERE citing IS NOT NULL AND year IS NOT NULL) SELECT n_refs, n_recent, {sql_share('n_recent', 'n_refs')} AS pct, CASE WHEN {sql_share('n_recent', 'n_refs')} >= 40 THEN 'high' WHEN {sql_share('n_recent', 'n_refs')} >= 20 THEN 'medium' ELSE 'low' END AS klass FROM t")
_add("A40_price_root", lambda s, d: ix.price_root(ix.productivity(corpus(s, d))), _FREQ + f", o AS (SELECT x, row_number() OVER (ORDER BY x DESC) AS i, count(*) OVER () AS n FROM a), t AS (SELECT max(n) AS n_authors, CAST(floor(sqrt(max(n))) AS BIGINT) AS n_top, sum(x) AS works FROM o), k AS (SELECT sum(x) AS top_works FROM o, t WHERE i <= n_top) SELECT n_authors, n_top, {sql_share('top_works', 'works', 1.0)} AS share, top_works * 10 >= works * 4 AS concentrated FROM t, k")
_add("A42_annual_production", lambda s, d: ix.annual_production(corpus(s, d), 1950, 2030), f", c AS (SELECT publication_year, count(*) AS n, sum(cited_by_count) AS cites FROM corpus GROUP BY 1), y AS (SELECT CAST(unnest(range(1950, 2031)) AS INTEGER) AS publication_year), r AS (SELECT publication_year, coalesce(n, 0) AS n, CAST(coalesce(cites, 0) AS BIGINT) AS cites FROM y LEFT JOIN c USING (publication_year)), e AS (SELECT min(publication_year) AS a, max(publication_year) AS b, min_by(n, publication_year) AS na, max_by(n, publication_year) AS nb FROM r WHERE n > 0) SELECT r.*, {sql_share('cites', 'n', 1.0)} AS cites_per_work, CASE WHEN b > a THEN round(pow(CAST(nb AS DOUBLE) / na, 1.0 / (b - a)) - 1, 8) END AS cagr FROM r, e")
_SERIES = "SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS t, count(*) AS v FROM lineitem GROUP BY 1, 2"


def _series(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("t")).agg(F.count(F.lit(1)).alias("v"))


_add("A43_growth_matrix", lambda s, d: ix.growth_matrix(_series(s, d), "k", "t", "v"), f"WITH f AS ({_SERIES}), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS r FROM f), h AS (SELECT k, max_by(v, t) AS v_last, min_by(v, t) AS v_first, count(*) AS n FROM g WHERE r <= 4 GROUP BY 1), c AS (SELECT k, v_last, CASE WHEN v_first > 0 AND n > 1 THEN round(pow(CAST(v_last AS DOUBLE) / v_first, 1.0 / (n - 1)) - 1, 8) ELSE 0 END AS cagr FROM h), m AS (SELECT list_sort(list(v_last))[count(*) // 2 + 1] AS mv, list_sort(list(cagr))[count(*) // 2 + 1] AS mc FROM c) SELECT k, v_last, cagr, CASE WHEN v_last >= mv AND cagr >= mc THEN 'star' WHEN v_last >= mv THEN 'mature' WHEN cagr >= mc THEN 'emerging' ELSE 'declining' END AS quadrant FROM c, m", raw=True)
_add("A48_term_cooccurrence", lambda s, d: corpus(s, d).select("journal_name", F.explode(F.array_distinct("concepts")).alias("concept")).where(F.col("journal_name").isNotNull()).groupBy("journal_name", "concept").agg(F.count(F.lit(1)).alias("n")), "SELECT journal_name, concept, count(*) AS n FROM (SELECT journal_name, unnest(list_distinct(concepts)) AS concept FROM corpus WHERE journal_name IS NOT NULL) GROUP BY 1, 2")
_add("A54_rpys", lambda s, d: ix.rpys(corpus(s, d)), _CITED + ", c AS (SELECT year, count(*) AS n FROM y WHERE citing >= year + 2 GROUP BY 1), m AS (SELECT a.year, any_value(a.n) AS n, median(b.n) AS median FROM c a JOIN c b ON b.year BETWEEN a.year - 2 AND a.year + 2 GROUP BY 1) SELECT *, n - median AS deviation, CAST(row_number() OVER (ORDER BY n - median, year) AS INTEGER) AS rank FROM m")


def _gender(s: SparkSession, d: str) -> DataFrame:
    """Authors by the gender a small name table gives for their first given name."""
    from tesela.functions.text import GENDERS

    names = s.createDataFrame([*GENDERS.items()], "given string, gender string")
    rows = corpus(s, d).select(F.explode("author_names").alias("a")).select(F.lower(F.split(F.trim(F.regexp_extract("a", r",\s*(.*)$", 1)), " ")[0]).alias("given"))
    return rows.join(F.broadcast(names), "given", "left").groupBy(F.coalesce("gender", F.lit("unknown")).alias("gender")).agg(F.count(F.lit(1)).alias("n"))


_add("A55_gender_counts", _gender)
_add("A56_diffusion_counts", lambda s, d: corpus(s, d).select(F.col("journal_name").alias("target_journal"), F.explode("references").alias("ref")).join(corpus(s, d).select(F.col("id").alias("ref"), F.col("journal_name").alias("source_journal")), "ref").groupBy("source_journal", "target_journal").agg(F.count(F.lit(1)).alias("n")), "SELECT s.journal_name AS source_journal, t.journal_name AS target_journal, count(*) AS n FROM (SELECT journal_name, unnest(refs) AS ref FROM corpus) t JOIN corpus s ON s.id = t.ref GROUP BY 1, 2")


def _rollup(s: SparkSession, d: str) -> DataFrame:
    """Sums and weight-averaged indicators of regions over nations over suppliers."""
    n, r, sup = table(s, d, "nation"), table(s, d, "region"), table(s, d, "supplier")
    rows = sup.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("balance"))


_add("A57_hierarchical_rollup", _rollup, "SELECT r_name, n_name, count(*) AS n, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", raw=True)
_add("A58_profile_extraction", lambda s, d: corpus(s, d).select(F.explode(F.array_distinct("affiliations")).alias("entity"), "cited_by_count").groupBy("entity").agg(F.count(F.lit(1)).alias("docs"), F.sum("cited_by_count").alias("cites")).withColumn("impact", share_of(F.col("cites"), F.col("docs"), 1.0)).orderBy(F.desc("docs"), F.desc("cites"), "entity").limit(1500).withColumn("quartile", F.ntile(4).over(Window.orderBy(F.desc("docs"), F.desc("cites"), "entity"))), f", g AS (SELECT entity, count(*) AS docs, CAST(sum(cited_by_count) AS BIGINT) AS cites FROM (SELECT cited_by_count, unnest(list_distinct(affiliations)) AS entity FROM corpus) GROUP BY 1 ORDER BY docs DESC, cites DESC, entity LIMIT 1500) SELECT *, {sql_share('cites', 'docs', 1.0)} AS impact, CAST(ntile(4) OVER (ORDER BY docs DESC, cites DESC, entity) AS INTEGER) AS quartile FROM g")


def _baseline(s: SparkSession, d: str) -> DataFrame:
    """Journals per year against the baseline of all journals of the year."""
    rows = corpus(s, d).where(F.col("publication_year").isNotNull() & F.col("journal_name").isNotNull()).groupBy("journal_name", "publication_year").agg(F.count(F.lit(1)).alias("docs"))
    base = rows.groupBy("publication_year").agg(F.sum("docs").alias("baseline"))
    return rows.join(base, "publication_year").withColumn("share", share_of(F.col("docs"), F.col("baseline")))


_BASE = f"SELECT journal_name, publication_year, count(*) AS docs, CAST(sum(count(*)) OVER (PARTITION BY publication_year) AS BIGINT) AS baseline, {sql_share('count(*)', 'sum(count(*)) OVER (PARTITION BY publication_year)')} AS share FROM corpus WHERE publication_year IS NOT NULL AND journal_name IS NOT NULL GROUP BY 1, 2"
_add("A59_baseline_trend", _baseline, _BASE)
_add("J14_baseline_join", _baseline, _BASE)
_add("A60_column_statistics", lambda s, d: ix.column_statistics(table(s, d, "part"), ["p_size", "p_retailprice"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 8) AS mean, CAST(median({c}) AS DOUBLE) AS median, round(stddev_pop({c}), 6) AS std, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} = 0) AS n_zero FROM part" for c in ("p_size", "p_retailprice")), raw=True)


def _cluster_profiles(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.expr("percentile(cast(v as double), 0.5)"), 6).alias("median"), F.min(F.col("v").cast("double")).alias("min"), F.max(F.col("v").cast("double")).alias("max"), (F.count(F.lit(1)) == 1).alias("singleton"))


_add("A61_cluster_profiles", _cluster_profiles, "WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, embedding FROM embeddings) SELECT label, CAST(i AS INTEGER) AS dim, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean, round(median(CAST(embedding[i + 1] AS DOUBLE)), 6) AS median, min(CAST(embedding[i + 1] AS DOUBLE)) AS min, max(CAST(embedding[i + 1] AS DOUBLE)) AS max, count(*) = 1 AS singleton FROM e GROUP BY 1, 2", raw=True)
_add("A62_column_profiler", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile(l_quantity, array(0.0D, 0.25D, 0.5D, 0.75D, 1.0D))").alias("p")).select("l_returnflag", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))]), "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_quantity, {q}), 6) AS {n}" for q, n in ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))) + " FROM lineitem GROUP BY 1", raw=True)
_add("A62_top_frequencies", lambda s, d: corpus(s, d).groupBy("publisher").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("publisher")).limit(15), "SELECT publisher, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, publisher NULLS LAST LIMIT 15")


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Claimed numbers (orders' totals) against evidence (their line sums): within five percent or not."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).cast("decimal(18,2)")).alias("evidence"))
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("claim"))
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    off = F.abs(F.col("claim") - F.col("evidence")) * 20 < F.abs("evidence")
    return rows.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(off).alias("n_supported")).withColumn("cpr", share_of(F.col("n_supported"), F.col("n_claims"), 1.0))


_add("A63_claim_audit", _audit, f"WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice * (1 + l_tax) * (1 - l_discount) AS DECIMAL(18,2))) AS evidence FROM lineitem GROUP BY 1) SELECT count(*) AS n_claims, count(*) FILTER (WHERE abs(CAST(o_totalprice AS DECIMAL(18,2)) - evidence) * 20 < abs(evidence)) AS n_supported, {sql_share('n_supported', 'count(*)', 1.0)} AS cpr FROM orders JOIN l ON o_orderkey = l_orderkey", raw=True)
_add("A64_grounding_ratio", lambda s, d: table(s, d, "snii_llm_verified_matches").agg(F.count_if(F.col("confidence") >= 0.8).alias("supported"), F.count_if((F.col("confidence") >= 0.6) & (F.col("confidence") < 0.8)).alias("partial"), F.count(F.lit(1)).alias("total")).withColumn("ratio", share_of(F.col("supported") * 2 + F.col("partial"), F.col("total") * 2, 1.0)).withColumn("passed", F.col("ratio") >= 0.6), f"WITH t AS (SELECT count(*) FILTER (WHERE confidence >= 0.8) AS supported, count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.8) AS partial, count(*) AS total FROM snii_llm_verified_matches) SELECT *, {sql_share('supported * 2 + partial', 'total * 2', 1.0)} AS ratio, {sql_share('supported * 2 + partial', 'total * 2', 1.0)} >= 0.6 AS passed FROM t", raw=True)
_add("A65_cube", lambda s, d: table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", raw=True)
_add("A65_approx_distinct", lambda s, d: table(s, d, "lineitem").agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.countDistinct("l_partkey")) * 10 <= F.countDistinct("l_partkey")).alias("within_10_pct")), "SELECT abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) * 5 <= count(DISTINCT l_partkey) AS within_10_pct FROM lineitem", raw=True)

# Windows, ranking and series
_add("W01_share_of_total", lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share_of(F.col("n"), F.sum("n").over(Window.partitionBy()))), f"SELECT c_mktsegment, count(*) AS n, {sql_share('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM customer GROUP BY 1", raw=True)
_add("W02_row_rank", lambda s, d: table(s, d, "supplier").select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank")), "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank FROM supplier", raw=True)
_add("W03_dense_rank", lambda s, d: table(s, d, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("rank")), "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS rank FROM part", raw=True)
_add("W04_running_share", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("cum", F.sum("k").over(Window.orderBy(F.desc("n")))).withColumn("pct", share_of(F.col("cum"), F.sum("k").over(Window.partitionBy()))), f"WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), g AS (SELECT n, count(*) AS k FROM c GROUP BY 1) SELECT n, k, CAST(sum(k) OVER (ORDER BY n DESC) AS BIGINT) AS cum, {sql_share('sum(k) OVER (ORDER BY n DESC)', 'sum(k) OVER ()')} AS pct FROM g", raw=True)
_add("W06_period_delta", lambda s, d: _series(s, d).withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("t"))).withColumn("delta_pct", F.when(F.col("before").isNull(), None).when(F.col("before") == 0, 100.0).otherwise(share_of(F.col("v") - F.col("before"), F.col("before")))), f"WITH f AS ({_SERIES}), g AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY t) AS before FROM f) SELECT *, CASE WHEN before IS NULL THEN NULL WHEN before = 0 THEN 100.0 ELSE {sql_share('v - before', 'before')} END AS delta_pct FROM g", raw=True)
for _span in (3, 5):
    _a = 2.0 / (_span + 1)
    _add(f"W07_smoothing_{_span}", lambda s, d, _span=_span: ix.smooth(_series(s, d), "k", "t", "v", _span), f"WITH RECURSIVE f AS ({_SERIES}), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM f), r AS (SELECT k, t, i, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) AS y FROM o WHERE i = 1 UNION ALL SELECT o.k, o.t, o.i, CAST(o.v AS DOUBLE), {_a} * CAST(o.v AS DOUBLE) + {1 - _a} * r.y FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1) SELECT k, t, v, round(y, 8) AS smoothed FROM r", raw=True)
_add("W08_top_series", lambda s, d: _series(s, d).join(F.broadcast(_series(s, d).groupBy("k").agg(F.max_by("v", "t").alias("latest")).orderBy(F.desc("latest"), "k").limit(20).select("k")), "k", "left_semi"), f"WITH f AS ({_SERIES}), g AS (SELECT k FROM f GROUP BY 1 ORDER BY max_by(v, t) DESC, k LIMIT 20) SELECT k, t, v FROM f SEMI JOIN g USING (k)", raw=True)


def _wide_to_long(s: SparkSession, d: str) -> DataFrame:
    """Year-named columns to (entity, year, value) rows."""
    wide = table(s, d, "lineitem").withColumn("y", F.year("l_shipdate")).groupBy("l_returnflag").pivot("y", [1995, 1996, 1997]).count()
    return wide.unpivot(["l_returnflag"], ["1995", "1996", "1997"], "year", "n").where(F.col("n").isNotNull())


_add("W09_wide_to_long", _wide_to_long, "SELECT l_returnflag, CAST(year(l_shipdate) AS VARCHAR) AS year, count(*) AS n FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1997 GROUP BY 1, 2", raw=True)
_add("W10_evolution_rows", lambda s, d: _series(s, d).where(F.col("v") > 0).select(F.concat_ws("_", F.col("t").cast("string"), F.col("k").cast("string")).alias("year_entity"), "t", "v").orderBy(F.desc("t"), F.desc("v"), "year_entity"), f"WITH f AS ({_SERIES}) SELECT CAST(t AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS year_entity, t, v FROM f WHERE v > 0", raw=True)
_add("W11_centred_median", lambda s, d: _series(s, d).select("k", "t", "v", F.expr("percentile(v, 0.5)").over(Window.partitionBy("k").orderBy("t").rangeBetween(-2, 2)).alias("median")), f"WITH f AS ({_SERIES}) SELECT a.k, a.t, any_value(a.v) AS v, median(b.v) AS median FROM f a JOIN f b ON a.k = b.k AND b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY 1, 2", raw=True)


def _tumbling(s: SparkSession, d: str) -> DataFrame:
    """Windows of four years from the first; the last ends with the data, empty ones do not appear."""
    works = corpus(s, d).where(F.col("publication_year").isNotNull())
    a, b = works.agg(F.min("publication_year")).scalar(), works.agg(F.max("publication_year")).scalar()
    start = a + F.floor((F.col("publication_year") - a) / 4) * 4
    return works.groupBy(start.cast("int").alias("y_start")).agg(F.count(F.lit(1)).alias("n")).select("y_start", F.least(F.col("y_start") + 3, b).alias("y_end"), "n")


_add("W12_tumbling_years", _tumbling, ", m AS (SELECT min(publication_year) AS a, max(publication_year) AS b FROM corpus) SELECT CAST(a + ((publication_year - a) // 4) * 4 AS INTEGER) AS y_start, CAST(least(a + ((publication_year - a) // 4) * 4 + 3, b) AS INTEGER) AS y_end, count(*) AS n FROM corpus, m WHERE publication_year IS NOT NULL GROUP BY 1, 2")
_add("W13_cagr_last_k", lambda s, d: ix.growth_matrix(_series(s, d), "k", "t", "v", 5).select("k", "cagr"), f"WITH f AS ({_SERIES}), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS r FROM f), h AS (SELECT k, max_by(v, t) AS b, min_by(v, t) AS a, count(*) AS n FROM g WHERE r <= 5 GROUP BY 1) SELECT k, CASE WHEN a > 0 AND n > 1 THEN round(pow(CAST(b AS DOUBLE) / a, 1.0 / (n - 1)) - 1, 8) ELSE 0 END AS cagr FROM h", raw=True)
_add("W14_temporal_extraction", lambda s, d: ix.smooth(_series(s, d).where(F.col("k").isin(1, 2, 3)), "k", "t", "v", 3), SQL["W07_smoothing_3"].replace("FROM lineitem GROUP", "FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP"), raw=True)
_add("W15_moving_average", lambda s, d: _series(s, d).select("k", "t", F.avg("v").over(Window.partitionBy("k").orderBy("t").rowsBetween(-1, 1)).alias("ma3")), f"WITH f AS ({_SERIES}) SELECT k, t, avg(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ma3 FROM f", raw=True)
_add("W16_lead_ntile_percent_rank", lambda s, d: table(s, d, "supplier").select("s_suppkey", *[f.over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).alias(n) for n, f in (("next_key", F.lead("s_suppkey")), ("tile", F.ntile(4)), ("pr", F.percent_rank()))]), "SELECT s_suppkey, lead(s_suppkey) OVER w AS next_key, CAST(ntile(4) OVER w AS INTEGER) AS tile, percent_rank() OVER w AS pr FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)", raw=True)

# Sorting, top-k
_add("K01_order_limit", lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", raw=True)
_add("K02_multi_key_order", lambda s, d: table(s, d, "part").orderBy(F.desc("p_size"), "p_brand", "p_partkey").limit(30).select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 30", raw=True)
_add("K03_order_by_expression", lambda s, d: table(s, d, "institutions").orderBy((F.col("country_code") == "MX").desc(), (F.size(F.coalesce("acronyms", F.array())) > 0).desc(), "id").limit(40).select("id"), "SELECT id FROM institutions ORDER BY (country_code = 'MX') DESC, (len(coalesce(acronyms, [])) > 0) DESC, id LIMIT 40", raw=True)
_add("K06_argmax_row", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order")), "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_order FROM orders GROUP BY 1", raw=True)
_add("K07_most_frequent_key", lambda s, d: registry(s, d).groupBy("cvu").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "cvu")).alias("m")).select("m.cvu", "m.n"), _REG + "SELECT cvu, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, cvu DESC LIMIT 1", raw=True)
_add("K08_value_counts_head", lambda s, d: table(s, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10), "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10", raw=True)
_add("K11_peek", lambda s, d: table(s, d, "works").select("work_id").limit(1))

# Set operations
_KEYS = {"a": "SELECT DISTINCT k FROM (SELECT unnest(author_keywords) AS k FROM corpus)", "b": "SELECT DISTINCT k FROM (SELECT unnest(concepts) AS k FROM corpus)"}


def _sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(s, d)
    return c.select(F.explode("author_keywords").alias("k")).distinct(), c.select(F.explode("concepts").alias("k")).distinct()


def _set_query(op: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        a, b = _sets(s, d)
        if op == "union":
            return a.union(b).distinct()
        if op == "xor":
            return a.exceptAll(b).union(b.exceptAll(a))
        return a.intersect(b) if op == "intersect" else a.subtract(b)

    return run


for _op, _sql in (("union", "({a}) UNION ({b})"), ("intersect", "({a}) INTERSECT ({b})"), ("except", "({a}) EXCEPT ({b})"), ("xor", "(({a}) EXCEPT ({b})) UNION ALL (({b}) EXCEPT ({a}))")):
    _add(f"U01_{_op}", _set_query(_op), _sql.format(**_KEYS))


def _relations(s: SparkSession, d: str) -> DataFrame:
    a, b = _sets(s, d)
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "k", "full")
    return both.agg(F.bool_and(F.col("y").isNotNull() | F.col("x").isNull()).alias("subset"), F.bool_and(F.col("x").isNotNull() | F.col("y").isNull()).alias("superset"), F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("equal"))


_add("U02_set_relations", _relations, "SELECT bool_and(b.k IS NOT NULL OR a.k IS NULL) AS subset, bool_and(a.k IS NOT NULL OR b.k IS NULL) AS superset, bool_and(a.k IS NOT NULL AND b.k IS NOT NULL) AS equal FROM ({a}) a FULL JOIN ({b}) b ON a.k = b.k".format(**_KEYS))
_add("U03_concat", lambda s, d: table(s, d, "authorships").select("work_id").unionAll(table(s, d, "documents").select("work_id")), "SELECT work_id FROM authorships UNION ALL SELECT work_id FROM documents", raw=True)
_add("U04_chunk", lambda s, d: table(s, d, "documents").select("doc_id", F.ntile(8).over(Window.partitionBy("lang").orderBy("doc_id")).alias("chunk")), "SELECT doc_id, CAST(ntile(8) OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS chunk FROM documents", raw=True)
_add("U05_composite_dedup", lambda s, d: table(s, d, "author_profiles").groupBy("id", "orcid", F.lower(F.trim("display_name")).alias("name")).agg(F.count(F.lit(1)).alias("n")), "SELECT id, orcid, lower(trim(display_name)) AS name, count(*) AS n FROM author_profiles GROUP BY 1, 2, 3", raw=True)
_add("U06_ordered_distinct", lambda s, d: table(s, d, "works").select("work_id", "ingested_at", F.array_distinct("referenced_works").alias("r")).select("work_id", F.size("r").alias("n"), F.get("r", F.lit(0)).alias("head")).distinct(), "SELECT DISTINCT work_id, CAST(CASE WHEN referenced_works IS NULL THEN NULL ELSE len(list_distinct(referenced_works)) + CASE WHEN list_contains([x IS NULL for x in referenced_works], true) THEN 1 ELSE 0 END END AS INTEGER) AS n, referenced_works[1] AS head FROM works", raw=True)
_add("U07_field_union", lambda s, d: corpus(s, d).select("id", F.size(F.array_union("author_keywords", "concepts")).alias("n")), "SELECT id, CAST(len(list_distinct(list_concat(author_keywords, concepts))) AS INTEGER) AS n FROM corpus")
_add("U09_disambiguation", lambda s, d: table(s, d, "author_profiles").groupBy(F.lower(F.trim("display_name")).alias("name")).agg((F.countDistinct("id") > 1).alias("ambiguous")), "SELECT lower(trim(display_name)) AS name, count(DISTINCT id) > 1 AS ambiguous FROM author_profiles GROUP BY 1", raw=True)


def _groups(s: SparkSession, d: str) -> DataFrame:
    from tesela.operators.aggregates import BLOCKS

    pairs = s.createDataFrame([(c, b) for b, v in BLOCKS.items() for c in v], "country string, block string")
    return corpus(s, d).select(F.explode("countries").alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(pairs), "country").groupBy("block").agg(F.sum("n").alias("n"))


def _block_values() -> str:
    from tesela.operators.aggregates import BLOCKS

    return ", ".join(f"('{c}', '{b}')" for b, v in BLOCKS.items() for c in v)


_add("U10_overlapping_groups", _groups, f"SELECT block, count(*) AS n FROM (SELECT unnest(countries) AS country FROM corpus) JOIN (VALUES {_block_values()}) v(country, block) USING (country) GROUP BY 1")

QUERIES = Q
