"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import entities, linkage, packing, pairs, quality, terms, tokens, variants
from tesela.operators.current import current_rows
from tesela.session import durable, table


def _n_works(spark: SparkSession, base: str) -> Column:
    return table(spark, base, "works").agg(F.countDistinct("work_id").alias("n")).scalar()


def _current_terms(spark: SparkSession, base: str, fields: list[str]) -> DataFrame:
    works = table(spark, base, "works").select("work_id", "ingested_at", *fields)
    return terms.normal_terms(current_rows(works, "work_id", "ingested_at", fields), fields)


_P3 = ["keywords", "author_keywords"]


def _p3(spark: SparkSession, base: str) -> DataFrame:
    return terms.mark_terms(terms.term_frequencies(_current_terms(spark, base, _P3), _P3), _n_works(spark, base))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return _p3(spark, base).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p3_terms(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct term with occurrences, works and mark."""
    return _p3(spark, base)


_P4 = ["author_keywords", "concepts", "countries"]


def _p4(spark: SparkSession, base: str, min_pair: int) -> DataFrame:
    records = durable(_current_terms(spark, base, _P4), eager=True)
    return pairs.pair_counts(records, "work_id", _P4, min_pair)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs found in five works or more and at least three times as often as chance."""
    found = _p4(spark, base, 5).where(F.col("n_ab") * _n_works(spark, base) >= 3 * F.col("n_a") * F.col("n_b"))
    return found.select("field_name", "item_a", "item_b")


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    """All pairs found in the same work, with count, lift and odds ratio."""
    return pairs.association(_p4(spark, base, 1), _n_works(spark, base))


def p10_stats(spark: SparkSession, base: str) -> DataFrame:
    """Statistics, label shares and form of every document."""
    return quality.quality(table(spark, base, "documents"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that are mainly not natural prose."""
    return p10_stats(spark, base).where(F.col("form") != "prose").select("doc_id", "form")


def p1_members(spark: SparkSession, base: str) -> DataFrame:
    """Every spelling (or profile id) with the entity it denotes, one row each."""
    return entities.name_members(table(spark, base, "works"), table(spark, base, "author_profiles"), table(spark, base, "institutions"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of spellings (or profile ids) of one person or organization."""
    return variants.cluster_pairs(durable(p1_members(spark, base), eager=True))


def p6_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Registry numbers and profiles of one researcher, with confidence."""
    pairs = linkage.link(table(spark, base, "snii_historico"), table(spark, base, "author_profiles"), table(spark, base, "institutions"))
    return pairs.select("cvu", "author_id", "confidence")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Registry numbers and profiles of one researcher."""
    return p6_pairs(spark, base).select("cvu", "author_id")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level vocabulary."""
    return tokens.encode_documents(table(spark, base, "documents"))


CAPACITY = 2048


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    """Container and order of every document or piece, sizes in tokens of the 50k vocabulary."""
    sizes = durable(tokens.encode_documents(table(spark, base, "documents"), counts_only=True), eager=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p9_containers(spark, base), CAPACITY)


_TERMS = r"""
WITH cur AS (SELECT DISTINCT work_id, {cols} FROM works QUALIFY rank() OVER (PARTITION BY work_id ORDER BY ingested_at DESC) = 1),
raw AS ({raw}),
t AS (SELECT field_name, work_id, trim(regexp_replace(lower(nfc_normalize(x)), '[ \t\x{{00a0}}]+', ' ', 'g')) AS term FROM raw WHERE x IS NOT NULL),
n AS (SELECT count(DISTINCT work_id) AS n FROM works)
"""


def _terms_sql(fields: list[str]) -> str:
    return _TERMS.format(cols=", ".join(fields), raw=" UNION ALL ".join(f"SELECT '{f}' AS field_name, work_id, unnest({f}) AS x FROM cur" for f in fields))


_P3_SQL = _terms_sql(_P3) + """, f AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT work_id) AS n_records FROM t WHERE term <> '' GROUP BY 1, 2),
m AS (SELECT f.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 20 > n.n THEN 'common' END AS mark FROM f, n)
"""
_P4_SQL = _terms_sql(_P4) + """, d AS (SELECT DISTINCT field_name, work_id, term FROM t WHERE term <> ''),
c AS (SELECT field_name, term, count(*) AS n FROM d GROUP BY 1, 2),
ab AS (SELECT a.field_name, a.term AS item_a, b.term AS item_b, count(*) AS n_ab FROM d a JOIN d b ON a.field_name = b.field_name AND a.work_id = b.work_id AND a.term < b.term GROUP BY 1, 2, 3 HAVING count(*) >= 5),
p AS (SELECT ab.field_name, item_a, item_b, ca.n AS n_a, cb.n AS n_b, n_ab, n.n FROM ab JOIN c ca ON ca.field_name = ab.field_name AND ca.term = item_a JOIN c cb ON cb.field_name = ab.field_name AND cb.term = item_b, n)
"""

QUERIES = {
    "p1_found": p1_found, "p1_members": p1_members,
    "p3_found": p3_found, "p3_terms": p3_terms, "p4_found": p4_found, "p4_pairs": p4_pairs,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
}
SQL = {
    "p3_found": _P3_SQL + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": _P3_SQL + "SELECT field_name, term, n_occurrences, n_records, mark FROM m",
    "p4_found": _P4_SQL + "SELECT field_name, item_a, item_b FROM p WHERE n_ab * n >= 3 * n_a * n_b",
    "p4_pairs": _P4_SQL + "SELECT field_name, item_a, item_b, n_a, n_b, n_ab, n_ab * n / (n_a * n_b) AS lift, ((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)) AS odds_ratio FROM p",
}
