"""The canonical corpus of works and its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.ids import work_key
from tesela.operators.current import current_rows
from tesela.session import table

_LISTS = {"authors": "author_names", "organizations": "affiliations", "keywords": "keywords", "author_keywords": "author_keywords", "concepts": "concepts", "topics": "topics"}


def _clean(name: str) -> Column:
    """Elements of an array column with runs of blanks made one and outer ones removed, without null and empty ones."""
    return F.coalesce(F.filter(F.transform(name, lambda x: F.trim(F.regexp_replace(x, "[ \\t\\u00a0]+", " "))), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def canonical(works: DataFrame) -> DataFrame:
    """Current works in the canonical schema: typed, defaulted, arrays never null."""
    columns = [c for c in works.columns if c not in ("work_id", "ingested_at")]
    rows = current_rows(works, "work_id", "ingested_at", columns)
    return rows.select(
        F.col("work_id").alias("id"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        "doi",
        "publication_year",
        "publication_date",
        "journal_name",
        "issn",
        "publisher",
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce("is_oa", F.lit(False)).alias("is_oa"),
        F.lower(F.coalesce("oa_status", F.lit("closed"))).alias("oa_status"),
        F.coalesce("apc_paid_usd", F.lit(0.0)).cast("decimal(18,2)").alias("apc_paid_usd"),
        *[_clean(a).alias(b) for a, b in _LISTS.items()],
        F.array_distinct(F.transform(_clean("countries"), F.upper)).alias("countries"),
        F.coalesce(F.array_distinct(F.filter(F.transform("referenced_works", work_key), lambda x: x.isNotNull())), F.array().cast("array<string>")).alias("references"),
        F.col("fwci").cast("decimal(18,4)").alias("fwci"),
        F.coalesce("is_top_10", F.lit(0)).alias("is_top_10"),
        "language",
        "source_harvester",
    )


def corpus(spark: SparkSession, base: str) -> DataFrame:
    return canonical(table(spark, base, "works"))


def sql_list(name: str) -> str:
    clean = r"trim(regexp_replace(x, '[ \t\x{00a0}]+', ' ', 'g'))"
    return f"coalesce([{clean} for x in {name} if x is not null and {clean} <> ''], [])"


CORPUS = (
    "WITH corpus AS (SELECT work_id AS id, trim(coalesce(title, '')) AS title, doi, publication_year, publication_date, journal_name, issn, publisher, coalesce(cited_by_count, 0) AS cited_by_count, "
    "coalesce(is_oa, false) AS is_oa, lower(coalesce(oa_status, 'closed')) AS oa_status, CAST(coalesce(apc_paid_usd, 0) AS DECIMAL(18,2)) AS apc_paid_usd, "
    + ", ".join(f"{sql_list(a)} AS {b}" for a, b in _LISTS.items())
    + ", list_sort(list_distinct([upper(x) for x in "
    + sql_list("countries")
    + r"])) AS countries, coalesce(list_distinct(['W' || regexp_extract(x, '(\d+)\s*$', 1) for x in referenced_works if x is not null and regexp_extract(x, '(\d+)\s*$', 1) <> '']), []) AS refs, "
    "CAST(fwci AS DECIMAL(18,4)) AS fwci, coalesce(is_top_10, 0) AS is_top_10, language, source_harvester "
    "FROM (SELECT DISTINCT * FROM works QUALIFY rank() OVER (PARTITION BY work_id ORDER BY ingested_at DESC) = 1))\n"
)


def with_corpus(sql: str) -> str:
    """A DuckDB query over ``corpus``; further CTEs may follow as ", name AS (...)"."""
    return CORPUS + sql


# Arithmetic that gives the same digits in both engines: exact sums and one division.
def mean_of(c: Column | str) -> Column:
    """Mean of an exact (integer or decimal) column, ignoring nulls."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def share_of(part: Column, whole: Column, factor: float = 100.0) -> Column:
    """``factor * part / whole``, null where the whole is zero."""
    return F.try_divide(part.cast("double") * F.lit(factor), whole.cast("double"))


def sql_mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"


def sql_share(part: str, whole: str, factor: float = 100.0) -> str:
    return f"CAST({part} AS DOUBLE) * {factor} / nullif(CAST({whole} AS DOUBLE), 0)"
