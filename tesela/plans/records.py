"""Queries of the general record problems: orphan references (2), history (5), packed fields (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.ids import registry_key, registry_level, work_key
from tesela.operators import history, orphans, packed
from tesela.session import table


def _reference_inputs(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    works = table(spark, base, "works").select(work_key(F.col("work_id")).alias("key"), F.col("work_id").alias("record_key"), "referenced_works", "ingested_at")
    parents = works.groupBy("key").agg(F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")).where(F.col("key").isNotNull())
    cited = F.array_distinct(F.transform("referenced_works", work_key))
    firsts = works.groupBy("record_key").agg(F.min("ingested_at").alias("arrived_at"))
    lists = works.select("record_key", F.array_sort(F.filter(cited, lambda x: x.isNotNull())).alias("refs")).where(F.size("refs") > 0).distinct()
    from_works = lists.join(firsts, "record_key").select("record_key", "arrived_at", F.explode("refs").alias("ref_key")).dropDuplicates(["record_key", "ref_key"])

    def flat(name: str, key: str) -> DataFrame:
        rows = table(spark, base, name).select(F.col(key).cast("string").alias("record_key"), work_key(F.col("work_id")).alias("ref_key"), "ingested_at")
        seen = rows.groupBy("record_key").agg(F.min("ingested_at").alias("arrived_at"), F.collect_set("ref_key").alias("refs"))
        return seen.select("record_key", "arrived_at", F.explode("refs").alias("ref_key"))

    children = None
    for name, rows in (("works", from_works), ("authorships", flat("authorships", "authorship_id")), ("documents", flat("documents", "doc_id"))):
        part = rows.select(F.lit(name).alias("ref_table"), "record_key", "ref_key", "arrived_at").where(F.col("record_key").isNotNull())
        children = part if children is None else children.unionByName(part)
    deleted = table(spark, base, "deleted_works").select(work_key(F.col("work_id")).alias("key"), "deleted_at")
    return children, parents, deleted


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every reference to a missing, deleted or later work, with its state."""
    states = orphans.reference_states(*_reference_inputs(spark, base))
    return states.select("ref_table", "record_key", F.col("ref_key").alias("ref_work_id"), "state")


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references counted per table, month of the record's arrival and state."""
    return orphans.reference_report(*_reference_inputs(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Versions of a researcher's level with first and last year of validity."""
    rows = table(spark, base, "snii_historico").select(registry_key(F.col("cvu")).alias("cvu"), "year", registry_level(F.col("nivel")).alias("nivel"), "loaded_at")
    runs = history.versions(history.snapshot(rows, "cvu", "year", "nivel", "loaded_at"))
    return runs.select(F.col("key").alias("cvu"), F.col("value").alias("nivel"), F.col("valid_from").cast("int").alias("valid_from"), F.col("valid_to").cast("int").alias("valid_to"))


def p5_descent(spark: SparkSession, base: str) -> DataFrame:
    """Leaf buckets per year and how many of them the comparison enters."""
    rows = table(spark, base, "snii_historico").select(registry_key(F.col("cvu")).alias("cvu"), "year", registry_level(F.col("nivel")).alias("nivel"), "loaded_at")
    return history.descent(history.snapshot(rows, "cvu", "year", "nivel", "loaded_at"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """One row per author, address or keyword of a raw record, with its position."""
    values = packed.split_fields(table(spark, base, "raw_records"), "record_id", packed.GRAMMARS)
    return values.select("record_id", "field_name", "item_no", "item_value")


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    """Cells, values and malformed values per field."""
    return packed.field_report(packed.split_fields(table(spark, base, "raw_records"), "record_id", packed.GRAMMARS))


_P2_BASE = r"""
WITH w AS (SELECT 'W' || regexp_extract(work_id, '(\d+)\s*$', 1) AS k, work_id, referenced_works, ingested_at FROM works),
p AS (SELECT k, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM w GROUP BY k),
kids AS (
  SELECT 'works' AS ref_table, work_id AS record_key, arrived_at, x AS written FROM
    (SELECT work_id, unnest(referenced_works) AS x, min(ingested_at) OVER (PARTITION BY work_id) AS arrived_at FROM works)
  UNION ALL SELECT 'authorships', CAST(authorship_id AS VARCHAR), min(ingested_at) OVER (PARTITION BY authorship_id), work_id FROM authorships
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), min(ingested_at) OVER (PARTITION BY doc_id), work_id FROM documents),
c AS (SELECT DISTINCT ref_table, record_key, arrived_at, 'W' || regexp_extract(written, '(\d+)\s*$', 1) AS ref_work_id
      FROM kids WHERE regexp_extract(written, '(\d+)\s*$', 1) <> ''),
s AS (SELECT c.*, CASE WHEN d.work_id IS NOT NULL AND (p.last_at IS NULL OR p.last_at <= d.deleted_at) THEN 'deleted'
                       WHEN p.k IS NULL THEN 'missing' WHEN p.first_at > c.arrived_at THEN 'late' END AS state
      FROM c LEFT JOIN p ON p.k = c.ref_work_id LEFT JOIN deleted_works d ON d.work_id = c.ref_work_id)
"""

_P5_SQL = r"""
WITH r AS (SELECT nullif(ltrim(regexp_extract(replace(regexp_replace(cvu, '[.]0+\s*$', ''), ',', ''), '(\d+)', 1), '0'), '') AS cvu, year, loaded_at,
  strip_accents(lower(trim(nivel))) AS t FROM snii_historico),
l AS (SELECT cvu, year, loaded_at, CASE WHEN t = 'c' OR t LIKE 'cand%' THEN 'C'
  WHEN t IN ('1','01','1.0','i','n1','uno') OR regexp_matches(t, '^(nivel|sni)\s+(1|i|uno)$') THEN '1'
  WHEN t IN ('2','02','2.0','ii','n2','dos') OR regexp_matches(t, '^(nivel|sni)\s+(2|ii|dos)$') THEN '2'
  WHEN t IN ('3','03','3.0','iii','n3','tres') OR regexp_matches(t, '^(nivel|sni)\s+(3|iii|tres)$') THEN '3'
  WHEN t = 'e' OR t LIKE '%emerit%' THEN 'E' END AS nivel FROM r),
s AS (SELECT cvu, year, max_by(nivel, loaded_at) AS nivel FROM l WHERE cvu IS NOT NULL AND nivel IS NOT NULL AND year IS NOT NULL GROUP BY cvu, year),
g AS (SELECT *, year - row_number() OVER (PARTITION BY cvu, nivel ORDER BY year) AS island FROM s)
SELECT cvu, nivel, CAST(min(year) AS INTEGER) AS valid_from, CAST(max(year) AS INTEGER) AS valid_to FROM g GROUP BY cvu, nivel, island
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_descent": p5_descent, "p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p2_found": _P2_BASE + "SELECT ref_table, record_key, ref_work_id, state FROM s WHERE state IS NOT NULL",
    "p2_report": _P2_BASE + "SELECT ref_table, strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m') AS month, state, count(*) AS n_refs, count(DISTINCT ref_work_id) AS n_keys FROM s WHERE state IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": _P5_SQL,
}
