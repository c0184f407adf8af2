"""SQL access: corpus views, parameterised and guarded queries, table and path resolution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_ONLY = ("SELECT", "WITH", "SHOW", "DESCRIBE")


def register_corpus(spark: SparkSession, path: str, name: str = "works") -> DataFrame:
    """Registers a Parquet corpus as a temporary view and returns it."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, query: str, params: list | dict | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL query with positional or named parameters (never string interpolation) over named DataFrames."""
    return spark.sql(query, args=params, **tables) if params is not None else spark.sql(query, **tables)


def without_comments(query: str) -> str:
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.S)


def forbid_joins(query: str) -> None:
    """Raises where a query joins; unnesting array joins are allowed."""
    bare = re.sub(r"\barray\s+join\b", " ", re.sub(r"'(?:''|[^'])*'", "''", without_comments(query)), flags=re.I)
    if re.search(r"\bjoin\b", bare, re.I):
        raise ValueError("joins are not allowed here")


def guarded(spark: SparkSession, query: str, limit: int = 50, joins: bool = True, drop_vectors: bool = False, params: list | dict | None = None, **tables: DataFrame) -> DataFrame:
    """A read-only query: one statement that begins with SELECT, WITH, SHOW or DESCRIBE; ``limit`` rows unless it limits itself."""
    bare = without_comments(query).strip().rstrip(";").strip()
    if not bare.upper().startswith(READ_ONLY) or ";" in re.sub(r"'(?:''|[^'])*'", "''", bare):
        raise ValueError("only a single read-only statement is allowed")
    if not joins:
        forbid_joins(bare)
    df = run_sql(spark, bare, params, **tables)
    if drop_vectors:
        df = df.drop(*[c for c in df.columns if c.startswith("embedding") or "vector" in c])
    return df if re.search(r"\blimit\s+\d+\s*$", bare, re.I) or bare.upper().startswith(("SHOW", "DESC")) else df.limit(limit)


def resolve_table(names: list[str], wanted: str) -> str | None:
    """The table of that name, else the shortest one that ends or begins with it."""
    if wanted in names:
        return wanted
    close = [n for n in names if n.endswith(wanted) or n.startswith(wanted)]
    return min(close, key=lambda n: (len(n), n)) if close else None


def filtered_scan(df: DataFrame, contains: dict[str, str], sort_by: str | None = None, ascending: bool = True, top: int | None = None) -> DataFrame:
    """Case-insensitive substring filters, order and limit on a scan."""
    for column, text in contains.items():
        df = df.where(F.lower(column).contains(text.lower()))
    if sort_by:
        df = df.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc())
    return df.limit(top) if top else df


def resolve_path(paths: list[str], filename: str, *words: str) -> str | None:
    """Best path of a file up to three directories deep: most matching directory names, then the shortest."""
    fit = [p for p in paths if p.rsplit("/", 1)[-1] == filename and p.count("/") <= 3]
    score = lambda p: (-sum(w.lower() in p.lower() for w in words if w), len(p), p)
    return min(fit, key=score) if fit else None


def entity_by_id(df: DataFrame, identifier: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with an identifier in the first of the columns that has it."""
    tier = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(columns))):
        tier = F.when(F.col(c) == identifier, i).otherwise(tier)
    found = df.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    return found.where(F.col("_tier") == found.agg(F.min("_tier")).scalar()).drop("_tier")


def nearest_window(windows: DataFrame, year: int) -> DataFrame:
    """The window that contains a year, else the one whose bounds are nearest."""
    gap = F.greatest(F.col("y_start") - year, F.lit(year) - F.col("y_end"), F.lit(0))
    return windows.orderBy(gap, "bin_id").limit(1)
