"""Writers: canonical corpus, CSV, BibTeX, tagged text, graphs, and small keyed stores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks exchange: in the shared folder of ``spark.checkpoint.dir``, a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return os.path.join(base, f"tesela-{name}-{uuid.uuid4().hex}")


def save_corpus(df: DataFrame, path: str) -> None:
    """Parquet, JSON or CSV by extension (unknown: Parquet); lists become ``; `` texts in CSV."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "csv":
        df = df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif kind in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def split_by(df: DataFrame, path: str, tag: str) -> None:
    """One folder of CSV files per value of a tag."""
    df.write.mode("overwrite").partitionBy(tag).csv(path, header=True)


def ris_lines(df: DataFrame) -> DataFrame:
    """RIS text of records ``id, title, year, journal, authors, keywords``."""
    many = lambda tag, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{tag}  - "), x)), "\n")
    parts = [F.lit("TY  - JOUR"), F.concat(F.lit("ID  - "), "id"), F.concat(F.lit("TI  - "), "title"), F.concat(F.lit("PY  - "), F.col("year").cast("string")), F.concat(F.lit("JO  - "), "journal"), F.nullif(many("AU", "authors"), F.lit("")), F.nullif(many("KW", "keywords"), F.lit("")), F.lit("ER  - ")]
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def wos_lines(df: DataFrame) -> DataFrame:
    """Two-letter tagged text of records."""
    parts = [F.lit("PT J"), F.concat(F.lit("AU "), F.nullif(F.array_join("authors", "\n   "), F.lit(""))), F.concat(F.lit("TI "), "title"), F.concat(F.lit("SO "), "journal"), F.concat(F.lit("PY "), F.col("year").cast("string")), F.concat(F.lit("DE "), F.nullif(F.array_join("keywords", "; "), F.lit(""))), F.concat(F.lit("UT "), "id"), F.lit("ER\n")]
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def medline_lines(df: DataFrame) -> DataFrame:
    many = lambda tag, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{tag} - "), x)), "\n")
    parts = [F.concat(F.lit("PMID- "), "id"), F.concat(F.lit("TI  - "), "title"), F.concat(F.lit("DP  - "), F.col("year").cast("string")), F.concat(F.lit("JT  - "), "journal"), F.nullif(many("FAU", "authors"), F.lit("")), F.nullif(many("OT ", "keywords"), F.lit("")), F.lit("")]
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Edge list and node attributes as CSV."""
    edges.write.mode("overwrite").csv(f"{path}/edges", header=True)
    nodes.write.mode("overwrite").csv(f"{path}/nodes", header=True)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.csv(f"{path}/edges", header=True, inferSchema=True), spark.read.csv(f"{path}/nodes", header=True, inferSchema=True)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, per key the one with the greatest ``order``; equal orders keep the change."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_new")


def search_experiences(store: DataFrame, text: str, top: int = 10) -> DataFrame:
    """Stored entries whose value contains a text, by confidence and time."""
    return store.where(F.lower("value").contains(text.lower())).orderBy(F.desc("confidence"), F.desc("created_at")).limit(top)
