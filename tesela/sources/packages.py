"""Indicator packages: classification of files by name, inventories, and tabular readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words in file or folder names and the unit they mean.
UNITS = {"author": "authors", "researcher": "authors", "autor": "authors", "institution": "institutions", "organization": "institutions", "organizacion": "institutions", "country": "countries", "location": "countries", "pais": "countries", "journal": "journals", "source": "journals", "revista": "journals", "topic": "topics", "area": "topics", "funder": "funders", "funding": "funders", "works": "works", "documents": "works"}


def period_of(name: str) -> str | None:
    """``YYYY-YYYY`` or ``YYYY`` in a file name."""
    m = re.search(r"((?:19|20)\d\d)\s*[-_]\s*((?:19|20)\d\d)", name) or re.search(r"((?:19|20)\d\d)", name)
    return "-".join(m.groups()) if m else None


def classify(path: str) -> tuple[str | None, str]:
    """Unit and slot of a package file: Whole, 5Years, Trend, PerformanceMatrix or a period."""
    low = path.lower()
    unit = next((u for w, u in UNITS.items() if w in low), None)
    slot = "Trend" if "trend" in low else "PerformanceMatrix" if "matrix" in low or "performance" in low else period_of(path) or "Whole"
    return unit, slot


def inventory(paths: list[str]) -> dict[str, dict[str, str]]:
    """Unit -> slot -> path; the latest period becomes 5Years, CSV is preferred over Parquet, baselines go apart."""
    out: dict[str, dict[str, str]] = {}
    order = {"csv": 0, "tsv": 1, "parquet": 2}
    for p in sorted(paths, key=lambda x: (order.get(x.rsplit(".", 1)[-1], 3), x)):
        unit, slot = classify(p)
        if unit:
            out.setdefault(unit + ("_baseline" if re.search("baseline|corpus", p, re.I) else ""), {}).setdefault(slot, p)
    for slots in out.values():
        periods = sorted(s for s in slots if re.match(r"\d{4}-\d{4}$", s))
        if periods:
            slots["5Years"] = slots.pop(periods[-1])
    return out


def numeric_columns(df: DataFrame, least: float = 0.5) -> DataFrame:
    """String columns of which at least half of the values are numbers (after ``%`` and thousands commas drop) as doubles."""
    cleaned = {c: F.regexp_replace(c, "[%,]", "").try_cast("double") for c in df.columns}
    share = df.agg(*[(F.count(v) / F.greatest(F.count(F.when(F.trim(c) != "", 1)), F.lit(1))).alias(c) for c, v in cleaned.items()]).collect()[0]
    return df.select(*[(cleaned[c] if (share[c] or 0) >= least else F.col(c)).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A package table: Parquet, or text with the delimiter and header line found by counting delimiters in the first lines."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    sep = max(",;\t", key=lambda s: max((h.count(s) for h in head), default=0))
    width = max((h.count(sep) for h in head), default=0)
    header = next((h for h in head if h.count(sep) == width), "")
    names = [n.strip('"﻿ ') or f"c{i}" for i, n in enumerate(header.split(sep))]
    rows = spark.read.text(path).where((F.length(F.col("value")) > 0) & (F.col("value") != header) & (F.length("value") - F.length(F.replace("value", F.lit(sep))) >= width))
    parsed = rows.select(F.from_csv("value", ", ".join(f"`{i}` string" for i in range(len(names))), {"sep": sep}).alias("r"))
    return numeric_columns(parsed.select(*[F.col(f"r.`{i}`").alias(n) for i, n in enumerate(names)]))


def longitudinal(tables: dict[str, DataFrame], label: str) -> DataFrame:
    """Tables of several periods aligned to the columns of the first, as long rows ``period, label, indicator, value``."""
    out, base = None, None
    for period in sorted(tables):
        df = tables[period]
        base = base or [c for c, t in df.dtypes if c != label and t in ("double", "int", "bigint")]
        wide = df.select(F.lit(period).alias("period"), F.col(label).alias("label"), *[(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in base])
        long = wide.unpivot(["period", "label"], base, "indicator", "value")
        out = long if out is None else out.unionByName(long)
    return out
