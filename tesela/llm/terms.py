"""Frequency of every distinct term of array fields, with frequency bounds (problem 3)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD, _ELEMENT = "\ufffe", "\uffff"  # non-characters: no text holds them


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normal_terms(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with each array field replaced by its normal terms, in order, repeats kept.

    A term is the element in Unicode NFC, lower case, runs of blanks, tabs and no-break
    spaces made one blank, outer ones removed; null and empty elements drop out, a null
    array becomes empty. Only rows with characters from U+0300 on (all below are stable
    under NFC) pass through Python, in one string per row.
    """
    packed = F.concat_ws(_FIELD, *[F.coalesce(F.array_join(F.filter(f, lambda x: x.isNotNull()), _ELEMENT), F.lit("")) for f in fields])
    df = df.withColumn("_packed", packed)
    suspect = F.col("_packed").rlike(f"[^\\u0000-\\u02ff{_FIELD}{_ELEMENT}]")
    df = df.withColumn("_packed", F.coalesce(_nfc(F.when(suspect, F.col("_packed"))), F.col("_packed")))
    parts = F.split(F.lower("_packed"), _FIELD)

    def terms(i: int) -> Column:
        clean = F.transform(F.split(parts[i], _ELEMENT), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\u00a0]+", " ")))
        return F.filter(clean, lambda x: x != "")

    return df.withColumns({f: terms(i) for i, f in enumerate(fields)}).drop("_packed")


def term_frequencies(records: DataFrame, fields: list[str]) -> DataFrame:
    """``field_name, term, n_occurrences, n_records`` of normal-term arrays.

    Each record emits its sorted terms with a flag on the first of equal ones; the sums
    combine by hash on the map side before the shuffle, so a term that every record has
    costs one row per task.
    """

    def flagged(field: str) -> Column:
        ordered = F.sort_array(F.col(field))
        return F.transform(ordered, lambda x, i: F.struct(F.lit(field).alias("field_name"), x.alias("term"), F.coalesce(x != F.get(ordered, i - 1), F.lit(True)).alias("first")))

    rows = records.select(F.explode(F.concat(*[flagged(f) for f in fields])).alias("t")).select("t.*")
    return rows.groupBy("field_name", "term").agg(F.count(F.lit(1)).alias("n_occurrences"), F.sum(F.col("first").cast("long")).alias("n_records"))


def mark_terms(frequencies: DataFrame, n_records: Column, rare_below: int = 3, common_share: float = 1 / 20) -> DataFrame:
    """Adds ``mark``: rare (in fewer than ``rare_below`` records), common (in more than the share), else null."""
    common = F.col("n_records") > n_records * F.lit(common_share)
    return frequencies.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(common, "common"))
