"""Current rows of a table that is delivered repeatedly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns`` of each key's row with the greatest ``order``.

    Rows that tie are taken to be identical. Rows with a null key are dropped. The
    aggregation is partial before the shuffle, so repeats of one key never gather, and
    each column is its own aggregate, so columns that a query does not use are not read.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])
