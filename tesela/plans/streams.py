"""Registered queries of streaming and of user-defined functions (Z)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.session import table
from tesela.streaming import windows as st

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql


def _events(s: SparkSession, d: str) -> DataFrame:
    batch = table(s, d, "events")
    return st.event_stream(s, f"{d}/event*.parquet", batch.schema)


_add("Z01_tumbling", lambda s, d: st.drain(st.windowed_counts(_events(s, d), "1 day")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_add("Z01_sliding", lambda s, d: st.drain(st.windowed_counts(_events(s, d), "2 days", "1 day")), "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1, 2")
_add("Z01_sessions", lambda s, d: st.drain(st.sessions(_events(s, d), "1 hour")), "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, i")
_add("Z01_deduplicated", lambda s, d: st.drain(st.without_repeats(_events(s, d)).select("event_id"), "append"), "SELECT DISTINCT event_id FROM events")


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.str.replace(r"(?:s|es)$", "", regex=True)


@F.pandas_udf(T.DoubleType())
def _spread(values: pd.Series) -> float:
    return float(values.max() - values.min())


_add("Z02_user_callable", lambda s, d: table(s, d, "part").select("p_partkey", _stem(F.lower("p_name")).alias("stem")), "SELECT p_partkey, regexp_replace(lower(p_name), '(?:s|es)$', '') AS stem FROM part")
_add("Z03_user_aggregate", lambda s, d: table(s, d, "part").groupBy("p_brand").agg(_spread(F.col("p_size").cast("double")).alias("spread")), "SELECT p_brand, CAST(max(p_size) - min(p_size) AS DOUBLE) AS spread FROM part GROUP BY 1")


def _table_function(s: SparkSession, d: str) -> DataFrame:
    """Words of names as rows, by a table function."""
    return table(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


_add("Z04_table_function", _table_function, "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")

QUERIES = Q
