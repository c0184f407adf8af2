"""Registered queries against DuckDB on the smallest tables, and the shape of the registry."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import DATA

from tesela.plans import registry

NAMES = [n for n in ("A01_yearly_series", "A12_two_period_growth", "A13_collaboration_matrix", "A32_author_metrics", "A36_gini", "A38_bradford_inner", "A40_price_root", "A54_rpys", "F10_name_permutations", "G03_coupling_fractional", "G22_statistics", "J04_names_in_arrays", "J18_as_of", "K04_knn_euclidean", "M02_robust", "S16_ris", "S17_wos_text", "S35_medline", "S21_works_json", "T04_relevance", "T06_thesaurus", "U01_xor", "W07_smoothing_3", "W11_centred_median", "X29_inverted_index", "Z01_sliding", "Z01_sessions", "p2_report", "p5_found")]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(float(v)) if type(v).__name__ == "Decimal" else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    got = table(df.collect(), df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(cur.fetchall(), names)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
