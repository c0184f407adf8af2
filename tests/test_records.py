"""Orphan references, attribute history and packed fields."""

from __future__ import annotations

import datetime as dt

import pytest

from tests.conftest import DATA, rows_of

from tesela.functions.ids import registry_key, registry_level, work_key
from tesela.operators import history, orphans, packed
from tesela.plans import records


@pytest.mark.parametrize("name", list(records.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert records.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p7_found"])
def test_nulls_repeats_and_extra_columns_change_nothing(spark, edge_dir, name):
    assert rows_of(records.QUERIES[name](spark, edge_dir)) == rows_of(records.QUERIES[name](spark, DATA))


def test_written_ids(spark):
    df = spark.createDataFrame([("W12",), ("w12 ",), ("https://x/W12",), (" ",), (None,), ("abc",)], "x string")
    assert [r[0] for r in df.select(work_key(df.x)).collect()] == ["W12", "W12", "W12", None, None, None]
    df = spark.createDataFrame([("0050",), ("CVU 50",), ("50.0",), ("5,012,345",), ("S/N",), (None,)], "x string")
    assert [r[0] for r in df.select(registry_key(df.x)).collect()] == ["50", "50", "50", "5012345", None, None]
    df = spark.createDataFrame([("SNI 1",), ("nivel dos",), ("03",), ("Cand.",), ("Investigador Emérito",), ("N2",), ("<NA>",), ("",), ("1.0",)], "x string")
    assert [r[0] for r in df.select(registry_level(df.x)).collect()] == ["1", "2", "3", "C", "E", "2", None, None, "1"]


def test_reference_states(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    kids = spark.createDataFrame([("t", str(i), k, day(5)) for i, k in enumerate(["gone", "back", "none", "late", "fine", None])], "ref_table string, record_key string, ref_key string, arrived_at timestamp")
    parents = spark.createDataFrame([("gone", day(1), day(1)), ("back", day(1), day(9)), ("late", day(8), day(8)), ("fine", day(5), day(5))], "key string, first_at timestamp, last_at timestamp")
    deleted = spark.createDataFrame([("gone", day(2)), ("back", day(2))], "key string, deleted_at timestamp")
    assert {(r.ref_key, r.state) for r in orphans.reference_states(kids, parents, deleted).collect()} == {("gone", "deleted"), ("none", "missing"), ("late", "late")}


def test_hot_key(spark):
    """A third of all rows refer to one missing key."""
    kids = spark.range(3000).selectExpr("'t' AS ref_table", "cast(id AS string) AS record_key", "if(id % 3 = 0, 'hot', cast(id AS string)) AS ref_key", "timestamp'2020-01-01' AS arrived_at")
    none = spark.createDataFrame([], "key string, first_at timestamp, last_at timestamp")
    out = orphans.reference_states(kids, none, spark.createDataFrame([], "key string, deleted_at timestamp"))
    assert out.where("ref_key = 'hot'").count() == 1000 and out.count() == 3000


def test_versions_against_plain_runs(spark):
    rows = [("a", y, v) for y, v in [(1, "x"), (2, "x"), (3, "y"), (5, "y"), (6, "x")]] + [("b", 4, "z")]
    snap = spark.createDataFrame(rows, "key string, period int, value string")
    assert rows_of(history.versions(snap)) == [("a", "x", 1, 2), ("a", "x", 6, 6), ("a", "y", 3, 3), ("a", "y", 5, 5), ("b", "z", 4, 4)]
    leaves = history.changed_leaves(history.tree(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], "key string, period int, value string"), 4, 3), 4, 3)
    assert {r.period for r in leaves.collect()} == {1, 3}


def test_only_changed_branches_are_entered(spark):
    """Of 2,000 keys three change: the comparison enters their leaves and no others, and gives the same versions at every depth."""
    rows = [(str(k), p, "y" if p == 2 and k in (5, 70, 900) else "x") for k in range(2000) for p in (1, 2)]
    snap = spark.createDataFrame(rows, "key string, period int, value string")
    entered = {r.period: (r.leaves, r.entered) for r in history.descent(snap).collect()}
    assert entered[2][1] <= 3 < entered[2][0]
    want = rows_of(history.versions(snap))
    assert len(want) == 2003 and want == rows_of(history.versions(snap, 2, 2)) == rows_of(history.versions(snap, 4, 5))


def test_report_against_states(spark):
    """The sums by month come out of the groups as they do from the single references."""
    import random

    rng = random.Random(4)
    when = lambda: dt.datetime(2020, rng.randint(1, 4), rng.randint(1, 28))
    kids = spark.createDataFrame([(rng.choice("tu"), str(i), rng.choice(["hot", *(f"k{j}" for j in range(30)), None]), when()) for i in range(1500)], "ref_table string, record_key string, ref_key string, arrived_at timestamp")
    parents = spark.createDataFrame([(f"k{j}", *sorted([when(), when()])) for j in range(20)], "key string, first_at timestamp, last_at timestamp")
    deleted = spark.createDataFrame([(f"k{j}", when()) for j in range(5, 25)], "key string, deleted_at timestamp")
    states = orphans.reference_states(kids, parents, deleted).collect()
    want: dict = {}
    for r in states:
        want.setdefault((r.ref_table, r.arrived_at.strftime("%Y-%m"), r.state), []).append(r.ref_key)
    got = {(r.ref_table, r.month, r.state): (r.n_refs, r.n_keys) for r in orphans.reference_report(kids, parents, deleted).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_snapshot_takes_the_last_load(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 1, None, 3), (None, 1, "z", 4)], "k string, p int, v string, o int")
    assert rows_of(history.snapshot(rows, "k", "p", "v", "o")) == [("a", 1, "y")]


@pytest.mark.parametrize(
    ("cell", "grammar", "values"),
    [
        ("Perez, A.; Ruiz, B. | Gil-Sol, C.", packed.AUTHORS, ["Perez, A.", "Ruiz, B.", "Gil-Sol, C."]),
        ("A. Perez, R. Luna, and Enrique Gil Sol", packed.AUTHORS, ["A. Perez", "R. Luna", "Enrique Gil Sol"]),
        ("Perez Luna, Ana and Gil-Sol, Eva Luz", packed.AUTHORS, ["Perez Luna, Ana", "Gil-Sol, Eva Luz"]),
        ('"Perez, Ana","Gil, Eva"', packed.AUTHORS, ["Perez, Ana", "Gil, Eva"]),
        ("V. Roca and A. Sol", packed.AUTHORS, ["V. Roca", "A. Sol"]),
        ("Perez, A.; and Gil, B.; ", packed.AUTHORS, ["Perez, A.", "Gil, B."]),
        ("[Perez, A.; Gil, B.] Inst X, City [Sol, C.] Inst Y, Town", packed.ADDRESSES, ["Inst X, City", "Inst Y, Town"]),
        ('"Inst X, Sec A; Floor 2, City"; Inst Y, Town;', packed.ADDRESSES, ["Inst X, Sec A; Floor 2, City", "Inst Y, Town"]),
        ("soil a/b / R&amp;D use / c (d)", packed.KEYWORDS, ["soil a/b", "R&amp;D use", "c (d)"]),
        ('"a ""b, c""", d e, "f, g"', packed.KEYWORDS, ['a "b, c"', "d e", "f, g"]),
        ("x y, z; w", packed.KEYWORDS, ["x y, z", "w"]),
        ('say "hi', packed.KEYWORDS, ['say "hi']),
        (" ; ", packed.KEYWORDS, []),
        (None, packed.KEYWORDS, []),
    ],
)
def test_packed_cells(cell, grammar, values):
    assert [v for v, _, _ in packed.split_cell(cell, grammar)] == values


def test_malformed_quote_is_flagged_and_long_cells_split():
    assert packed.split_cell('"open; b', packed.KEYWORDS)[0][2]
    assert len(packed.split_cell("; ".join(f"word {i}" for i in range(5000)), packed.KEYWORDS)) == 5000
