"""References to records that are missing, deleted or arrive later (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_states(children: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """State of every reference that is not in order.

    children: ``ref_table, record_key, ref_key, arrived_at`` (one row per reference and record;
    repeats collapse). parents: ``key, first_at, last_at`` (one row per key). deleted: ``key, deleted_at``.
    Returns the children that are cases with ``state``:

    * ``deleted``: the key is in deleted and no parent row came after the deletion,
    * ``missing``: otherwise, no parent row at all,
    * ``late``: otherwise, the first parent row came after the referring record.

    Parent, deletion and child keys are tagged and united in long form, one partial
    aggregation per key yields the flags (a key that holds a third of all rows is
    one row per task after the map side), and only keys that can be cases meet the
    children again. Null keys are no references. Empty inputs give an empty result.
    """
    ts = "timestamp"
    none = F.lit(None).cast(ts)
    tagged = (
        parents.select("key", F.lit(True).alias("is_parent"), F.col("first_at").cast(ts).alias("first_at"), F.col("last_at").cast(ts).alias("last_at"), none.alias("deleted_at"), none.alias("child_at"))
        .unionByName(deleted.select("key", F.lit(False).alias("is_parent"), none.alias("first_at"), none.alias("last_at"), F.col("deleted_at").cast(ts).alias("deleted_at"), none.alias("child_at")))
        .unionByName(children.select(F.col("ref_key").alias("key"), F.lit(False).alias("is_parent"), none.alias("first_at"), none.alias("last_at"), none.alias("deleted_at"), F.col("arrived_at").cast(ts).alias("child_at")))
        .where(F.col("key").isNotNull())
    )
    flags = tagged.groupBy("key").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max("deleted_at").alias("deleted_at"),
        F.min("child_at").alias("child_at"),
        F.count("child_at").alias("n_children"),
    )
    gone = F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last_at") > F.col("deleted_at"), F.lit(False))
    suspects = flags.select(
        "key", "first_at", F.when(gone, "deleted").when(~F.col("has_parent"), "missing").alias("hard_state"), "child_at", "n_children"
    ).where((F.col("n_children") > 0) & (F.col("hard_state").isNotNull() | (F.col("first_at") > F.col("child_at"))))
    cases = children.join(suspects.select(F.col("key").alias("ref_key"), "first_at", "hard_state"), "ref_key")
    state = F.coalesce(F.col("hard_state"), F.when(F.col("first_at") > F.col("arrived_at"), "late"))
    return cases.select("ref_table", "record_key", F.col("ref_key").alias("ref_key"), "arrived_at", state.alias("state")).where(F.col("state").isNotNull())


def reference_report(children: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """``ref_table, month, state, n_refs, n_keys``: orphan references per referring table and month of arrival.

    Inputs as of ``reference_states``. Children are first counted per key, table and month; parents,
    deletions and these counts then meet in long form, and a group without a parent in order gives its
    counts as they are: a key that holds a third of all rows is some dozens of counts. Only months in
    which the parent itself arrived are looked up again in the children.
    """
    month = F.date_format("arrived_at", "yyyy-MM")
    counted = children.where(F.col("ref_key").isNotNull()).groupBy(F.col("ref_key").alias("key"), "ref_table", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("arrived_at").cast("timestamp").alias("lo"), F.max("arrived_at").cast("timestamp").alias("hi"))
    ts = lambda c=None: (F.lit(None) if c is None else F.col(c)).cast("timestamp")
    count = F.struct("ref_table", "month", "n", "lo", "hi")
    kind = counted.select(count.alias("c")).schema["c"].dataType
    none = F.lit(None).cast(kind).alias("c")
    tagged = (
        parents.select("key", F.lit(True).alias("is_parent"), ts("first_at").alias("first_at"), ts("last_at").alias("last_at"), ts().alias("deleted_at"), none)
        .unionByName(deleted.select("key", F.lit(False).alias("is_parent"), ts().alias("first_at"), ts().alias("last_at"), ts("deleted_at").alias("deleted_at"), none))
        .unionByName(counted.select("key", F.lit(False).alias("is_parent"), ts().alias("first_at"), ts().alias("last_at"), ts().alias("deleted_at"), count.alias("c")))
        .where(F.col("key").isNotNull())
    )
    groups = tagged.groupBy("key").agg(F.max("is_parent").alias("has_parent"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("deleted_at").alias("deleted_at"), F.collect_list("c").alias("cs"))
    gone = F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last_at") > F.col("deleted_at"), F.lit(False))
    each = groups.select("key", "first_at", F.when(gone, "deleted").when(~F.col("has_parent"), "missing").alias("hard"), F.explode("cs").alias("c")).select("key", "first_at", "hard", "c.*")
    whole = each.where(F.col("hard").isNotNull() | (F.col("hi") < F.col("first_at"))).select("ref_table", "month", F.coalesce("hard", F.lit("late")).alias("state"), "n")
    mixed = each.where(F.col("hard").isNull() & (F.col("lo") < F.col("first_at")) & (F.col("hi") >= F.col("first_at"))).select("key", "ref_table", "month", "first_at")
    again = children.select(F.col("ref_key").alias("key"), "ref_table", "arrived_at", month.alias("month")).join(mixed, ["key", "ref_table", "month"]).where(F.col("arrived_at") < F.col("first_at"))
    late = again.groupBy("key", "ref_table", "month").agg(F.count(F.lit(1)).alias("n")).select("ref_table", "month", F.lit("late").alias("state"), "n")
    return whole.unionByName(late).groupBy("ref_table", "month", "state").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
