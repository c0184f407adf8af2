"""Variants among the names of the works and profile tables (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm import names, organizations, variants
from tesela.operators.networks import components
from tesela.session import durable, release

EVIDENCE = ("topic", "country", "level", "employer")
SAME = 0.5  # mean probability at which profiles are one person


def _distinct_elements(works: DataFrame, field: str) -> DataFrame:
    return works.select(F.explode(field).alias("text")).where(F.trim("text") != "").distinct()


def author_members(spelled: DataFrame) -> DataFrame:
    """``field_name, key, cluster`` of typed author names ``name, given, family, sig``."""
    sigs = durable(spelled.groupBy("sig").agg(F.first("given").alias("given"), F.first("family").alias("family"), F.count(F.lit(1)).alias("n")), eager=True)
    clusters = variants.cluster_names(sigs)
    return spelled.join(clusters.hint("shuffle_hash"), "sig").select(F.lit("authors").alias("field_name"), F.col("name").alias("key"), "cluster")


def employers(typed: DataFrame, institutions: DataFrame) -> DataFrame:
    """``institution, employer`` (kind and place) of the distinct typed names in the column ``institution``.

    Official names written with their acronyms join the typed ones while acronyms are resolved.
    """
    typed_names = typed.select(F.col("institution").alias("key")).where(F.trim("key") != "")
    keys = organizations.organization_keys(typed_names.union(organizations.official_spellings(institutions)).distinct())
    return keys.select(F.col("key").alias("institution"), F.concat_ws("|", "kind", "place").alias("employer"))


def current_profiles(profiles: DataFrame) -> DataFrame:
    """One row per profile id, the latest; a null id drops out, rows that tie are identical."""
    fields = ["display_name", "orcid", "primary_topic", "country_code", "snii_level", "institution"]
    return profiles.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("updated_at", *fields)).alias("r")).select("id", "r.*")


def _postings(people: DataFrame) -> DataFrame:
    """``key, form, id``: what candidate pairs must have in common; ``form`` tells shortened names from equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[*names.forms(g, f), names.signature(g, f)] for g, f in zip(names.lists(batch.column(1)), names.lists(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["id", "forms"])

    partial = people.where(~F.col("complete")).select("sig").distinct()
    return people.select("id", "given", "family").mapInArrow(run, "id string, forms array<string>").select("id", F.explode("forms").alias("sig")).join(partial.hint("shuffle_hash"), "sig")


def _with_evidence(rows: DataFrame, people: DataFrame, name: str) -> DataFrame:
    """Rows ``id, name`` once per attribute that may confirm them, as ``key``."""
    attributes = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"|{c}="), F.col(c))) for c in ("orcid", "topic", "employer")]), lambda x: x.isNotNull())
    return rows.join(people.select("id", attributes.alias("attributes")).hint("shuffle_hash"), "id").select("id", F.explode("attributes").alias("a"), name).select("id", F.concat(name, "a").alias("key"))


def candidate_pairs(people: DataFrame) -> DataFrame:
    """``a, b``: profiles that may be one person, each pair once.

    Complete names meet when they are equal, however common the name is: that attributes differ is
    evidence too. An incomplete name meets the fuller ones that share an attribute; an ORCID meets itself.
    """
    full = people.where("complete").select("id", F.concat_ws(" ", F.get("given", F.lit(0)), F.get("family", F.lit(0)), F.get("family", F.lit(1))).alias("core"))
    equal = full.select("id", F.col("core").alias("key")).unionByName(people.where(F.col("orcid").isNotNull()).select("id", F.concat(F.lit("orcid="), "orcid").alias("key")))
    one = equal.select("key", F.col("id").alias("a")).join(equal.select("key", F.col("id").alias("b")), "key").where(F.col("a") < F.col("b")).select("a", "b")
    asked = _with_evidence(people.where(~F.col("complete")).select("id", "sig"), people, "sig")
    met = asked.select("key", F.col("id").alias("a")).join(_with_evidence(_postings(people), people, "sig").select("key", F.col("id").alias("b")), "key").where(F.col("a") != F.col("b"))
    return one.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "-").when(a == b, "1").otherwise("0")


def evidence(counts: list[tuple[str, str, str, int]], chance: dict[str, float]) -> dict[tuple[str, str], float]:
    """Probability of one person per kind of name agreement and pattern of attributes.

    Pairs that both have an ORCID are the labelled ones: where it is equal they are matches, else
    not. From them come the share of matches, and how often each attribute agrees among either;
    ``chance`` (how often it agrees among all) smooths the non-matches.
    """
    kinds = {k for k, _, _, _ in counts}
    prior = {}
    for kind in kinds:
        same = sum(n for k, o, _, n in counts if k == kind and o == "1")
        other = sum(n for k, o, _, n in counts if k == kind and o == "0")
        prior[kind] = (same + 1.0) / (same + other + 2.0)
    weights = []
    for i, name in enumerate(EVIDENCE):
        agree = lambda o, v, i=i: sum(n for _, x, p, n in counts if x == o and p[i] == v)
        m = (agree("1", "1") + 9.0) / (agree("1", "1") + agree("1", "0") + 10.0)
        u = (agree("0", "1") + 10.0 * chance[name]) / (agree("0", "1") + agree("0", "0") + 10.0)
        weights.append({"1": math.log(m / max(u, 1e-6)), "0": math.log((1 - m) / max(1 - u, 1e-6)), "-": 0.0})
    out = {}
    for kind, _, pattern, _ in counts:
        logit = math.log(prior[kind] / (1 - prior[kind])) + sum(w[v] for w, v in zip(weights, pattern))
        out[kind, pattern] = 1 / (1 + math.exp(-min(max(logit, -30), 30)))
    return out


def profile_members(people: DataFrame) -> DataFrame:
    """``field_name, key, cluster`` of profiles ``id, given, family, sig, orcid`` and the attributes of ``EVIDENCE``.

    Profiles that are equal in everything are one node of the graph, however many they are.
    """
    columns = ["sig", "orcid", *EVIDENCE]
    people = people.withColumn("complete", variants.complete(F.col("given"), F.col("family")))
    nodes = durable(people.groupBy(*columns).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("given").alias("given"), F.first("family").alias("family"), F.first("complete").alias("complete")), eager=True)
    pairs = candidate_pairs(nodes)
    side = lambda x: nodes.select(*[F.col(c).alias(c if c == x else f"{x}_{c}") for c in ("complete", "given", "family", "orcid", *EVIDENCE)], F.col("id").alias(x))
    both = pairs.join(side("a").hint("shuffle_hash"), "a").join(side("b").hint("shuffle_hash"), "b")
    pattern = F.concat(*[_agreement(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in EVIDENCE])
    flagged = both.select("a", "b", F.when(F.col("a_complete") & F.col("b_complete"), "complete").otherwise("partial").alias("kind"), _agreement(F.col("a_orcid"), F.col("b_orcid")).alias("o"), pattern.alias("pattern"), "a_given", "a_family", "b_given", "b_family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, f, h, e = (names.lists(batch.column(i)) for i in range(5, 9))
            fit = [names.fits(a, c) and names.fits(b, d) for a, b, c, d in zip(g, f, h, e)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(fit, pa.bool_())], ["a", "b", "kind", "o", "pattern", "fit"])

    checked = durable(flagged.mapInArrow(run, "a string, b string, kind string, o string, pattern string, fit boolean"), eager=True)
    seen = checked.where("fit").groupBy("kind", "o", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 x 3 x 81 rows
    total = nodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in EVIDENCE])).alias("x")).select("x.*").where(F.col("v").isNotNull()).groupBy("f", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    chance = dict.fromkeys(EVIDENCE, 0.5) | {r["f"]: r["c"] for r in total.groupBy("f").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("c")).collect()}
    odds = evidence([(r["kind"], r["o"], r["pattern"], r["n"]) for r in seen], chance)
    spark = people.sparkSession
    table = spark.createDataFrame([(*k, v) for k, v in odds.items()], "kind string, pattern string, p double")
    weight = F.when(F.col("o") == "1", 1.0).when((F.col("o") == "0") | ~F.col("fit"), -1.0).otherwise(F.coalesce("p", F.lit(0.0)))
    edges = durable(checked.join(F.broadcast(table), ["kind", "pattern"], "left").select("a", "b", weight.alias("weight")), eager=True)
    linked = edges.where(F.col("weight") >= SAME)
    ends = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = variants.linkage_groups(nodes.select(F.col("id").alias("node"), F.lit(1.0).alias("size")), edges, components(linked, ends), SAME, absent=False)
    label = nodes.join(groups.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").select(*columns, F.coalesce("cluster", "id").alias("cluster"))
    same = people.join(label.hint("shuffle_hash"), [people[c].eqNullSafe(label[c]) for c in columns])
    return same.select(F.lit("display_name").alias("field_name"), people["id"].alias("key"), "cluster")


def organization_members(keys: DataFrame, typed: DataFrame) -> DataFrame:
    """``field_name, key, cluster`` of the distinct strings ``institution`` in works.organizations. keys: ``institution, employer``."""
    return keys.join(typed.hint("shuffle_hash"), "institution", "left_semi").select(F.lit("organizations").alias("field_name"), F.col("institution").alias("key"), F.col("employer").alias("cluster"))


def name_members(works: DataFrame, profiles: DataFrame, institutions: DataFrame) -> DataFrame:
    """``field_name, key, cluster`` of every spelling (or profile id): linear in the rows, unlike the pairs."""
    one = durable(current_profiles(profiles), eager=True)
    typed = _distinct_elements(works, "authors").select(F.lit("authors").alias("field"), F.lit(None).cast("string").alias("id"), F.col("text").alias("name"))
    typed = typed.unionByName(one.select(F.lit("display_name").alias("field"), "id", F.col("display_name").alias("name")))
    spelled = durable(variants.split_names(typed), eager=True)
    release(spelled.sparkSession)
    organized = durable(_distinct_elements(works, "organizations").select(F.col("text").alias("institution")), eager=True)
    employer = durable(employers(one.select("institution").unionByName(organized), institutions), eager=True)
    release(spelled.sparkSession)
    attributes = one.join(employer, "institution", "left").select("id", "orcid", F.col("primary_topic").alias("topic"), F.col("country_code").alias("country"), F.col("snii_level").alias("level"), "employer")
    people = durable(spelled.where(F.col("field") == "display_name").select("id", "given", "family", "sig").join(attributes.hint("shuffle_hash"), "id"), eager=True)
    authors = author_members(spelled.where(F.col("field") == "authors"))
    release(spelled.sparkSession)
    return authors.unionByName(organization_members(employer, organized)).unionByName(profile_members(people))
