"""What typed names of organizations denote, learned from the names themselves (problem 1).

A name is a head ("Universidad Autonoma de", "Univ. Auton.", "Autonomous University of") and the
word that identifies, mostly a place. Heads of one kind stand with the same identifying words, in
whatever language or abbreviation: they are grouped by average linkage over the cosine of their
weighted character n-grams and over the words they stand with. Acronyms follow the names they are
written beside, and the stem that the acronyms of a kind share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm import names, sparse, variants
from tesela.session import durable

HEAD_COSINE = 0.12  # of heads (n-grams and identifying words together) that are compared at all
HEAD_LINKAGE = 0.33  # mean similarity at which kinds still merge


def spelled_pieces(typed: DataFrame) -> DataFrame:
    """``key, piece, text, acronym, alias`` of typed names ``key``: pieces between commas with their words repaired; ``piece`` is -1 for a name of an acronym alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [names.organization_pieces(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["key", "pieces", "acronym", "alias"])

    split = durable(typed.select("key").where(F.col("key").isNotNull()).distinct().mapInArrow(run, "key string, pieces array<string>, acronym string, alias string"), eager=True)
    rows = split.select("key", "acronym", "alias", F.posexplode_outer("pieces").alias("piece", "text")).select("key", "acronym", "alias", F.coalesce("piece", F.lit(-1)).alias("piece"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "word"))
    words = durable(rows.where(F.col("word") != "").groupBy("word").agg(F.countDistinct("key").alias("n")), eager=True)
    fixes = variants.repair_words(words.select(F.lit("organization").alias("space"), "word", "n")).select("word", "fixed")
    fixed = rows.join(fixes, "word", "left").withColumn("word", F.coalesce("fixed", "word"))
    text = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]))
    return durable(fixed.groupBy("key", "piece", "acronym", "alias").agg(text.alias("text")), eager=True)


def heads_and_places(pieces: DataFrame) -> DataFrame:
    """``key, alias, head, place`` of names that are no acronyms.

    The identifying word is the one at the end of a piece; of several pieces, that which is mostly at
    an end and stands beside the fewest different ends of other pieces (units such as a campus or a
    faculty stand beside very many). Its head is what stands before it, else the other piece that is most often
    a head elsewhere; all else is a unit and drops out.
    """
    tail = F.element_at(F.split("text", " "), -1)
    head = F.trim(F.regexp_replace("text", r"\S+$", ""))
    ends = pieces.where((F.col("acronym") == "") & (F.col("text") != "")).select("key", "alias", "piece", "text", tail.alias("tail"), head.alias("head"))
    n = ends.groupBy("tail").agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(F.explode(F.split("text", " ")).alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("every"))
    n = n.join(every.hint("shuffle_hash"), "tail").select("tail", "n", (F.col("every") > 2 * F.col("n")).alias("inner"))
    other = ends.select("key", F.col("tail").alias("other"))
    partners = ends.join(other.hint("shuffle_hash"), "key").where(F.col("tail") != F.col("other")).groupBy("tail").agg(F.count_distinct("other").alias("partners"))
    ranked = ends.join(n.hint("shuffle_hash"), "tail").join(partners.hint("shuffle_hash"), "tail", "left").withColumn("rank", F.struct("inner", F.coalesce("partners", F.lit(0)), "n", "piece"))
    best = ranked.groupBy("key", "alias").agg(F.min_by(F.struct("piece", "tail", "head"), "rank").alias("b"))
    attached = ends.where(F.col("head") != "").groupBy("head").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("head", "text")
    beside = best.where(F.col("b.head") == "").join(ends.select("key", "piece", "text").hint("shuffle_hash"), "key").where(F.col("piece") != F.col("b.piece")).join(attached.hint("shuffle_hash"), "text").groupBy("key").agg(F.max_by("text", F.struct("times", "text")).alias("beside"))
    return best.join(beside.hint("shuffle_hash"), "key", "left").select("key", "alias", F.when(F.col("b.head") != "", F.col("b.head")).otherwise(F.coalesce("beside", F.lit(""))).alias("head"), F.col("b.tail").alias("place"))


def kinds(named: DataFrame) -> DataFrame:
    """``head, kind``: heads grouped into kinds; a kind is named by its most frequent head.

    named: ``head, place``. The similarity of two heads is the mean of the cosine of their n-grams
    and of the share of the rarer one's places where the other stands too, less what chance gives.
    """
    heads = durable(named.where(F.col("head") != "").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.collect_set("place").alias("places")), eager=True)
    n_places = named.agg(F.count_distinct("place").cast("double").alias("n")).scalar()
    grams = F.array_distinct(F.flatten(F.transform(F.filter(F.split("head", " "), lambda w: F.length(w) > 1), lambda w: sparse.gram_features(w, 3, F.lit("head")))))
    shown = heads.select(F.col("head").alias("id"), "n", "places", grams.alias("grams"), F.concat(grams, F.array_distinct(F.transform("places", lambda p: sparse.hashed(F.lit("place"), p)))).alias("all"))
    both = durable(shown.select("id", "n", "places", "grams", F.array_distinct("all").alias("features")), eager=True)
    weights = sparse.feature_weights(both)
    met = sparse.cosine_join(both, both, weights, HEAD_COSINE, F.col("a.id") < F.col("b.id"), lambda x: F.array_distinct(F.concat(F.col(f"{x}.grams"), F.transform(f"{x}.places", lambda p: sparse.hashed(F.lit("place"), p)))))
    common = F.size(F.array_intersect("a.places", "b.places"))
    least, most = F.least(F.size("a.places"), F.size("b.places")), F.greatest(F.size("a.places"), F.size("b.places"))
    chance = F.least(most / n_places, F.lit(0.9))
    place = F.greatest((common / (least + 1) - chance) / (1 - chance), F.lit(0.0))
    scored = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.grams").alias("x"), F.col("b.grams").alias("y"), place.alias("place"))
    shared = named.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 0.5 * sparse.cosine(batch.column(2), batch.column(3), shared.value) + 0.5 * np.asarray(batch.column(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "weight"])

    edges = durable(scored.mapInArrow(run, "a string, b string, weight double").where(F.col("weight") > 0), eager=True)
    nodes = heads.select(F.col("head").alias("node"), F.col("n").alias("size"))
    # every head belongs with the most similar more frequent one; average linkage then works inside these trees
    either = edges.where(F.col("weight") >= HEAD_LINKAGE).select(F.explode(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))).alias("e")).select("e.*")
    rank = lambda x: nodes.select(F.col("node").alias(x), F.struct("size", "node").alias(f"r{x}"))
    up = either.join(rank("a").hint("shuffle_hash"), "a").join(rank("b").hint("shuffle_hash"), "b").where(F.col("ra") < F.col("rb")).groupBy(F.col("a").alias("sig")).agg(F.max_by("b", F.struct("weight", "rb")).alias("fuller"))
    tree = variants.roots(up).select(F.col("sig").alias("node"), F.col("root").alias("component"))
    labels = nodes.select("node").join(tree.hint("shuffle_hash"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    clusters = durable(variants.linkage_groups(nodes, edges, labels, HEAD_LINKAGE), eager=True)
    named_by = clusters.join(nodes.hint("shuffle_hash"), "node").groupBy("cluster").agg(F.max_by("node", F.struct("size", "node")).alias("kind"))
    return clusters.join(named_by.hint("shuffle_hash"), "cluster").select(F.col("node").alias("head"), "kind")


def organization_keys(typed: DataFrame) -> DataFrame:
    """``key, kind, place`` of typed organization names ``key``; null and letterless names drop out.

    An acronym stands for the kind and place of the name it is written beside; one that never is, for
    the known name that gives it: the stem that the acronyms of the kind share, and the beginning of
    the place, which a hyphen may name, else holds most of the names that give it. One that cannot be resolved stays as it is, as a place without a kind.
    """
    pieces = spelled_pieces(typed)
    named = durable(heads_and_places(pieces), eager=True)
    known = durable(named.join(kinds(named.select("head", "place")), "head", "left").select("key", "alias", F.coalesce("kind", F.lit("")).alias("kind"), "place"), eager=True)
    beside = known.where((F.col("alias") != "") & (F.col("kind") != "")).groupBy("alias", "kind", "place").agg(F.count(F.lit(1)).alias("n"))
    k = F.filter(F.sequence(F.lit(1), F.length("place")), lambda i: F.col("alias").endswith(F.substr("place", F.lit(1), i)))
    stem = beside.withColumn("k", F.array_max(k)).where(F.col("k").isNotNull()).select("kind", "n", F.substr("alias", F.lit(1), F.length("alias") - F.col("k")).alias("stem")).where(F.col("stem") != "")
    stems = stem.groupBy("kind", "stem").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.max_by("stem", F.struct("n", "stem")).alias("stem"))
    told = durable(beside.groupBy("alias").agg(F.max(F.struct("n", "kind", "place")).alias("b")).select(F.col("alias").alias("acronym"), "b.kind", "b.place"), eager=True)
    bare = pieces.where(F.col("acronym") != "").select("key", "acronym").distinct()
    unknown = bare.select("acronym").distinct().join(told.hint("shuffle_hash"), "acronym", "left_anti")
    # established names only: a spelling that one string alone has does not compete for an acronym
    entities = known.where(F.col("kind") != "").groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n")).join(told.select("kind", "place").hint("shuffle_hash"), ["kind", "place"], "left_anti").join(stems.hint("shuffle_hash"), "kind")
    spelled = entities.select("kind", "place", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("place")), lambda i: F.concat("stem", F.substr("place", F.lit(1), i)))).alias("acronym")).join(unknown.hint("shuffle_hash"), "acronym")
    written = pieces.where((F.col("acronym") != "") & (F.col("text") != "")).groupBy("acronym", F.col("text").alias("place")).agg(F.count(F.lit(1)).alias("beside"))
    scored = spelled.join(written.hint("shuffle_hash"), ["acronym", "place"], "left").withColumn("score", F.struct(F.coalesce("beside", F.lit(0)).alias("beside"), "n", "kind", "place"))
    best = scored.groupBy("acronym").agg(F.max("score").alias("b"), F.sum("n").alias("all")).where((F.col("b.beside") > 0) | (F.col("b.n") * 2 > F.col("all"))).select("acronym", "b.kind", "b.place")
    solved = bare.join(told.unionByName(best).hint("shuffle_hash"), "acronym", "left").select("key", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("place", "acronym").alias("place"))
    return durable(known.select("key", "kind", "place").unionByName(solved), eager=True)


def official_spellings(institutions: DataFrame) -> DataFrame:
    """``key``: official names, plain and written with each acronym."""
    both = F.concat(F.array("display_name"), F.coalesce(F.transform("acronyms", lambda a: F.concat("display_name", F.lit(" ("), a, F.lit(")"))), F.array()))
    return institutions.select(F.explode(both).alias("key")).where(F.col("key").isNotNull())
