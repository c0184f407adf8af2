"""Variant spellings of names (problem 1).

1. Spellings of single words. Words are vectors of weighted character n-grams; a distributed sparse
   cosine join (``sparse``) lets every word meet those of which it may be a slip, and their relative
   frequency decides.
2. Short forms of given names are learned: a given name that nearly always stands with surnames that
   another, more frequent one stands with too is taken as the other.
3. Whole names. A name meets the fuller ones it is a shortened form of; what is still apart meets by
   the cosine of whole-name vectors. Linked names are grouped by average-linkage clustering.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm import names, sparse
from tesela.session import durable

RATIO, CHANCE = 4, 1.25  # a slip, less so many chance occurrences, is at least so many times rarer than its word
FAR_RATIO, FAR_LENGTH = 20, 8  # two edits are a slip in words of so many letters, at so much greater a ratio
WORD_COSINE = {2: 0.15, 3: 0.2, 4: 0.3}  # of the 2-, 3- and 4-gram vectors of words; a swap leaves less of a short word's vector
NAME_COSINE = 0.65
ALIAS_SHARE, ALIAS_LEAST = 0.35, 3  # share and number of families in which a short form stands beside the full one
LINKAGE = 0.3  # mean similarity at which clusters still merge


def may_be_slip(n_slip: Column, n_word: Column, ratio: float = RATIO) -> Column:
    """Whether a spelling in ``n_slip`` names is rare enough, relative to one in ``n_word``, to be a slip of it."""
    return (n_word > n_slip) & ((n_slip - CHANCE) * ratio <= n_word)


def gram_sizes(size: Column) -> Column:
    """Of words of ``size`` letters: up to six have 2-grams, five to nine 3-grams, from nine on 4-grams."""
    return F.filter(F.array(F.when(size <= 6, 2), F.when((size >= 5) & (size <= 9), 3), F.when(size >= 9, 4)), lambda x: x.isNotNull())


def word_vectors(words: DataFrame) -> DataFrame:
    """``space, id, n, length, size, features`` of ``space, word, n``, once per size of ``gram_sizes``."""
    each = words.select("space", F.col("word").alias("id"), "n", F.length("word").alias("length"), F.explode(gram_sizes(F.length("word"))).alias("size"))
    return each.withColumn("features", sparse.gram_features(F.col("id"), F.col("size"), F.col("space")))


def near_words(words: DataFrame) -> DataFrame:
    """``a, b`` (structs ``space, id, n, length``): words that may be one edit apart, the rarer and the more frequent one, each pair once.

    Words that are one edit apart are equal after leaving out one letter of each at most, or of both
    in a swap, and meet there; so their work grows with the letters, not with the grams that words share.
    """
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    def side(df: DataFrame, name: str) -> DataFrame:
        left = F.array_distinct(F.transform(F.concat(F.array("word"), without(F.col("word"))), lambda w: F.xxhash64("space", w)))  # equal numbers of other letters do no harm
        return df.select(F.explode(left).alias("key"), F.struct("space", F.col("word").alias("id"), "n", F.length("word").alias("length")).alias(name))

    a, b = F.col("a"), F.col("b")
    other = lambda w, v: F.call_function("translate", w, v, F.lit(""))  # noqa: E731  # letters of w that v has not
    swap = (a["length"] == b["length"]) & (other(a["id"], b["id"]) == "") & (other(b["id"], a["id"]) == "")
    close = (F.abs(a["length"] - b["length"]) <= 1) & ((F.levenshtein(a["id"], b["id"], 1) >= 0) | swap)
    met = side(words, "a").join(side(words.where(F.col("n") > 1), "b").hint("shuffle_hash"), "key")
    return met.where((a["id"] != b["id"]) & may_be_slip(a["n"], b["n"]) & close & (F.levenshtein(a["space"], b["space"], 0) == 0)).select("a", "b").distinct()


def slips(words: DataFrame) -> DataFrame:
    """``space, word, fixed``: the word that each probable slip stands for. words: ``space, word, n``."""
    vectors = word_vectors(words)
    weights = sparse.feature_weights(vectors)
    a, b = F.col("a"), F.col("b")
    far = lambda length, n, length_word, n_word: (n_word >= FAR_RATIO * n) & may_be_slip(n, n_word, FAR_RATIO) & (length >= FAR_LENGTH) & (length_word >= FAR_LENGTH)
    least = lambda size: F.element_at(F.create_map(*[F.lit(x) for kv in WORD_COSINE.items() for x in kv]), size)
    grams = lambda x: sparse.gram_features(F.col(f"{x}.id"), F.col("size"), F.col(f"{x}.space"))
    sized = near_words(words).select("a", "b", F.explode(F.array_intersect(gram_sizes(a["length"]), gram_sizes(b["length"]))).alias("size"))
    one = sparse.similar(sized.select(a.withField("least", least(F.col("size"))).alias("a"), "b", grams("a").alias("x"), grams("b").alias("y")), weights)
    # two edits count in long words at the greater ratio only, which few words reach; size and space are
    # in the features already and are compared last, in a form that is no key to sort by
    long = vectors.where(F.col("length") >= FAR_LENGTH)
    apart = far(a["length"], a["n"], b["length"], b["n"]) & (F.abs(a["length"] - b["length"]) <= 2) & (F.levenshtein(a["id"], b["id"], 2) >= 0)
    where = apart & (a["size"] - b["size"] == 0) & (F.levenshtein(a["space"], b["space"], 0) == 0)
    two = sparse.cosine_join(long, long.where(F.col("n") >= FAR_RATIO), weights, least(F.col("size")), where, lambda x: sparse.gram_features(F.col(f"{x}.id"), F.col(f"{x}.size"), F.col(f"{x}.space")))
    flat = lambda df: df.select(a["space"].alias("space"), a["id"].alias("word"), b["id"].alias("fixed"), a["n"].alias("n"), b["n"].alias("n_fixed"), "cosine")
    met = flat(one).unionByName(flat(two))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = [names.near(x, y) for x, y in zip(names.values(batch.column(1)), names.values(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, pa.bool_())], [*batch.schema.names, "one_edit"])

    checked = met.mapInArrow(run, "space string, word string, fixed string, n long, n_fixed long, cosine double, one_edit boolean")
    return checked.where(F.col("one_edit") | far(F.length("word"), F.col("n"), F.length("fixed"), F.col("n_fixed"))).groupBy("space", "word").agg(F.max_by("fixed", F.struct("one_edit", "n_fixed", "cosine", "fixed")).alias("fixed"))


def repair_words(words: DataFrame) -> DataFrame:
    """``space, word, fixed`` for spellings that more frequent words explain; others do not appear.

    words: ``space, word, n`` (names that have it); words of different spaces never meet. A word that
    is two more frequent ones written together becomes both, with a blank between. A word whose
    explanation is itself explained gets the explanation of that. Every word may be a slip and may
    be what others are slips of: relative frequency decides, at every size.
    """
    words = words.where(F.length("word") >= 3)
    size = F.length("word")
    split = words.where(size >= 6).select("space", "word", "n", F.explode(F.sequence(F.lit(3), size - 3)).alias("cut"))
    split = split.select("space", "word", "n", F.substr("word", F.lit(1), "cut").alias("left"), F.substr("word", F.col("cut") + 1).alias("right"))
    counts = lambda name: words.select("space", F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    less = F.least("n_left", "n_right")
    halves = split.join(counts("left").hint("shuffle_hash"), ["space", "left"]).where(may_be_slip(F.col("n"), F.col("n_left"))).join(counts("right").hint("shuffle_hash"), ["space", "right"]).where(may_be_slip(F.col("n"), less))
    joined = halves.groupBy("space", "word").agg(F.max_by(F.concat_ws(" ", "left", "right"), F.struct(less, "left")).alias("fixed"))
    told = durable(words.join(joined.hint("shuffle_hash"), ["space", "word"], "left").select("space", "word", "n", "fixed"), eager=True)
    fixes = durable(told.where(F.col("fixed").isNotNull()).drop("n").unionByName(slips(told.where(F.col("fixed").isNull()).drop("fixed"))), eager=True)
    while True:  # frequencies rise with every step, so this ends
        each = fixes.select("space", "word", F.posexplode(F.split("fixed", " ")).alias("pos", "part"))
        further = fixes.select("space", F.col("word").alias("part"), F.col("fixed").alias("next")).hint("shuffle_hash")
        if each.join(further, ["space", "part"]).isEmpty():
            return fixes
        parts = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("next", "part").alias("part"))))
        fixes = durable(each.join(further, ["space", "part"], "left").groupBy("space", "word").agg(F.concat_ws(" ", F.transform(parts, lambda x: x["part"])).alias("fixed")), eager=True)


def given_aliases(parsed: DataFrame) -> DataFrame:
    """``alias, name``: short and other forms of given names, learned from the surnames they stand with.

    parsed: distinct ``given, family``. A given name is the vector of the pairs of surnames it stands
    with; one whose vector lies to ``ALIAS_SHARE`` inside that of a more frequent one, over
    ``ALIAS_LEAST`` pairs of surnames or more, is a form of it. Every pair of surnames counts, less
    the chance that the more frequent name stands among its given names anyhow: so one with very many
    given names says little about them, and a large one of rare given names says as much as others.
    """
    first, second = F.get("family", F.lit(0)), F.get("family", F.lit(1))
    full = parsed.where((F.length(F.get("given", F.lit(0))) > 1) & (F.length(second) > 1)).select(F.get("given", F.lit(0)).alias("g"), F.concat_ws(" ", first, second).alias("f")).distinct()
    total = full.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = total.agg(F.sum("n").alias("rows"))
    crowd = full.groupBy("f").agg(F.collect_set("g").alias("gs")).where(F.size("gs") > 1)
    pairs = crowd.select(F.explode("gs").alias("alias"), "gs").select("alias", F.size("gs").alias("k"), F.explode("gs").alias("name")).where(F.col("alias") != F.col("name"))
    pairs = pairs.groupBy("alias", "name", "k").agg(F.count(F.lit(1)).alias("both"))
    n = lambda x: total.select(F.col("g").alias(x), F.col("n").alias(f"n_{x}"))
    near = pairs.join(n("alias").hint("shuffle_hash"), "alias").join(n("name").hint("shuffle_hash"), "name").where(F.col("n_name") > F.col("n_alias")).crossJoin(rows)
    says = F.col("both") * F.greatest(F.lit(0.0), 1 - (F.col("k") - 1) * F.col("n_name") / F.col("rows"))
    near = near.groupBy("alias", "name", "n_alias", "n_name").agg(F.sum("both").alias("both"), F.round(F.sum(says), 9).alias("says"))
    kept = near.where((F.col("both") >= ALIAS_LEAST) & (F.col("says") >= ALIAS_SHARE * F.col("n_alias")))
    return kept.groupBy("alias").agg(F.max_by("name", F.struct("says", "n_name", "name")).alias("name"))


def split_names(typed: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """Adds ``given``, ``family`` and their signature ``sig`` to typed names of persons ``name``; a null or letterless name drops out.

    ``nicknames`` (``alias, name``) may add known short forms to those that are learned.
    """
    columns = typed.columns
    strings = typed.select("name").where(F.col("name").isNotNull()).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [names.person_tokens(x) for x in names.values(batch.column(0))]
            kinds = (pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[names.list_array([x[i] for x in out], k) for i, k in enumerate(kinds)]], ["name", "words", "sides", "caps"])

    split = durable(strings.mapInArrow(tokens, "name string, words array<string>, sides array<int>, caps array<int>").where(F.size("words") > 0), eager=True)
    # rows of a checkpoint stay in their order, so the numbers of names stay
    each = split.withColumn("id", F.monotonically_increasing_id()).select("id", "name", F.posexplode(F.arrays_zip("words", "sides", "caps")).alias("pos", "t")).select("id", F.when(F.col("pos") == 0, F.col("name")).alias("name"), "pos", F.col("t.words").alias("word"), F.col("t.sides").alias("side"), F.col("t.caps").alias("caps"))
    one = lambda c: F.count(F.when(c, 1))
    words = durable(each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), one(F.col("side") == 0).alias("l"), one(F.col("side") == 1).alias("r"), one(F.col("caps") == 0).alias("t")).withColumn("space", F.lit("person")), eager=True)
    fixes = repair_words(words.select("space", "word", "n"))
    parts = words.select("word").join(fixes.select("word", "fixed").hint("shuffle_hash"), "word", "left").select("word", F.posexplode(F.split(F.coalesce("fixed", "word"), " ")).alias("at", "part"))
    known = words.select(F.col("word").alias("part"), "l", "r", "t")
    table = parts.join(known.hint("shuffle_hash"), "part", "left").select("word", "at", "part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("l", "r", "t")])
    gathered = each.join(durable(table, eager=True).hint("shuffle_hash"), "word").select("id", "name", "pos", "side", "caps", "at", "part", "l", "r", "t").repartition("id").sortWithinPartitions("id")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, held = None, [], []  # a name's rows stand together, in any order

        def done() -> None:
            rows.sort()
            tokens_: list[tuple[int, int, list[tuple[str, int, int, int]]]] = []
            for _, at, side, caps, _, part in rows:
                if at:
                    tokens_[-1][2].append(part)
                else:
                    tokens_.append((side, caps, [part]))
            held.append((rows[0][4], *names.parse_person(tokens_)))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), *[names.list_array([x[i] for x in held], pa.string()) for i in (1, 2)]], ["name", "given", "family"])
            held.clear()
            return batch

        for batch in batches:
            for i, name, pos, side, caps, at, part, l, r, t in zip(*map(names.values, batch.columns)):  # noqa: E741
                if i != last:
                    if rows:
                        done()
                    last, rows = i, []
                rows.append((pos, at, side, caps, name, (part, l, r, t)))
            if len(held) > 10_000:
                yield out()
        if rows:
            done()
        if held:
            yield out()

    parsed = durable(gathered.mapInArrow(parse, "name string, given array<string>, family array<string>"), eager=True)
    aliases = given_aliases(parsed.select("given", "family").distinct())
    if nicknames is not None:
        aliases = aliases.unionByName(nicknames.select("alias", "name")).groupBy("alias").agg(F.max("name").alias("name"))
    aliases = aliases.withColumnRenamed("name", "formal")
    first = F.get("given", F.lit(0))
    formal = parsed.withColumn("alias", first).join(aliases, "alias", "left")
    given = F.when(F.col("formal").isNull(), F.col("given")).otherwise(F.transform("given", lambda g, i: F.when(i == 0, F.col("formal")).otherwise(g)))
    done = formal.select("name", given.alias("given"), "family").withColumn("sig", F.concat(F.concat_ws(" ", "given"), F.lit("|"), F.concat_ws(" ", "family")))
    return typed.join(done.hint("shuffle_hash"), "name").select(*columns, "given", "family", "sig")


def complete(given: Column, family: Column) -> Column:
    """Whether a name has a first given name and two surnames in full."""
    return F.coalesce((F.length(F.get(given, F.lit(0))) > 1) & (F.length(F.get(family, F.lit(1))) > 1), F.lit(False))


def fuller_names(sigs: DataFrame) -> DataFrame:
    """``sig, fuller``: for every signature that is a shortened form of others, the complete and most frequent of them.

    sigs: distinct ``sig, given, family, n``. Every signature posts its shortened forms (their number
    depends on its parts only) and signatures meet the forms by equality: no group of namesakes is
    compared pairwise, however large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [names.forms(g, f) for g, f in zip(names.lists(batch.column(1)), names.lists(batch.column(2)))]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in out]))
            yield pa.RecordBatch.from_arrays([pa.array([x for y in out for x in y], pa.string()), batch.column(0).take(at), batch.column(3).take(at), batch.column(4).take(at)], ["form", "sig", "n", "complete"])

    rows = sigs.select("sig", "given", "family", "n", complete(F.col("given"), F.col("family")).alias("complete")).mapInArrow(run, "form string, sig string, n long, complete boolean")
    # most forms are nobody's signature and leave before anything is sorted
    met = rows.join(sigs.select(F.col("sig").alias("form")).hint("shuffle_hash"), "form")
    return met.groupBy(F.col("form").alias("sig")).agg(F.max_by("sig", F.struct("complete", "n", "sig")).alias("fuller"))


def roots(links: DataFrame) -> DataFrame:
    """``sig, root`` of links ``sig, fuller``, followed to their ends; every step leads to a fuller or a more frequent name, so this ends."""
    links = durable(links.select("sig", F.col("fuller").alias("root")), eager=True)
    while True:
        further = links.select(F.col("sig").alias("root"), F.col("root").alias("next")).hint("shuffle_hash")
        if links.join(further, "root").isEmpty():
            return links
        links = durable(links.join(further, "root", "left").select("sig", F.coalesce("next", "root").alias("root")), eager=True)


def close_names(sigs: DataFrame) -> DataFrame:
    """``a, b, cosine``: complete names whose whole-name vectors are close and that differ in one surname by a probable slip.

    sigs: ``sig, given, family, n``. Catches what the words alone do not decide: a spelling that is
    rarer than another only in otherwise equal names. Such names have the given name and one surname
    in common and meet there; vectors are made of the pairs that are left.
    """

    def whole(g: Column, x: Column, y: Column) -> Column:
        return F.array_distinct(F.concat(*[sparse.gram_features(c, 3, F.lit(tag)) for c, tag in ((g, "g"), (x, "s"), (y, "t"))]))

    full = sigs.where(complete(F.col("given"), F.col("family"))).select(F.col("sig").alias("id"), F.get("given", F.lit(0)).alias("g"), F.get("family", F.lit(0)).alias("x"), F.get("family", F.lit(1)).alias("y"), "n")
    words = full.select(F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(c).alias("word")) for c, tag in (("g", "g"), ("x", "s"), ("y", "t"))])).alias("w")).select("w.*").groupBy("tag", "word").agg(F.count(F.lit(1)).alias("times"))
    weights = sparse.feature_weights(words.select(sparse.gram_features(F.col("word"), 3, F.col("tag")).alias("features"), "times"), times=F.col("times"))

    def side(df: DataFrame, name: str) -> DataFrame:
        either = F.explode(F.array(*[F.struct(F.lit(p).alias("which"), F.col(p).alias("same"), F.col(q).alias("other")) for p, q in (("x", "y"), ("y", "x"))])).alias("s")
        rows = df.select("id", "g", "n", either).where(F.length("s.other") >= 5)
        return rows.select("g", "s.which", "s.same", F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), F.col("s.other").alias(f"{name}_other"))

    met = side(full, "a").join(side(full.where(F.col("n") > 1), "b"), ["g", "which", "same"])
    met = met.where((F.col("a_n") * 2 <= F.col("b_n")) & (F.col("a_other") != F.col("b_other")) & (F.levenshtein("a_other", "b_other", 2) >= 0))
    vector = lambda s: whole(F.col("g"), F.when(F.col("which") == "x", F.col("same")).otherwise(F.col(f"{s}_other")), F.when(F.col("which") == "y", F.col("same")).otherwise(F.col(f"{s}_other")))
    pairs = met.select(F.struct(F.col("a_id").alias("id"), F.lit(NAME_COSINE).alias("least")).alias("a"), F.struct(F.col("b_id").alias("id")).alias("b"), vector("a").alias("x"), vector("b").alias("y"))
    found = sparse.similar(pairs, weights).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "cosine")
    best = found.groupBy("a").agg(F.min_by(F.struct("b", "cosine"), F.struct(-F.col("cosine"), F.col("b"))).alias("m"))
    return best.select("a", "m.b", "m.cosine")


def average_clusters(sizes: list[float], pairs: Iterator[tuple[int, int, float]], threshold: float, absent: bool = True) -> list[list[int]]:
    """Average-linkage clusters of members with ``sizes`` (how often each counts).

    pairs: two members and their similarity, negative where they cannot be one. Pairs that are not
    there count as 0, or are left out of the means if ``absent`` is false. The two clusters with the
    greatest mean similarity merge while it reaches the threshold; clusters with an impossible pair
    never merge. A heap holds the candidates, so the work grows with the pairs given.
    """
    members = {i: [i] for i in range(len(sizes))}
    mass = dict(enumerate(sizes))
    near: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in members}
    for i, j, s in pairs:
        near[i][j] = near[j][i] = (s * mass[i] * mass[j] if s >= 0 else -math.inf, mass[i] * mass[j])
    mean = lambda i, j: near[i][j][0] / (mass[i] * mass[j] if absent else near[i][j][1])
    heap = [(-m, i, j) for i, x in near.items() for j in x if i < j and (m := mean(i, j)) >= threshold]
    heapq.heapify(heap)
    while heap:
        negative, i, j = heapq.heappop(heap)
        if i not in members or j not in members or j not in near[i] or -mean(i, j) != negative:
            continue
        if len(near[i]) < len(near[j]):
            i, j = j, i
        members[i] += members.pop(j)
        mass[i] += mass.pop(j)
        gone = near.pop(j)
        for k, (s, n) in gone.items():
            del near[k][j]
            if k != i:
                t, m = near[i].get(k, (0.0, 0.0))
                near[i][k] = near[k][i] = (s + t, n + m)
        for k in near[i] if absent else gone:
            if k != i and (m := mean(i, k)) >= threshold:
                heapq.heappush(heap, (-m, min(i, k), max(i, k)))
    return list(members.values())


def linkage_groups(nodes: DataFrame, edges: DataFrame, labels: DataFrame, threshold: float, absent: bool = True) -> DataFrame:
    """``node, cluster``: average-linkage clusters inside the components of a graph; a cluster is named by its least node.

    nodes: ``node, size``; edges: ``a, b, weight`` (negative: not one); labels: ``node, component``.
    """
    tagged = nodes.join(labels.hint("shuffle_hash"), "node").select("component", F.lit(0).alias("tag"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("size").cast("double").alias("v"))
    links = edges.join(labels.withColumnRenamed("node", "a").hint("shuffle_hash"), "a").select("component", F.lit(1).alias("tag"), "a", "b", F.col("weight").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, found, sizes, pairs = None, [], [], []
        held: list[tuple[str, str]] = []

        def done() -> None:
            at = {x: i for i, x in enumerate(found)}
            for group in average_clusters(sizes, ((at[a], at[b], w) for a, b, w in pairs if b in at), threshold, absent):
                least = min(found[i] for i in group)
                held.extend((found[i], least) for i in group)

        for batch in batches:
            for c, tag, a, b, v in zip(*map(names.values, batch.columns)):
                if c != component:
                    if found:
                        done()
                    component, found, sizes, pairs = c, [], [], []
                if tag:
                    pairs.append((a, b, v))
                else:
                    found.append(a)
                    sizes.append(v)
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["node", "cluster"])
                held.clear()
        if found:
            done()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["node", "cluster"])

    return tagged.unionByName(links).repartition("component").sortWithinPartitions("component", "tag").mapInArrow(run, "node string, cluster string")


@lru_cache(1 << 15)
def _part_grams(part: str, weight: float) -> dict[str, float]:
    marked = f"#{part}#"
    grams = {marked[:2]} | ({marked[i : i + 3] for i in range(len(marked) - 2)} if len(part) > 1 else set())
    return dict.fromkeys(grams, weight / len(grams))


def name_vector(given: list[str], family: list[str]) -> dict[str, float]:
    """Weighted n-grams of a whole name: initials and the 3-grams of its parts, surnames twice as heavy."""
    out: dict[str, float] = {}
    for parts, weight in ((given, 1.0), (family, 2.0)):
        for p in parts:
            grams = _part_grams(p, weight)
            if out.keys().isdisjoint(grams):
                out.update(grams)
            else:
                for g, v in grams.items():
                    out[g] = out.get(g, 0.0) + v
    norm = math.sqrt(sum([v * v for v in out.values()])) or 1.0
    return {g: v / norm for g, v in out.items()}


def vector_cosine(a: dict[str, float], b: dict[str, float]) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(v * large[g] for g, v in small.items() if g in large)


def average_linkage(grouped: DataFrame) -> DataFrame:
    """``sig, cluster`` of ``label, sig, given, family``: the members of every label by average linkage of their whole-name vectors.

    A label holds a name, its shortened forms and close spellings, so its size depends on the parts
    of one name and not on the rows. A cluster is named by its least signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, members = None, []

        def done() -> list[tuple[str, str]]:
            if len(members) == 1:
                return [(members[0][0], members[0][0])]
            vectors = [name_vector(g, f) for _, g, f in members]

            def similarity(i: int, j: int) -> float:
                (_, g, f), (_, h, e) = members[i], members[j]
                if not names.fits(g, h):
                    return -1.0
                c = vector_cosine(vectors[i], vectors[j])
                return c if names.fits(f, e) or c >= NAME_COSINE else -1.0

            n = len(members)
            pairs = [(i, j, similarity(i, j)) for i in range(n) for j in range(i + 1, n)]
            # where every pair reaches the threshold, so does every mean, and all merge
            groups = [range(n)] if all(s >= LINKAGE + 1e-9 for _, _, s in pairs) else average_clusters([1.0] * n, pairs, LINKAGE)
            return [(members[i][0], least) for g in groups for least in (min(members[i][0] for i in g),) for i in g]

        held: list[tuple[str, str]] = []
        for batch in batches:
            for row in zip(names.values(batch.column(0)), names.values(batch.column(1)), names.lists(batch.column(2)), names.lists(batch.column(3))):
                if row[0] != label:
                    if members:
                        held += done()
                    label, members = row[0], []
                members.append(row[1:])
                if len(held) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["sig", "cluster"])
                    held = []
        if members:
            held += done()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["sig", "cluster"])

    return grouped.select("label", "sig", "given", "family").repartition("label").sortWithinPartitions("label").mapInArrow(run, "sig string, cluster string")


def cluster_names(sigs: DataFrame) -> DataFrame:
    """``sig, cluster`` of distinct signatures ``sig, given, family, n``."""
    links = roots(fuller_names(sigs))
    tops = sigs.join(links.select("sig").hint("shuffle_hash"), "sig", "left_anti")
    close = roots(close_names(tops).select(F.col("a").alias("sig"), F.col("b").alias("fuller"))).withColumnsRenamed({"sig": "top", "root": "close"})
    label = sigs.join(links.hint("shuffle_hash"), "sig", "left").withColumn("top", F.coalesce("root", "sig")).join(close, "top", "left").withColumn("label", F.coalesce("close", "top"))
    return average_linkage(label)


def cluster_pairs(members: DataFrame) -> DataFrame:
    """``field_name, key_a, key_b`` of members ``field_name, key, cluster``: every pair of keys of one cluster."""
    a = members.select("field_name", "cluster", F.col("key").alias("key_a"))
    b = members.select("field_name", "cluster", F.col("key").alias("key_b"))
    return a.join(b, ["field_name", "cluster"]).where(F.col("key_a") < F.col("key_b")).select("field_name", "key_a", "key_b")
