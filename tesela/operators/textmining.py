"""Terms of titles and texts: cleaning, noun phrases, relevance, thesaurus, cluster keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that cannot be part of a noun phrase.
STOP = frozenset("a an and are as at be by for from in into is it its of on or that the this to un una de del la las el los y en o para por con do da e um uma between beyond".split())
# Irregular plurals and their singulars.
IRREGULAR = {"analyses": "analysis", "criteria": "criterion", "data": "data", "hypotheses": "hypothesis", "indices": "index", "matrices": "matrix", "media": "media", "phenomena": "phenomenon", "series": "series", "species": "species", "theses": "thesis"}


def clean_abstract(c: Column) -> Column:
    """Abstract without section labels at line starts and copyright tail, white space collapsed."""
    labels = F.regexp_replace(c, r"(?imU)^\s*(?:background|objectives?|methods?|results?|conclusions?|introducci[oó]n|m[eé]todos?|resultados?)\s*:\s*", "")
    tail = F.regexp_replace(labels, r"(?iU)\s*(?:©|\(c\)\s|copyright\s|all rights reserved).*$", "")
    return F.trim(F.regexp_replace(tail, r"(?U)\s+", " "))


def singular(c: Column) -> Column:
    """Term with its last word in the singular: irregular forms by table, else suffix rules."""
    words = F.split(c, " ")
    last = F.element_at(words, -1)
    rule = F.when(last.rlike("[^aeiou]ies$"), F.regexp_replace(last, "ies$", "y")).when(last.rlike("(?:ss|sh|ch|x|z)es$"), F.regexp_replace(last, "es$", "")).when(last.rlike("[^sui]s$") & (F.length(last) > 3), F.regexp_replace(last, "s$", "")).otherwise(last)
    fixed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), last), rule)
    return F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(fixed)), " ")


def noun_phrases(c: Column, longest: int = 3) -> Column:
    """Phrases of up to three content words, singular: every run that no stop word or punctuation interrupts is cut into them from its beginning; in order, with repeats."""
    marks = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_/-]+", " | ")
    stops = "(?<=^|\\s)(?:" + "|".join(sorted(STOP)) + "|\\d+|\\p{L})(?=\\s|$)"
    runs = F.split(F.regexp_replace(marks, stops, "|"), r"\s*\|[\s|]*")
    words = F.filter(F.transform(runs, lambda r: F.filter(F.split(F.trim(r), r"\s+"), lambda w: w != "")), lambda w: F.size(w) > 0)
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / longest).cast("int")), lambda i: singular(F.array_join(F.slice(w, i * longest + 1, longest), " ")))
    return F.filter(F.flatten(F.transform(words, cut)), lambda p: F.length(p) > 2)


def relevance(records: DataFrame, field: str) -> DataFrame:
    """``term, n, score``: divergence of a term's co-occurrence from that of all terms.

    Sum over co-occurring terms of p(w2|w1) ln(p(w2|w1) / p(w2)), with p(w2) the share of document
    frequencies; round to four digits.
    """
    from tesela.operators.networks import both_ways, cooccurrence, node_counts

    df = node_counts(records, field)
    p = df.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy()))
    c = both_ways(cooccurrence(records, field))
    cond = c.withColumn("pc", F.col("weight") / F.sum("weight").over(Window.partitionBy("node"))).join(p.select(F.col("node").alias("other"), "p"), "other")
    score = cond.groupBy("node").agg(F.round(F.sum(F.col("pc") * F.ln(F.col("pc") / F.col("p"))), 4).alias("score"))
    return df.join(score, "node", "left").select(F.col("node").alias("term"), F.col("count").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))


def relevant_terms(scored: DataFrame, least: int, ratio: float) -> DataFrame:
    """Terms with ``least`` occurrences, of these the share with the greatest (score, n)."""
    kept = scored.where(F.col("n") >= least)
    pr = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n"), "term"))
    return kept.withColumn("r", pr).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("r") <= F.ceil(F.col("total") * ratio)).select("term", "n", "score")


def apply_thesaurus(records: DataFrame, field: str, thesaurus: DataFrame) -> DataFrame:
    """Records with terms replaced by ``label -> replacement`` (any case); an empty or ``<ignore>`` replacement drops the term; repeats collapse.

    The thesaurus is joined by exploded term, not shipped to every task, whatever its size.
    """
    key = [c for c in records.columns if c != field]
    rows = records.select(*key, F.posexplode(field).alias("pos", "term"))
    t = thesaurus.select(F.lower("label").alias("k"), F.col("replacement"))
    new = rows.withColumn("k", F.lower("term")).join(t, "k", "left").withColumn("new", F.when(F.col("replacement").isNull(), F.col("term")).otherwise(F.col("replacement")))
    kept = new.where((F.col("new") != "") & (F.col("new") != "<ignore>"))
    return kept.groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"])).alias(field))


def cluster_keywords(docs: DataFrame, cluster: str, text: str, top: int = 5) -> DataFrame:
    """Most characteristic words of each cluster by summed tf-idf; words longer than three letters."""
    words = docs.select(cluster, F.monotonically_increasing_id().alias("i"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{4,})"), F.lit(1))).alias("w"))
    tf = words.groupBy(cluster, "i", "w").agg(F.count(F.lit(1)).alias("tf"))
    sums = tf.groupBy(cluster, "w").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("d"))
    df = sums.groupBy("w").agg(F.sum("d").alias("df"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    scored = sums.join(df, "w").withColumn("score", F.round(F.col("tf") * F.ln((n + 1) / (F.col("df") + 1)), 6))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "w"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "rank", F.col("w").alias("keyword"), "score")


def document_term_matrix(records: DataFrame, key: str, field: str, n: int = 50) -> DataFrame:
    """Long document-term matrix (1 where present) of the ``n`` most frequent terms."""
    e = records.select(key, F.explode(F.array_distinct(field)).alias("term"))
    top = e.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n).select("term")
    return e.join(F.broadcast(top), "term", "left_semi").select(key, "term", F.lit(1).alias("value"))
