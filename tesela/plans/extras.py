"""Registered queries of growth models (A41), tags and citations (X26, X33 to X36), embeddings (T09), catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import tags
from tesela.operators.growth import growth_models
from tesela.plans.corpus import corpus
from tesela.session import table

SQL: dict[str, str] = {}


def _growth(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("t")).agg(F.count(F.lit(1)).alias("v"))
    return growth_models(rows, "k", "t", "v")


def _citations(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).where((F.size("author_names") > 0) & F.col("publication_year").isNotNull() & F.col("journal_name").isNotNull())
    text = F.concat_ws(", ", F.regexp_replace(F.col("author_names")[0], ",", ""), F.col("publication_year").cast("string"), F.regexp_replace("journal_name", ",", ""), F.lit("V12"), F.lit("P34"), F.concat(F.lit("DOI "), "doi"))
    return c.select("id", tags.parse_citation(text).alias("p")).select("id", "p.*")


def _raw_tags(s: SparkSession, d: str, table_: dict) -> DataFrame:
    r = table(s, d, "raw_records").select("record_id", *[F.col(x) for x in ("ut", "ti", "py", "so", "au", "de", "c1")]).distinct()
    wide = r.unpivot(["record_id"], ["ut", "ti", "py", "so", "au", "de", "c1"], "tag", "value").where(F.col("value").isNotNull())
    return tags.processed(wide.select("record_id", F.upper("tag").alias("tag"), F.split("value", r"\r?\n").alias("lines")), "tag", "lines", table_).select("record_id", "tag", "name", F.size("values").alias("n"))


def _embedded(s: SparkSession, d: str, size: int = 64) -> DataFrame:
    """Vectors of titles by hashed word features with inverse document frequencies, a model that is trained here."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = RegexTokenizer(inputCol="title", outputCol="w", pattern=r"[^\p{L}\p{N}]+").transform(corpus(s, d).select("id", "title"))
    tf = HashingTF(numFeatures=size, inputCol="w", outputCol="tf").transform(rows)
    out = Normalizer(inputCol="x", outputCol="v").transform(IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf))
    return out.select("id", vector_to_array("v").alias("embedding"))


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    from tesela.plans import registry

    return s.createDataFrame([(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(registry.queries().items())], "name string, description string")


QUERIES = {
    "A41_growth_models": _growth,
    "X26_full_citation": _citations,
    "X33_tag_aliases": lambda s, d: s.createDataFrame([(t, *tags.synonyms(t)) for t in sorted(tags.TAGS)], "asked string, tag string, name string"),
    "X34_tag_processors": lambda s, d: _raw_tags(s, d, tags.TAGS),
    "X35_medline_processors": lambda s, d: _raw_tags(s, d, tags.MEDLINE),
    "X36_list_processors": lambda s, d: table(s, d, "raw_records").select("record_id", F.size(tags.process("semicolons", F.array("de"))).alias("n")).distinct(),
    "X41_colours": lambda s, d: s.createDataFrame([(i, tags.golden_hue(i)) for i in range(12)], "i int, colour string"),
    "T09_embeddings": _embedded,
    "Z05_catalogue": _catalogue,
}
