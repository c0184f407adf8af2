"""Bibliometric aggregates over the canonical corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.plans.corpus import mean_of, share_of

OA_STATUSES = ("diamond", "gold", "hybrid", "bronze", "green", "closed")
#: Regional blocks of countries; a country may belong to several.
BLOCKS = {
    "Iberoamerica": ("AR", "BO", "BR", "CL", "CO", "CR", "CU", "EC", "ES", "PA", "PE", "PT", "UY", "VE"),
    "Global_South": ("AR", "BR", "CL", "CO", "CU", "EG", "ID", "IN", "KE", "NG", "PE", "VN", "ZA"),
    "OECD": ("AU", "BE", "CA", "CH", "CL", "DE", "ES", "FR", "GB", "IT", "JP", "KR", "NL", "SE", "US"),
    "BRICS": ("AE", "BR", "CN", "EG", "ET", "IN", "IR", "RU", "ZA"),
}


def n_works() -> Column:
    return F.count(F.lit(1)).alias("n_works")


def impact() -> list[Column]:
    """Works, citations, mean field-weighted impact, share in the top tenth, APC."""
    return [n_works(), F.sum("cited_by_count").alias("cites"), mean_of("fwci").alias("mean_fwci"), share_of(F.sum("is_top_10"), F.count(F.lit(1))).alias("pct_top_10"), F.sum("apc_paid_usd").alias("apc_usd")]


def oa_counts() -> list[Column]:
    return [F.count_if(F.col("oa_status") == s).alias(f"n_{s}") for s in OA_STATUSES]


def yearly_series(works: DataFrame) -> DataFrame:
    """Counts and impact per year; a missing FWCI counts as 1 here."""
    fwci = F.coalesce("fwci", F.lit(1).cast("decimal(18,4)"))
    return works.where(F.col("publication_year").isNotNull()).groupBy("publication_year").agg(n_works(), F.sum("cited_by_count").alias("cites"), mean_of(fwci).alias("mean_fwci"), *oa_counts(), F.count_if(F.col("is_top_10") == 1).alias("n_top_10"), F.sum("apc_paid_usd").alias("apc_usd"))


def oa_distribution(works: DataFrame) -> DataFrame:
    """Works per open-access status with their share of all (a window over the few groups)."""
    groups = works.groupBy("oa_status").agg(n_works(), F.sum("cited_by_count").alias("cites"), F.sum("apc_paid_usd").alias("apc_usd"))
    return groups.withColumn("pct", share_of(F.col("n_works"), F.sum("n_works").over(Window.partitionBy())))


def by_element(works: DataFrame, field: str, name: str) -> DataFrame:
    """Impact per distinct element of an array field; a work counts once per element."""
    return works.withColumn(name, F.explode(F.array_distinct(field))).groupBy(name).agg(*impact())


def by_dimension(works: DataFrame, dimension: str) -> DataFrame:
    return works.groupBy(dimension).agg(*impact())


def two_period_growth(works: DataFrame, field: str, first: tuple[int, int], second: tuple[int, int], least: int = 1) -> DataFrame:
    """Works per element in two periods, mean FWCI of the second, growth in percent and its class."""
    year = F.col("publication_year")
    in1, in2 = year.between(*first), year.between(*second)
    rows = works.select("publication_year", "fwci", F.explode(F.array_distinct(field)).alias("item")).groupBy("item").agg(F.count_if(in1).alias("n1"), F.count_if(in2).alias("n2"), mean_of(F.when(in2, F.col("fwci"))).alias("fwci2"))
    rows = rows.where(F.col("n1") + F.col("n2") >= least).withColumn("growth_pct", share_of(F.col("n2") - F.col("n1"), F.col("n1")))
    event = F.when((F.col("n1") == 0) & (F.col("n2") > 0), "emerging").when(F.col("n2") == 0, "vanished").when(F.col("growth_pct") > 20, "growing").when(F.col("growth_pct") < -20, "shrinking").otherwise("stable")
    return rows.withColumn("event", event)


def collaboration_matrix(works: DataFrame, home: str) -> DataFrame:
    """Partner countries of a home country: joint works, share, mean FWCI, Salton index and its proxy.

    The proxy is c / sqrt(N * c * 1.5); the true index c / sqrt(N_home * N_partner).
    """
    sizes = works.select(F.explode("countries").alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n_partner"))
    ours = works.where(F.array_contains("countries", home))
    total = ours.agg(F.count(F.lit(1)).alias("n")).scalar()
    joint = ours.select("fwci", F.explode("countries").alias("country")).where(F.col("country") != home).groupBy("country").agg(F.count(F.lit(1)).alias("n_joint"), mean_of("fwci").alias("mean_fwci"))
    rows = joint.join(sizes, "country").withColumn("n_home", total)
    c = F.col("n_joint").cast("double")
    return rows.select("country", "n_joint", "mean_fwci", share_of(F.col("n_joint"), F.col("n_home")).alias("pct"), F.round(c / F.sqrt(F.col("n_home") * c * 1.5), 6).alias("salton_proxy"), F.round(c / F.sqrt(F.col("n_home").cast("double") * F.col("n_partner")), 6).alias("salton"))


def block_shares(works: DataFrame) -> DataFrame:
    """Works with a country of each regional block and their share of all works."""
    rows = works.select(F.explode(F.filter(F.array(*[F.when(F.arrays_overlap("countries", F.array(*map(F.lit, v))), F.lit(k)) for k, v in BLOCKS.items()]), lambda x: x.isNotNull())).alias("block"))
    total = works.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy("block").agg(n_works()).withColumn("pct", share_of(F.col("n_works"), total))


def element_by_year(works: DataFrame, field: str) -> DataFrame:
    """Element x year counts with absent years as zero."""
    counts = works.where(F.col("publication_year").isNotNull()).select("publication_year", F.explode(F.array_distinct(field)).alias("item")).groupBy("item", "publication_year").agg(n_works())
    span = works.agg(F.min("publication_year").alias("a"), F.max("publication_year").alias("b"))
    years = F.explode(F.sequence(span.select("a").scalar(), span.select("b").scalar())).alias("publication_year")
    grid = counts.select("item").distinct().select("item", years)
    return grid.join(counts, ["item", "publication_year"], "left").select("item", "publication_year", F.coalesce("n_works", F.lit(0)).alias("n_works"))


def journal_profile(works: DataFrame) -> DataFrame:
    """Per journal: ratio of sums for FWCI, shares, and the prevailing open-access pathway."""
    rows = works.where(F.col("journal_name").isNotNull()).groupBy("journal_name").agg(n_works(), F.sum("cited_by_count").alias("cites"), F.sum("fwci").alias("fwci_sum"), F.sum("is_top_10").alias("top_10"), F.sum(F.col("is_oa").cast("int")).alias("oa"), F.count_if(F.col("oa_status") == "diamond").alias("n_diamond"), F.count_if(F.col("oa_status") == "gold").alias("n_gold"))
    n = F.greatest(F.col("n_works"), F.lit(1))
    path = F.when(F.col("n_diamond") * 2 > F.col("n_works"), "diamond").when((F.col("n_diamond") + F.col("n_gold")) * 2 > F.col("n_works"), "gold").when(F.col("oa") > 0, "hybrid").otherwise("closed")
    return rows.select("journal_name", "n_works", "cites", (F.coalesce("fwci_sum", F.lit(0)).cast("double") / n).alias("mean_fwci"), share_of(F.col("top_10"), F.col("n_works")).alias("pct_top_10"), share_of(F.col("oa"), F.col("n_works")).alias("pct_oa"), path.alias("pathway"))


def institution_fingerprint(works: DataFrame, field: str = "affiliations") -> DataFrame:
    """Shares that describe an institution: open access, excellence, solo and joint works, breadth, each also as a score capped at 100."""
    rows = works.select(F.explode(F.array_distinct(field)).alias("institution"), "is_oa", "is_top_10", F.size("author_names").alias("na"), F.size("countries").alias("nc"), F.explode_outer("topics").alias("topic"), "id")
    flags = rows.groupBy("institution").agg(F.countDistinct("id").alias("n_works"), F.countDistinct("topic").alias("n_topics"))
    one = works.select(F.explode(F.array_distinct(field)).alias("institution"), "is_oa", "is_top_10", F.size("author_names").alias("na"), F.size("countries").alias("nc")).groupBy("institution").agg(
        share_of(F.count_if(F.col("is_oa")), F.count(F.lit(1))).alias("pct_oa"), share_of(F.sum("is_top_10"), F.count(F.lit(1))).alias("pct_top_10"), share_of(F.count_if(F.col("na") == 1), F.count(F.lit(1))).alias("pct_solo"), share_of(F.count_if(F.col("nc") > 1), F.count(F.lit(1))).alias("pct_international")
    )
    return flags.join(one, "institution").withColumn("excellence_score", F.least(F.col("pct_top_10") * 5, F.lit(100.0)))


def health_report(works: DataFrame) -> DataFrame:
    """One row that describes a corpus: documents, authors, sources, countries, team size, citations."""
    authors = works.select(F.explode("author_names").alias("a")).agg(F.countDistinct("a").alias("n")).scalar()
    countries = works.select(F.explode("countries").alias("a")).agg(F.countDistinct("a").alias("n")).scalar()
    na = F.size("author_names")
    return works.agg(
        n_works(), authors.alias("n_authors"), F.countDistinct("journal_name").alias("n_sources"), countries.alias("n_countries"), F.count_if(na == 1).alias("n_single"), F.count_if(na > 1).alias("n_multi"), F.sum("cited_by_count").alias("cites"), mean_of("cited_by_count").alias("cites_per_work"), mean_of(na).alias("authors_per_work"),
        F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"),
    )


def country_collaboration(works: DataFrame) -> DataFrame:
    """Per country: single-country and multi-country works and the multi share."""
    rows = works.select(F.explode("countries").alias("country"), (F.size("countries") > 1).alias("multi"))
    return rows.groupBy("country").agg(n_works(), F.count_if(~F.col("multi")).alias("scp"), F.count_if("multi").alias("mcp")).withColumn("mcp_ratio", share_of(F.col("mcp"), F.col("n_works"), 1.0))


def pair_flow(works: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of (left, right) element pairs within a work, for flow diagrams."""
    a = works.select("id", F.explode(F.array_distinct(left)).alias("source"), F.col(right).alias("r"))
    right_side = F.explode(F.array_distinct("r")) if dict(works.dtypes)[right].startswith("array") else F.col("r")
    return a.select("source", right_side.alias("target")).where(F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).alias("value"))


def with_block(df: DataFrame, country: str) -> DataFrame:
    """Adds the first regional block of a country, ``other`` if none."""
    block = F.lit("other")
    for name, members in reversed(BLOCKS.items()):
        block = F.when(F.col(country).isin(*members), name).otherwise(block)
    return df.withColumn("block", block)
