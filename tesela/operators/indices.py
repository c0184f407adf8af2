"""Author, concentration and growth indices, and time-series operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.plans.corpus import share_of


def author_metrics(works: DataFrame, current_year: int, author: str = "author_names") -> DataFrame:
    """Per author: documents, citations, h, g, m, e and i10 indices and first year.

    Ranks inside an author come from one window over (author, citations); h is the number of
    ranks whose citations reach the rank, g the last rank whose running sum reaches its square.
    """
    rows = works.select(F.explode(F.array_distinct(author)).alias("author"), "cited_by_count", "publication_year", "id")
    w = Window.partitionBy("author").orderBy(F.desc("cited_by_count"), "id")
    ranked = rows.withColumn("r", F.row_number().over(w)).withColumn("cum", F.sum("cited_by_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_h = F.col("cited_by_count") >= F.col("r")
    out = ranked.groupBy("author").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("cited_by_count").alias("cites"), F.count_if(in_h).alias("h_index"), F.coalesce(F.max(F.when(F.col("cum") >= F.col("r") * F.col("r"), F.col("r"))), F.lit(0)).alias("g_index"),
        F.sum(F.when(in_h, F.col("cited_by_count")).otherwise(0)).alias("core"), F.count_if(F.col("cited_by_count") >= 10).alias("i10_index"), F.min("publication_year").alias("first_year"),
    )
    years = F.greatest(F.lit(current_year) - F.col("first_year"), F.lit(1))
    return out.withColumn("m_index", F.col("h_index").cast("double") / years).withColumn("e_index", F.sqrt((F.col("core") - F.col("h_index") * F.col("h_index")).cast("double"))).drop("core")


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of non-negative integer values, from value frequencies.

    Frequencies, not rows, are ordered: rank sums of equal values have a closed form, so the one
    window runs over distinct values.
    """
    freq = df.where(F.col(value) >= 0).groupBy(F.col(value).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("x")) - F.col("n")
    parts = freq.withColumn("before", before).select("x", "n", (F.col("n") * (2 * F.col("before") + F.col("n") + 1)).alias("rank2"))
    t = parts.agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"), F.sum(F.col("x") * F.col("rank2")).alias("ws"))
    return t.select(F.try_divide((F.col("ws") - (F.col("n") + 1) * F.col("s")).cast("double"), (F.col("n") * F.col("s")).cast("double")).alias("gini"))


def productivity(works: DataFrame, author: str = "author_names") -> DataFrame:
    """``x, y``: number of authors y with exactly x works."""
    per = works.select(F.explode(F.array_distinct(author)).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("x"))
    return per.groupBy("x").agg(F.count(F.lit(1)).alias("y"))


def lotka_fit(freq: DataFrame, mode: str = "corpus") -> DataFrame:
    """Lotka exponent and constant from ``x, y`` by least squares in log-log space.

    ``corpus``: all points, constant e**intercept. ``linear_r2``: also R² of predictions in linear
    space. ``eda``: x up to 15, log of the share of authors, exponent kept in [1.1, 3.5], constant
    normalised over the powers of 1 to 100. Fewer than two points give nulls.
    """
    points = freq
    if mode == "eda":
        share = F.col("y").cast("double") / F.sum("y").over(Window.partitionBy())
        points = freq.withColumn("share", share).where(F.col("x") <= 15)
    lx, ly = F.ln(F.col("x").cast("double")), F.ln(F.col("share") if mode == "eda" else F.col("y").cast("double"))
    fit = points.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.count(F.lit(1)).alias("n_points"))
    if mode == "eda":
        beta = F.least(F.greatest(-F.col("slope"), F.lit(1.1)), F.lit(3.5))
        return fit.select(F.round(beta, 8).alias("beta"), "n_points", beta.alias("beta_")).withColumn("c", F.round(1 / F.expr("aggregate(sequence(1, 100), 0.0D, (acc, k) -> acc + pow(cast(k as double), -beta_))"), 8)).drop("beta_")
    base = fit.select((-F.col("slope")).alias("b"), F.exp("intercept").alias("c0"), "n_points")
    if mode == "linear_r2":
        mean = freq.agg(F.avg("y").alias("m"))
        joined = freq.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(mean))
        predicted = F.col("c0") * F.pow(F.col("x").cast("double"), -F.col("b"))
        return joined.agg(F.round(F.first("b"), 8).alias("beta"), F.round(F.first("c0"), 8).alias("c"), F.max("n_points").alias("n_points"), F.round(1 - F.sum(F.pow(F.col("y") - predicted, F.lit(2.0))) / F.sum(F.pow(F.col("y") - F.col("m"), F.lit(2.0))), 6).alias("r2"))
    return base.select(F.round("b", 8).alias("beta"), F.round("c0", 8).alias("c"), "n_points")


def bradford(works: DataFrame, mode: str = "inner") -> DataFrame:
    """Journals ranked by works with cumulative counts and Bradford zone.

    ``inner``: a journal that crosses a third stays in the inner zone; ``within``: zones end at the
    last journal whose cumulative count is within the third, the first journal always in zone 1.
    """
    per = works.where(F.col("journal_name").isNotNull()).groupBy("journal_name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "journal_name")
    ranked = per.withColumn("rank", F.row_number().over(order)).withColumn("cum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = F.col("cum") - F.col("n") if mode == "inner" else F.col("cum")
    strict = (lambda k: at * 3 < F.col("total") * k) if mode == "inner" else (lambda k: at * 3 <= F.col("total") * k)
    zone = F.when(strict(1) | (F.col("rank") == 1), 1).when(strict(2), 2).otherwise(3)
    return ranked.select("journal_name", "n", "rank", "cum", share_of(F.col("cum"), F.col("total")).alias("cum_pct"), zone.alias("zone"))


def price_immediacy(works: DataFrame, years: int = 5) -> DataFrame:
    """Share of references to works of the last years before the citing one, with its class."""
    ages = works.select(F.col("publication_year").alias("citing"), F.explode("references").alias("ref")).join(works.select(F.col("id").alias("ref"), F.col("publication_year").alias("cited")), "ref").where(F.col("citing").isNotNull() & F.col("cited").isNotNull())
    out = ages.agg(F.count(F.lit(1)).alias("n_refs"), F.count_if((F.col("citing") - F.col("cited") <= years) & (F.col("citing") >= F.col("cited"))).alias("n_recent"))
    pct = share_of(F.col("n_recent"), F.col("n_refs"))
    return out.withColumn("pct", pct).withColumn("klass", F.when(F.col("pct") >= 40, "high").when(F.col("pct") >= 20, "medium").otherwise("low"))


def price_root(freq: DataFrame) -> DataFrame:
    """Share of works by the most productive √n authors, from ``x, y`` frequencies."""
    order = Window.orderBy(F.desc("x"))
    rows = freq.withColumn("before", F.sum("y").over(order) - F.col("y")).withColumn("n", F.sum("y").over(Window.partitionBy())).withColumn("works", F.sum(F.col("x") * F.col("y")).over(Window.partitionBy()))
    root = F.floor(F.sqrt(F.col("n").cast("double")))
    taken = F.greatest(F.least(F.col("y"), root - F.col("before")), F.lit(0))
    out = rows.agg(F.max("n").alias("n_authors"), F.max(root).alias("n_top"), F.sum(taken * F.col("x")).alias("top_works"), F.max("works").alias("works"))
    return out.select("n_authors", "n_top", share_of(F.col("top_works"), F.col("works"), 1.0).alias("share"), (F.col("top_works") * 10 >= F.col("works") * 4).alias("concentrated"))


def annual_production(works: DataFrame, first: int, last: int) -> DataFrame:
    """Works and citations of every year of a span, absent years as zero, with the compound growth rate of the span."""
    counts = works.groupBy("publication_year").agg(F.count(F.lit(1)).alias("n"), F.sum("cited_by_count").alias("cites"))
    years = works.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("publication_year"))
    rows = years.join(counts, "publication_year", "left").select("publication_year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cites", F.lit(0)).alias("cites"))
    seen = rows.where(F.col("n") > 0).agg(F.min(F.struct("publication_year", "n")).alias("a"), F.max(F.struct("publication_year", "n")).alias("b"))
    cagr = seen.select(F.when(F.col("b.publication_year") > F.col("a.publication_year"), F.round(F.pow(F.col("b.n").cast("double") / F.col("a.n"), 1.0 / (F.col("b.publication_year") - F.col("a.publication_year"))) - 1, 8)).alias("c")).scalar()
    return rows.withColumn("cites_per_work", share_of(F.col("cites"), F.col("n"), 1.0)).withColumn("cagr", cagr)


def upper_median(c: str) -> Column:
    """The element at position n // 2 of the sorted values; partial sums hold counts of distinct values, not the values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def quadrants(df: DataFrame, key: str, volume: str, impact: str, impact_cut: float = 1.0) -> DataFrame:
    """Quadrant of every entity by the upper median of volume and a cut of impact."""
    cut = df.agg(upper_median(volume).alias("m")).scalar()
    high, strong = F.col(volume) >= F.col("cut"), F.coalesce(F.col(impact) >= impact_cut, F.lit(False))
    label = F.when(high & strong, "leader").when(high, "volume").when(strong, "niche").otherwise("peripheral")
    return df.withColumn("cut", cut).select(key, volume, impact, label.alias("quadrant"))


def growth_matrix(series: DataFrame, key: str, time: str, value: str, last: int = 4) -> DataFrame:
    """Compound growth over the last points of each series, final value, and quadrant by their upper medians."""
    order = Window.partitionBy(key).orderBy(F.desc(time))
    tail = series.withColumn("r", F.row_number().over(order)).where(F.col("r") <= last)
    ends = tail.groupBy(key).agg(F.max_by(value, time).alias("v_last"), F.min_by(value, time).alias("v_first"), F.count(F.lit(1)).alias("n_points"))
    rate = F.when((F.col("v_first") > 0) & (F.col("n_points") > 1), F.round(F.pow(F.col("v_last").cast("double") / F.col("v_first"), 1.0 / (F.col("n_points") - 1)) - 1, 8)).otherwise(0.0)
    rows = ends.withColumn("cagr", rate)
    m = rows.agg(upper_median("v_last").alias("v"), upper_median("cagr").alias("c"))
    big, fast = F.col("v_last") >= m.select("v").scalar(), F.col("cagr") >= m.select("c").scalar()
    return rows.select(key, "v_last", "cagr", F.when(big & fast, "star").when(big, "mature").when(fast, "emerging").otherwise("declining").alias("quadrant"))


def smooth(series: DataFrame, key: str, time: str, value: str, span: int) -> DataFrame:
    """Exponential smoothing y_t = a x_t + (1 - a) y_(t-1) with a = 2 / (span + 1), per entity.

    A fold over the time-ordered values of an entity; a series has one value per period.
    """
    a = 2.0 / (span + 1)
    folded = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("x")))).alias("s"))
    steps = F.expr(f"aggregate(s, cast(array() as array<double>), (acc, p) -> concat(acc, array(if(size(acc) = 0, p.x, {a}D * p.x + {1 - a}D * element_at(acc, -1)))))")
    return folded.select(key, F.explode(F.arrays_zip("s", steps.alias("y"))).alias("p")).select(key, F.col("p.s.t").alias(time), F.col("p.s.x").alias(value), F.round("p.y", 8).alias("smoothed"))


def rpys(works: DataFrame) -> DataFrame:
    """Reference publication year spectroscopy: cited works per year, signed deviation from the median of five years, rank of the deviation (lowest first).

    References younger than two years before the citing work do not count.
    """
    years = works.select(F.col("publication_year").alias("citing"), F.explode("references").alias("ref")).join(works.select(F.col("id").alias("ref"), F.col("publication_year").alias("year")), "ref").where(F.col("citing") >= F.col("year") + 2)
    counts = years.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    around = Window.orderBy("year").rangeBetween(-2, 2)
    median = counts.withColumn("median", F.expr("percentile(n, 0.5)").over(around))
    return median.withColumn("deviation", F.col("n") - F.col("median")).withColumn("rank", F.row_number().over(Window.orderBy("deviation", "year")))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: min, max, mean, median, population deviation, missing and zero counts."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.explode(parts).alias("x")).select("x.*")
    return rows.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 8).alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.round(F.stddev_pop("v"), 6).alias("std"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(F.col("v") == 0).alias("n_zero"))
