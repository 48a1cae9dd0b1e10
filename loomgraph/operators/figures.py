"""Yearly series, deciles of reference counts, and the lag between the papers of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import number
from ..functions.ratios import percent

DIVERSE, NOT_DIVERSE = "diverse", "non-diverse"


def cohort(attributes: DataFrame, n_cited: DataFrame, n_mutual: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Papers of the window with references: id, year, n_cited, n_mutual (0 if none) and diversity_count if there is one."""
    kept = [c for c in ("year", "diversity_count") if c in attributes.columns]
    papers = attributes.where(F.col("year").between(first_year, last_year)).select(number(attributes).alias("id"), *kept)
    return n_cited.join(papers, "id").join(n_mutual, "id", "left").withColumn("n_mutual", F.coalesce("n_mutual", F.lit(0)))


def papers_per_year(attributes: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return attributes.where(F.col("year").between(first_year, last_year)).groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"))


def growth(per_year: DataFrame) -> DataFrame:
    """From the first year that has papers to the last, in one pass."""
    ends = per_year.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n_papers", "year").alias("first_n"), F.max_by("n_papers", "year").alias("last_n")
    )
    return ends.withColumn("growth_pct", percent(F.col("last_n") - F.col("first_n"), F.col("first_n")))


def mean_mutual_per_year(papers: DataFrame, min_papers: int) -> DataFrame:
    by_year = papers.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"), F.avg("n_mutual").alias("mean_mutual"))
    return by_year.where(F.col("n_papers") >= min_papers)


def mutual_rate_per_year(papers: DataFrame, min_papers: int) -> DataFrame:
    """Pooled rate: all reciprocal partners over all references of a year, not the mean of papers' rates."""
    by_year = papers.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"), F.sum("n_cited").alias("sum_cited"), F.sum("n_mutual").alias("sum_mutual"))
    return by_year.where(F.col("n_papers") >= min_papers).withColumn("rate_pct", percent(F.col("sum_mutual"), F.col("sum_cited")))


def value_deciles(papers: DataFrame) -> DataFrame:
    """n_cited, n_papers, decile: all papers with one count fall in one decile, that of the middle of their block.

    The windows run over the histogram, a row for each distinct count.
    """
    counts = papers.groupBy("n_cited").agg(F.count(F.lit(1)).alias("n_papers"))
    before = F.coalesce(F.sum("n_papers").over(Window.orderBy("n_cited").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_papers").over(Window.partitionBy())
    middle = (before + F.col("n_papers") / F.lit(2.0)) / total
    decile = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(middle * F.lit(10.0)).cast("int") + 1))
    return counts.select("n_cited", "n_papers", decile.alias("decile"))


def grouped(papers: DataFrame) -> DataFrame:
    """Papers with decile and group (null for diversity 0 or unknown). Deciles are built on all of them."""
    group = F.when(F.col("diversity_count").between(1, 2), NOT_DIVERSE).when(F.col("diversity_count") >= 3, DIVERSE)
    # The histogram has a row a distinct count; whether it is small enough to broadcast is left to its measured size.
    return papers.join(value_deciles(papers).select("n_cited", "decile"), "n_cited").withColumn("group", group)


def decile_share(papers: DataFrame) -> DataFrame:
    """By decile and group: the share of papers with any reciprocal partner."""
    by = papers.where("group is not null").groupBy("decile", "group").agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("n_mutual") > 0).alias("n_with_mutual"))
    return by.withColumn("share_pct", percent(F.col("n_with_mutual"), F.col("n_papers")))


def decile_rate(papers: DataFrame) -> DataFrame:
    by = papers.where("group is not null").groupBy("decile", "group").agg(F.count(F.lit(1)).alias("n_papers"), F.sum("n_cited").alias("sum_cited"), F.sum("n_mutual").alias("sum_mutual"))
    return by.withColumn("rate_pct", percent(F.col("sum_mutual"), F.col("sum_cited")))


def decile_sizes(papers: DataFrame) -> DataFrame:
    return papers.groupBy("decile").agg(F.count(F.lit(1)).alias("n_papers"))


def decile_diagnostics(in_window: DataFrame, n_cited: DataFrame, least: int = 3) -> DataFrame:
    """One row: the cohort's size, what was left out for few references or for its year, papers of diversity 0, and counts in two deciles (0)."""
    papers = in_window.where(F.col("n_cited") >= least)
    sizes = in_window.agg(
        F.count_if(F.col("n_cited") >= least).alias("n_cohort"), F.count_if(F.col("n_cited") < least).alias("n_under"),
        F.count_if((F.col("n_cited") >= least) & (F.col("diversity_count") == 0)).alias("n_zero_diversity"),
    )
    every = n_cited.agg(F.count_if(F.col("n_cited") >= least).alias("n_all_years"))
    split = grouped(papers).groupBy("n_cited").agg(F.count_distinct("decile").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n_split"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  of one row each
    joined = one(sizes).join(one(every), "__one").join(one(split), "__one")
    return joined.select("n_cohort", "n_under", (F.col("n_all_years") - F.col("n_cohort")).alias("n_year_excluded"), "n_zero_diversity", "n_split")


def citation_lag(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Cumulative: pairs whose papers' years lie within 0 to 3 of each other. Joined on the id strings, two columns of the papers."""
    years = attributes.select("id", "year")
    gaps = (
        pairs.join(years.select(F.col("id").alias("paper_a"), F.col("year").alias("year_a")), "paper_a")
        .join(years.select(F.col("id").alias("paper_b"), F.col("year").alias("year_b")), "paper_b")
        .select(F.abs(F.col("year_a") - F.col("year_b")).alias("gap"))
    )
    names = ["same_year", "within_1_year", "within_2_years", "within_3_years"]
    counts = gaps.agg(*[F.count_if(F.col("gap") <= k).alias(name) for k, name in enumerate(names)], F.count(F.lit(1)).alias("n_total"))
    rows = counts.select("n_total", F.explode(F.array(*[F.struct(F.lit(n).alias("threshold"), F.col(n).alias("n_pairs")) for n in names])).alias("r"))
    return rows.select("r.threshold", "r.n_pairs", "n_total", percent(F.col("r.n_pairs"), F.col("n_total"), 0.0).alias("cumulative_pct"))
