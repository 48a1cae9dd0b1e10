"""The reference graph: edge lists, vertex sets, induced parts and reciprocal pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pid, targets, work_id
from .ingest import UNKNOWN


def edge_list(edges: DataFrame) -> DataFrame:
    """src, dst: a row for each listed reference, repeats and self-references too."""
    return edges.select(pid("source").alias("src"), F.explode(targets()).alias("t")).select("src", pid("t").alias("dst"))


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(pid("source").alias("id")).distinct()


def cited(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(targets()).alias("t")).select(pid("t").alias("id")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Ids that cite or are cited: one distinct over both ends, with no sets built apart first."""
    ends = edges.select(F.explode(F.concat(F.array("source"), targets())).alias("t"))
    return ends.select(pid("t").alias("id")).distinct()


def isolated(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    return attributes.withColumn("pid", pid("id")).join(connected(edges).withColumnRenamed("id", "pid"), "pid", "left_anti").drop("pid")


def retain_connected(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    return attributes.withColumn("pid", pid("id")).join(connected(edges).withColumnRenamed("id", "pid"), "pid", "left_semi").drop("pid")


def clean_attributes(attributes: DataFrame) -> DataFrame:
    """Papers with a known field; null fields go too."""
    return attributes.where(F.col("field") != UNKNOWN)


def clean_edges(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Adjacency lists whose source is among the papers; targets stay as they are."""
    return edges.join(attributes.select(F.col("id").alias("source")), "source", "left_semi")


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """paper_a, paper_b (a < b by number): pairs that list each other. Repeats change nothing.

    One grouping by the unordered pair, which begins map-side, and no other shuffle: that both directions are seen implies
    that both papers are sources, so targets needn't be held against the sources first.
    """
    seen = edge_list(edges).where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down")
    )
    return seen.where("up and down").select(work_id("a").alias("paper_a"), work_id("b").alias("paper_b"))


def pair_batches(pairs: DataFrame, batches: int = 20) -> DataFrame:
    """batch_num, n_pairs: pairs by the smaller number modulo `batches`."""
    return pairs.groupBy((pid("paper_a") % batches).cast("int").alias("batch_num")).agg(F.count(F.lit(1)).alias("n_pairs"))
