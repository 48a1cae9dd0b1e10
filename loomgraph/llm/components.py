"""Connected components of an edge table by alternating large-star and small-star steps, each a grouping that begins map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points at the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, point at the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pointed = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node points at one that points nowhere: no node has two targets, and no target has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the component is its least node. Rows of one node point at itself."""
    now = materialize(_small_star(_large_star(edges.where("a != b").select("a", "b"))))
    while not _settled(now):
        before, now = now, materialize(_small_star(_large_star(now)))
        discard(before)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    discard(now)
    return out
