"""Reciprocal pairs batch by batch, for edge lists whose shuffle is better done in pieces that can be resumed.

The directed references are dealt once to folders by the pair's smaller number modulo the batches, so that a batch reads its
own folder only. Each batch is then one grouping, written over its own partition, and named in _committed when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import work_id
from ..operators.graph import edge_list
from ..sources import writers


class PairBatches:
    """Tables <folder>/halves and <folder>/pairs."""

    def __init__(self, spark: SparkSession, folder: str, batches: int = 20):
        self.spark, self.folder, self.batches = spark, folder.rstrip("/"), batches

    def deal(self, edges: DataFrame, files: int = 8) -> None:
        """Writes the halves (a < b, up: whether a lists b), in about so many files a batch."""
        halves = edge_list(edges).where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
        halves = halves.withColumn("batch", (F.col("a") % self.batches).cast("int"))
        dealt = halves.repartition(self.batches * files, "batch", F.pmod(F.xxhash64("a", "b"), F.lit(files)))
        dealt.write.mode("overwrite").partitionBy("batch").parquet(f"{self.folder}/halves")
        for done in self.done():
            self.forget(done)

    def done(self) -> list[int]:
        return writers._versions(self.spark, self.folder, "_committed")

    def forget(self, batch: int) -> None:
        """The batch is to be built again."""
        fs, to = writers._files(self.spark, self.folder)
        fs.delete(to(f"{self.folder}/_committed/{batch}"), False)
        fs.delete(to(f"{self.folder}/pairs/batch={batch}"), True)

    def halves(self, batch: int) -> DataFrame:
        return self.spark.read.schema("a long, b long, up boolean, batch int").parquet(f"{self.folder}/halves").where(F.col("batch") == batch)

    def build(self, batch: int) -> DataFrame:
        seen = self.halves(batch).groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
        return seen.where("up and down").select(work_id("a").alias("paper_a"), work_id("b").alias("paper_b"), F.lit(batch).alias("batch"))

    def run(self) -> list[int]:
        """Builds the batches that aren't done; returns them."""
        fs, to = writers._files(self.spark, self.folder)
        held = set(self.done())
        missing = [k for k in range(self.batches) if k not in held]
        for batch in missing:
            # a batch without pairs has no partition; what a broken-off try left in it goes first
            fs.delete(to(f"{self.folder}/pairs/batch={batch}"), True)
            self.build(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/pairs")
            fs.create(to(f"{self.folder}/_committed/{batch}"), True).close()
        return missing

    def pairs(self) -> DataFrame:
        """paper_a, paper_b of the batches that are done."""
        return self.spark.read.schema("paper_a string, paper_b string, batch int").parquet(f"{self.folder}/pairs").where(F.col("batch").isin(self.done())).drop("batch")
