"""Incremental, resumable ingest of works: each file once, however often the job is started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest
from ..sources import schemas


def works_stream(spark: SparkSession, path: str, files_per_batch: int = 25, suffix: str = "*.gz", options: dict[str, str] = {}) -> DataFrame:
    """New work files under path as a stream; a batch takes at most so many files."""
    reader = spark.readStream.options(**options).schema(schemas.WORKS).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).json(path)


def ingest_available(
    spark: SparkSession, path: str, out: str, checkpoint: str, first_year: int = 1975, last_year: int = 2023, files_per_batch: int = 25, suffix: str = "*.gz", options: dict[str, str] = {}
) -> None:
    """Writes <out>/attributes and <out>/edges from the files that came since the last call, and returns.

    Each file is parsed once for both tables. A batch of files is a folder batch=<number> of either table, which a batch
    that is done again replaces: the source's log gives it the same files. So a run that is broken off leaves nothing twice,
    and the next one goes on from there. Reading a table gives the column `batch` besides.
    """

    def both(works: DataFrame, batch: int) -> None:
        works.persist()
        try:
            for name, table in (("attributes", ingest.attributes), ("edges", ingest.edges)):
                table(works, first_year, last_year).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        finally:
            works.unpersist()

    works = works_stream(spark, path, files_per_batch, suffix, options)
    works.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def earlier_available(spark: SparkSession, path: str, out: str, checkpoint: str, before: int = 1975, files_per_batch: int = 25, suffix: str = "*.parquet", options: dict[str, str] = {}) -> None:
    """Writes to `out` id and field of earlier works, from the Parquet files that came since the last call, and returns.

    The file source's log and the file sink's commit log make it exactly-once.
    """
    reader = spark.readStream.options(**options).schema(schemas.WORKS_PARQUET).option("maxFilesPerTrigger", files_per_batch)
    works = reader.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).parquet(path)
    stream = ingest.earlier_fields(works, before).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
