"""Ingest part by part with a ledger: every part is named once, with its rows, what was rejected, or why it couldn't be read.

Parts (files) are taken in batches. A batch writes its tables, then its rejected lines, and last its ledger rows, which commit
it: a batch that was broken off is done again under the same number and replaces what it left. A part that can't be read
to its end (a truncated archive, say) is left out whole and named with the error; the others of its batch are kept whole.
Which parts there are comes from a listing of the storage, or from a manifest: then nothing else is read.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, validation
from ..sources import readers, schemas
from ..sources.writers import _files

LEDGER = "part string, length long, n_rows long, n_rejected long, error string, batch int"
REJECTS = "part string, line string, batch int"
CORRUPT = "_corrupt_record"
#: What a part that can't be read raises, in its worker or while it is planned.
FAILURES = (PySparkException, Py4JJavaError)


def _reason(e: Exception) -> str:
    if not isinstance(e, Py4JJavaError):
        return str(e).strip().splitlines()[0][:500]
    cause = e.java_exception
    while cause.getCause() is not None:
        cause = cause.getCause()
    return cause.toString()[:500]


def listed(spark: SparkSession, path: str | list[str], suffix: str = "*.gz", options: dict[str, str] = {}) -> DataFrame:
    """part, path, length of each file under path, or of each file of a list of paths. No content is read."""
    files = spark.read.options(**options).format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("part"), "path", "length")


def manifest_parts(spark: SparkSession, manifest: str, suffix: str = "*.parquet", options: dict[str, str] = {}) -> DataFrame:
    """As listed(), of the files that a manifest names; a named file that isn't there is an error."""
    urls = [r["url"] for r in readers.manifest(spark, manifest, options).distinct().orderBy("url").collect()]  # names of files
    return listed(spark, urls, suffix, options)


def json_works(spark: SparkSession, paths: list[str], options: dict[str, str] = {}) -> DataFrame:
    """Works of JSON lines with part and, for a line that is no record, CORRUPT."""
    reader = spark.read.options(**options).schema(f"{schemas.WORKS}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(paths).select("*", F.col("_metadata.file_path").alias("part"))


def parquet_works(spark: SparkSession, paths: list[str], options: dict[str, str] = {}) -> DataFrame:
    works = spark.read.options(**options).schema(schemas.WORKS_PARQUET).parquet(*paths)
    return works.select("*", F.lit(None).cast("string").alias(CORRUPT), F.col("_metadata.file_path").alias("part"))


class Parts:
    """read: (spark, paths) to works with part and CORRUPT; tables: name to a function of works."""

    def __init__(self, spark: SparkSession, out: str, read: Callable[[SparkSession, list[str]], DataFrame], tables: dict[str, Callable[[DataFrame], DataFrame]], per_batch: int = 25):
        self.spark, self.out, self.read, self.tables, self.per_batch = spark, out.rstrip("/"), read, tables, per_batch

    def _stored(self, name: str, schema: str) -> DataFrame:
        fs, to = _files(self.spark, self.out)
        if not fs.exists(to(f"{self.out}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/{name}")

    def ledger(self) -> DataFrame:
        """LEDGER of the batches that were committed; a part that was tried again has a row for each try."""
        return self._stored("parts", LEDGER)

    def _committed(self, df: DataFrame) -> DataFrame:
        batches = [r["batch"] for r in self.ledger().select("batch").distinct().collect()]
        return df.where(F.col("batch").isin(batches))  # on the partition column: other folders aren't read

    def rejects(self) -> DataFrame:
        """part and line of what is no record."""
        return self._committed(self._stored("rejects", REJECTS))

    def table(self, name: str) -> DataFrame:
        return self._committed(self.spark.read.parquet(f"{self.out}/{name}")).drop("batch")

    def completeness(self, parts: DataFrame) -> DataFrame:
        """key, state: parts that are there and weren't taken whole (missing), or were and are gone (stale)."""
        done = self.ledger().where("error is null").select(F.col("part").alias("key"))
        return validation.completeness(parts.select(F.col("part").alias("key")), done)

    def run(self, parts: DataFrame) -> int:
        """Takes the parts (of listed()) that the ledger doesn't have, or has with an error and another length; returns the batches done."""
        known = self.ledger()
        settled = known.where("error is null").select("part")
        failed = known.where("error is not null").select("part", "length")
        waiting = parts.join(settled, "part", "left_anti").join(failed, ["part", "length"], "left_anti")
        names = [(r["part"], r["path"], r["length"]) for r in waiting.orderBy("part").collect()]  # names of files
        first = (known.agg(F.max("batch")).first()[0] if names else None) or 0
        starts = range(0, len(names), self.per_batch)
        for k, start in enumerate(starts, first + 1):
            self._batch(k, names[start : start + self.per_batch])
        return len(starts)

    def _batch(self, batch: int, names: list[tuple[str, str, int]]) -> None:
        errors: dict[str, str] = {}
        try:
            counts = self._tables(batch, [path for _, path, _ in names])
        except FAILURES:
            for part, path, _ in names:  # which of them it was; at most per_batch
                try:
                    self.read(self.spark, [path]).write.format("noop").mode("overwrite").save()
                except FAILURES as e:
                    errors[part] = _reason(e)
            if not errors:
                raise
            counts = self._tables(batch, [path for part, path, _ in names if part not in errors])
        rows = [(part, length, *((0, 0) if part in errors else counts.get(part, (0, 0))), errors.get(part)) for part, _, length in names]
        ledger = self.spark.createDataFrame(rows, LEDGER.removesuffix(", batch int")).coalesce(1)
        ledger.write.mode("overwrite").parquet(f"{self.out}/parts/batch={batch}")

    def _tables(self, batch: int, paths: list[str]) -> dict[str, tuple[int, int]]:
        """Writes the batch's tables; rows and rejected lines of each part. Parts are parsed once."""
        fs, to = _files(self.spark, self.out)
        if not paths:
            for name in (*self.tables, "rejects"):
                fs.delete(to(f"{self.out}/{name}/batch={batch}"), True)
            return {}
        works = self.read(self.spark, paths).persist()
        try:
            good = works.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "part")
            for name, table in self.tables.items():
                table(good).write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch}")
            works.where(F.col(CORRUPT).isNotNull()).select("part", F.col(CORRUPT).alias("line")).write.mode("overwrite").parquet(f"{self.out}/rejects/batch={batch}")
            counted = works.groupBy("part").agg(F.count_if(F.col(CORRUPT).isNull()).alias("n"), F.count(CORRUPT).alias("bad")).collect()  # a row a part
        finally:
            works.unpersist()
        return {r["part"]: (r["n"], r["bad"]) for r in counted}


def works_parts(spark: SparkSession, out: str, first_year: int = 1975, last_year: int = 2023, per_batch: int = 25) -> Parts:
    """Parts of JSON lines to the tables attributes and edges."""
    tables = {"attributes": lambda w: ingest.attributes(w, first_year, last_year), "edges": lambda w: ingest.edges(w, first_year, last_year)}
    return Parts(spark, out, json_works, tables, per_batch)


def earlier_parts(spark: SparkSession, out: str, before: int = 1975, per_batch: int = 25) -> Parts:
    """Parquet parts to the table earlier."""
    return Parts(spark, out, parquet_works, {"earlier": lambda w: ingest.earlier_fields(w, before)}, per_batch)
