"""Scans: works as JSON lines or Parquet, manifests, and CSV with the quoting that free-text columns need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

#: Doubled quotes inside quotes, line breaks inside quotes, no limit on a field's length.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "maxCharsPerColumn": -1}
#: Options of a read from a public bucket: no credentials, patient retries. Hadoop's file system gets them from the reader.
PUBLIC = {
    "fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    "fs.s3a.attempts.maximum": "10",
    "fs.s3a.connection.timeout": "60000",
}


def works_json(spark: SparkSession, path: str | list[str], suffix: str = "*.gz", max_files: int | None = None, options: dict[str, str] = {}) -> DataFrame:
    """Works as JSON lines under path (searched to the bottom). max_files: the first so many files by name, a whole-file sample.

    options: of the reader, such as PUBLIC.
    """
    reader = spark.read.options(**options).schema(schemas.WORKS).option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    if max_files is None:
        return reader.json(path)
    names = spark.read.options(**options).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path).select("path").orderBy("path").limit(max_files)
    return reader.json([r["path"] for r in names.collect()])  # at most max_files names


def works_variant(spark: SparkSession, path: str | list[str], suffix: str = "*.gz", options: dict[str, str] = {}) -> DataFrame:
    """work: each JSON line under path as a VARIANT, which tells a null from what isn't there; null where a line is no JSON."""
    reader = spark.read.options(**options).option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    return reader.text(path).select(F.try_parse_json("value").alias("work"))


def manifest(spark: SparkSession, path: str, options: dict[str, str] = {}) -> DataFrame:
    """url of each file that a manifest lists."""
    return spark.read.options(**options).schema(schemas.MANIFEST).option("multiLine", True).json(path).select(F.explode("files.url").alias("url"))


def works_parquet(spark: SparkSession, *paths: str, options: dict[str, str] = {}) -> DataFrame:
    return spark.read.options(**options).schema(schemas.WORKS_PARQUET).parquet(*paths)


def csv(spark: SparkSession, path: str, schema: str, skip_bad: bool = False) -> DataFrame:
    """A CSV with header. skip_bad drops rows with too few or too many cells; else they're an error.

    All columns are parsed before any is dropped, as a row's fate must not hang on what is selected from it.
    """
    reader = spark.read.schema(schema).options(**CSV).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    return reader.option("columnPruning", False).csv(path)


def check_header(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """The columns among `wanted` that the file's header lacks."""
    found = spark.read.options(**CSV).csv(path).columns
    return [c for c in wanted if c not in found]
