"""Catalog tables bucketed and sorted by a number, so that tables of one key join without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .writers import RowCountMismatch, _files

COMMITTED = "loomgraph.committed"


class Tables:
    """Tables <prefix>_<name>_v<version> of the session's catalog, each of `buckets` buckets; folder: where their files lie, if not in the warehouse.

    A table is there once its version carries the property COMMITTED, which is set after its rows were counted as they were
    written. Readers of the version before aren't disturbed; the one before that is dropped.
    """

    def __init__(self, spark: SparkSession, prefix: str, buckets: int = 64, folder: str | None = None):
        self.spark, self.prefix, self.buckets, self.folder = spark, prefix, buckets, folder

    def _versions(self, name: str, committed: bool) -> list[int]:
        start = f"{self.prefix}_{name}_v".lower()
        found = [t.name.lower().removeprefix(start) for t in self.spark.catalog.listTables(pattern=f"{start}*")]
        return sorted(int(v) for v in found if v.isdigit() and (not committed or self._committed(f"{start}{v}")))

    def _committed(self, table: str) -> bool:
        return any(r["key"] == COMMITTED for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect())

    def _drop(self, table: str) -> None:
        """With its files, which the catalog leaves where it was told a folder."""
        where = [r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Location"]
        self.spark.sql(f"DROP TABLE {table}")
        for path in where:
            fs, to = _files(self.spark, path)
            fs.delete(to(path), True)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name, True))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name, True)
        if not versions:
            raise FileNotFoundError(f"there is no table {name!r} of {self.prefix}")
        return self.spark.table(f"{self.prefix}_{name}_v{versions[-1]}")

    def save(self, name: str, df: DataFrame, key: str, expected: int | None = None) -> int:
        """Writes df as the next version, a file a bucket. Raises RowCountMismatch, and keeps the version before, if the rows aren't as many as expected."""
        held = self._versions(name, False)
        table, seen = f"{self.prefix}_{name}_v{max(held, default=0) + 1}", Observation()
        # repartition() and bucketBy() deal by the same hash: each task has one bucket
        writer = df.repartition(self.buckets, key).observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(self.buckets, key).sortBy(key)
        (writer.option("path", f"{self.folder}/{table}-{uuid.uuid4().hex}") if self.folder else writer).saveAsTable(table)
        if expected is not None and seen.get["n"] != expected:
            self._drop(table)
            raise RowCountMismatch(f"{table}: {seen.get['n']} rows, expected {expected}")
        keep = self._versions(name, True)[-1:]
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{COMMITTED}' = 'true')")
        for old in held:
            if old not in keep:
                self._drop(f"{self.prefix}_{name}_v{old}")
        return seen.get["n"]
