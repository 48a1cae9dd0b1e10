"""Works as nested records to papers and adjacency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import last_segment, url_pid

UNKNOWN = "Unknown"


def first_field(topics: Column) -> Column:
    """Field of the first topic; UNKNOWN where there is none (get() is null beyond the end, where [0] would fail)."""
    return F.coalesce(F.get(topics, F.lit(0))["field"]["display_name"], F.lit(UNKNOWN))


def null_or_first_field(work: Column) -> Column:
    """Field of the first topic of a VARIANT: null where its name is null, UNKNOWN where the name, the field or the topic isn't there.

    A field that is null, or a topic that is no object, counts as not there.
    """
    name = F.try_variant_get(work, "$.topics[0].field.display_name", "variant")
    return F.when(F.is_variant_null(name), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(work, "$.topics[0].field.display_name", "string"), F.lit(UNKNOWN)))


def from_variant(works: DataFrame) -> DataFrame:
    """Works (column work, a VARIANT) with the columns that attributes() and edges() read, and `field` instead of topics."""
    get = lambda path, kind: F.try_variant_get("work", path, kind)
    return works.select(
        get("$.id", "string").alias("id"), get("$.publication_year", "int").alias("publication_year"), null_or_first_field(F.col("work")).alias("field"),
        get("$.authorships", "array<struct<author: struct<display_name: string>>>").alias("authorships"), get("$.referenced_works", "array<string>").alias("referenced_works"),
    )


def author_list(authorships: Column) -> Column:
    """Names in their order, joined by '; '; missing and empty names are left out."""
    names = F.filter(F.transform(authorships, lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.array_join(names, "; "), F.lit(""))


def in_scope(works: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Works with an id and a year in the window (null years are out)."""
    return works.where(F.col("publication_year").between(first_year, last_year) & (F.col("id") != ""))


def attributes(works: DataFrame, first_year: int = 1975, last_year: int = 2023) -> DataFrame:
    """id, year, field, author. Works of a plain scan have UNKNOWN for a null field name, those of from_variant() null."""
    field = F.col("field") if "field" in works.columns else first_field(F.col("topics"))
    return in_scope(works, first_year, last_year).select(last_segment(F.col("id")).alias("id"), F.col("publication_year").alias("year"), field.alias("field"), author_list(F.col("authorships")).alias("author"))


def edges(works: DataFrame, first_year: int = 1975, last_year: int = 2023) -> DataFrame:
    """source, targets ('W1;W2'): of works with references."""
    scoped = in_scope(works, first_year, last_year).where(F.size("referenced_works") > 0)
    return scoped.select(last_segment(F.col("id")).alias("source"), F.array_join(F.transform("referenced_works", last_segment), ";").alias("targets"))


def earlier_fields(works: DataFrame, before: int = 1975) -> DataFrame:
    """id number and field of works before a year; both conditions and the nested column reach the Parquet scan."""
    field = F.col("primary_topic.field.display_name")
    return works.where((F.col("publication_year") < before) & field.isNotNull()).select(url_pid("id").alias("id"), field.alias("field"))


def top_fields(fields: DataFrame, k: int = 12) -> DataFrame:
    """The k commonest fields (ties by name)."""
    return fields.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(k)
