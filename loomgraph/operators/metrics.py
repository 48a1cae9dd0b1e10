"""Numbers of each paper: references, reciprocal partners, and fields that its references span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import number, pid, targets
from .graph import edge_list
from .ingest import UNKNOWN


def n_cited_of(distinct: bool = True) -> Column:
    """Listed targets less one if the source is among them: on arrays, without explode or shuffle.

    distinct=False counts repeats, and still takes off one at most.
    """
    listed = F.array_distinct(targets()) if distinct else targets()
    return (F.size(listed) - F.array_contains(listed, F.col("source")).cast("int")).cast("bigint")


def n_cited(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """id, n_cited: a row for each list with a reference left."""
    return edges.select(pid("source").alias("id"), n_cited_of(distinct).alias("n_cited")).where("n_cited > 0")


def n_mutual(pairs: DataFrame) -> DataFrame:
    """id, n_mutual: both ends of each pair from one scan."""
    return pairs.select(F.explode(F.array("paper_a", "paper_b")).alias("p")).groupBy(pid("p").alias("id")).agg(F.count(F.lit(1)).alias("n_mutual"))


def known(attributes: DataFrame) -> DataFrame:
    return attributes.where(F.col("field") != UNKNOWN)


def field_codes(*fields: DataFrame) -> DataFrame:
    """field, code: the known fields of all frames, numbered in order. One row a field."""
    names = known(fields[0].select("field"))
    for other in fields[1:]:
        names = names.union(known(other.select("field")))
    return names.distinct().select("field", (F.row_number().over(Window.orderBy("field")) - 1).cast("bigint").alias("code"))


def field_lookup(attributes: DataFrame, earlier: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """dst, code, late of each paper with a known field; ids that both frames have keep the first frame's.

    late: whether only `earlier` has it. codes: of field_codes(), over these frames' fields at least, if they are known already.
    There are as many codes as fields; whether their table is broadcast is left to its measured size.
    """
    if codes is None:
        codes = field_codes(*(f for f in (attributes, earlier) if f is not None))
    own = known(attributes.select(pid("id").alias("dst"), "field", F.lit(False).alias("late")))
    if earlier is not None:
        both = own.unionByName(known(earlier.select(F.col("id").alias("dst"), "field", F.lit(True).alias("late"))))
        own = both.groupBy("dst").agg(F.min_by("field", "late").alias("field"), F.min("late").alias("late"))
    return own.join(codes, "field").select("dst", "code", "late")


def _words(edges: DataFrame, lookup: DataFrame, **masks: Column) -> DataFrame:
    """id and, for each mask, how many distinct codes its references have where the condition holds.

    A paper's fields are a sparse bitmap: a row for each 64 codes that it has any of, with a word of bits for each condition. The
    grouping that ORs them begins map-side with a few longs; a paper of up to 64 fields is one row of what is summed then.
    """
    bit = F.expr("shiftleft(1L, int(code % 64))")
    listed = edge_list(edges).where("src != dst").join(lookup, "dst")
    words = listed.groupBy(F.col("src").alias("id"), F.expr("code div 64").alias("word")).agg(*[F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))).alias(n) for n, c in masks.items()])
    return words.groupBy("id").agg(*[F.sum(F.bit_count(n)).cast("int").alias(n) for n in masks])


def diversity_count(edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """id, diversity_count of each source: distinct known fields among its references, itself left out; 0 if none."""
    found = _words(edges, lookup, diversity_count=F.lit(True))
    return edges.select(pid("source").alias("id")).join(found, "id", "left").select("id", F.coalesce("diversity_count", F.lit(0)).alias("diversity_count"))


def diversity_both(edges: DataFrame, attributes: DataFrame, earlier: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """id, old, new of each source: diversity without and with the earlier papers' fields, from one pass over the references."""
    found = _words(edges, field_lookup(attributes, earlier, codes), old=~F.col("late"), new=F.lit(True))
    return edges.select(pid("source").alias("id")).join(found, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("old", "new")))


def with_diversity(attributes: DataFrame, counts: DataFrame) -> DataFrame:
    """The papers with diversity_count, 0 where a paper lists nothing."""
    columns = [c for c in attributes.columns if c != "diversity_count"]
    keyed = attributes.select(*columns, number(attributes).alias("__id"))
    joined = keyed.join(counts.select(F.col("id").alias("__id"), "diversity_count"), "__id", "left")
    return joined.select(*columns, F.coalesce("diversity_count", F.lit(0)).alias("diversity_count"))


def diversity_before_after(attributes: DataFrame, both: DataFrame) -> DataFrame:
    """By year: papers with references, mean diversity before and after, mean gain, and the share whose diversity rose. both: of diversity_both()."""
    both = attributes.select(pid("id").alias("id"), "year").join(both, "id")
    return both.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_papers"), F.avg("old").alias("mean_old"), F.avg("new").alias("mean_new"), F.avg(F.col("new") - F.col("old")).alias("mean_gain"),
        (F.lit(100.0) * F.count_if(F.col("new") > F.col("old")) / F.count(F.lit(1))).alias("pct_raised"),
    )


def diversity_distribution(attributes: DataFrame, first: int = 15) -> DataFrame:
    return attributes.groupBy("diversity_count").agg(F.count(F.lit(1)).alias("papers")).orderBy("diversity_count").limit(first)
