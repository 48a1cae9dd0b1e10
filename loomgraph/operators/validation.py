"""Checks of the tables and of what is derived from them; each is one aggregation, and a ledger sums them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import targets, try_pid
from .ingest import UNKNOWN
from .metrics import n_cited

#: Order of the summary.
STATUSES = ["FAIL", "WARN", "PASS", "INFO"]


def attribute_counts(attributes: DataFrame) -> DataFrame:
    """n_rows, bad_ids (no whole number behind W), distinct_ids."""
    return attributes.select(try_pid(F.col("id")).alias("pid")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("pid").isNull()).alias("bad_ids"), F.count_distinct("pid").alias("distinct_ids"))


def years(attributes: DataFrame, first_year: int, last_year: int) -> DataFrame:
    year = F.col("year")
    return attributes.agg(
        F.count_if(year.isNull()).alias("null_years"), F.count_if(year < first_year).alias("below"), F.count_if(year > last_year).alias("above"), F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )


def missing_years(attributes: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Years of the window without a paper."""
    wanted = attributes.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(attributes.select("year"), "year", "left_anti")


def fields(attributes: DataFrame) -> DataFrame:
    field = F.col("field")
    return attributes.agg(F.count_distinct("field").alias("n_fields"), F.count_if(field.isNull()).alias("null_fields"), F.count_if(field == UNKNOWN).alias("unknown_fields"))


def edges_shape(edges: DataFrame) -> DataFrame:
    """Six counts in one scan, on arrays: nothing is exploded."""
    listed, distinct = F.size(targets()), F.size(F.array_distinct(targets()))
    return edges.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("distinct_sources"), F.sum(listed).alias("total_edges"),
        F.count_if(F.array_contains(targets(), F.col("source"))).alias("self_listing"), F.count_if(listed != distinct).alias("dup_lists"), F.sum(listed - distinct).alias("dup_instances"),
    )


def missing_sources(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """missing_sources: edge rows whose source is no paper."""
    papers = attributes.select(try_pid(F.col("id")).alias("pid"))
    return edges.select(try_pid(F.col("source")).alias("pid")).join(papers, "pid", "left_anti").agg(F.count(F.lit(1)).alias("missing_sources"))


def target_coverage(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Listed targets, those with a number, and those that are papers (of any field); a paper that comes twice counts once."""
    papers = attributes.select(try_pid(F.col("id")).alias("pid"), F.lit(True).alias("known")).distinct()
    listed = edges.select(F.explode(targets()).alias("t")).select(try_pid(F.col("t")).alias("pid"))
    return listed.join(papers, "pid", "left").agg(F.count(F.lit(1)).alias("total_targets"), F.count("pid").alias("parseable"), F.count("known").alias("known_targets"))


def zero_citation(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Papers less sources: by subtraction, without a join."""
    n = attributes.agg(F.count(F.lit(1)).alias("n_papers"), F.lit(1).alias("__one"))
    s = edges.agg(F.count_distinct("source").alias("n_sources"), F.lit(1).alias("__one"))
    return n.join(s, "__one").select("n_papers", "n_sources", (F.col("n_papers") - F.col("n_sources")).alias("zero_citation"))


def pair_endpoints(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """n_pairs, and pairs whose first or second paper is missing."""
    side = lambda c: attributes.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}"))
    both = pairs.join(side("paper_a"), "paper_a", "left").join(side("paper_b"), "paper_b", "left")
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("has_paper_a").isNull()).alias("missing_a"), F.count_if(F.col("has_paper_b").isNull()).alias("missing_b"))


def pairs_unknown(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """unknown_matches: a pair counts once for each of its ends of unknown field.

    A join on either end would be a nested loop; the ends, made distinct, are exploded and joined on equality instead.
    """
    ends = pairs.select(F.explode(F.array_distinct(F.array("paper_a", "paper_b"))).alias("id"))
    return ends.join(attributes.where(F.col("field") == UNKNOWN).select("id"), "id").agg(F.count(F.lit(1)).alias("unknown_matches"))


def n_mutual_invariant(n_mutual: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sum of n_mutual is twice the number of pairs."""
    a = n_mutual.agg(F.coalesce(F.sum("n_mutual"), F.lit(0)).alias("sum_mutual"), F.lit(1).alias("__one"))
    b = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.lit(1).alias("__one"))
    return a.join(b, "__one").select("sum_mutual", "n_pairs", (F.col("sum_mutual") == 2 * F.col("n_pairs")).alias("holds"))


def n_cited_parity(metric: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows and sum of a stored n_cited against those recounted from the lists."""
    totals = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.coalesce(F.sum("n_cited"), F.lit(0)).alias(f"{p}_sum"), F.lit(1).alias("__one"))
    both = totals(metric, "stored").join(totals(n_cited(edges), "recounted"), "__one").drop("__one")
    return both.withColumn("equal", (F.col("stored_rows") == F.col("recounted_rows")) & (F.col("stored_sum") == F.col("recounted_sum")))


def metric_stats(raw: DataFrame, column: str) -> DataFrame:
    """Of a file of strings: rows, bad_rows (id or value no whole number, or below 0), and sum, min and max of the rest."""
    number = F.col("id").try_cast("bigint"), F.col(column).try_cast("bigint")
    bad = number[0].isNull() | number[1].isNull() | (number[1] < 0)
    good: Column = F.when(~bad, number[1])
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("bad_rows"), F.coalesce(F.sum(good), F.lit(0)).alias("total"), F.min(good).alias("least"), F.max(good).alias("most"))


def completeness(present: DataFrame, done: DataFrame) -> DataFrame:
    """key, state: parts that are missing from the checkpoint, or stale in it."""
    missing = present.select("key").distinct().join(done.select("key"), "key", "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(done.select("key").distinct().join(present.select("key"), "key", "left_anti").withColumn("state", F.lit("stale")))


class ValidationFailed(RuntimeError):
    """At least one check has failed."""


class Ledger:
    """Statuses of checks; summary() orders them, close() raises if any failed."""

    def __init__(self):
        self.rows: list[tuple[str, str, str]] = []

    def record(self, status: str, label: str, detail: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"status {status!r} is none of {STATUSES}")
        self.rows.append((status, label, detail))

    def summary(self, spark: SparkSession) -> DataFrame:
        order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
        return spark.createDataFrame(self.rows, "status string, label string, detail string").orderBy(order, "label")

    def close(self) -> int:
        failed = [label for status, label, _ in self.rows if status == "FAIL"]
        if failed:
            raise ValidationFailed(", ".join(failed))
        return len(self.rows)


def validate(attributes: DataFrame, edges: DataFrame, first_year: int, last_year: int, expect_attributes: int | None = None, expect_edges: int | None = None) -> Ledger:
    """All table checks. The counts expected, where given, are held against what was read."""
    ledger = Ledger()
    a, y, f = attribute_counts(attributes).first(), years(attributes, first_year, last_year).first(), fields(attributes).first()
    if expect_attributes is not None:
        ledger.record("PASS" if a["n_rows"] == expect_attributes else "FAIL", "structural[attributes]", f"{a['n_rows']} rows, {expect_attributes} expected")
    ledger.record("PASS" if not a["bad_ids"] else "FAIL", "id parse", f"{a['bad_ids']} ids without a number")
    ledger.record("PASS" if a["distinct_ids"] == a["n_rows"] else "FAIL", "id uniqueness", f"{a['distinct_ids']} distinct of {a['n_rows']}")
    ledger.record("PASS" if not (y["null_years"] or y["below"] or y["above"]) else "FAIL", "year validity", f"range {y['min_year']}-{y['max_year']}, null {y['null_years']}, below {y['below']}, above {y['above']}")
    ledger.record("INFO", "field domain", f"{f['n_fields']} fields, unknown {f['unknown_fields']}, null {f['null_fields']}")
    gaps = [r["year"] for r in missing_years(attributes, first_year, last_year).orderBy("year").collect()]
    ledger.record("WARN" if gaps else "PASS", "year coverage", f"empty years: {gaps or 'none'}")
    e = edges_shape(edges).first()
    if expect_edges is not None:
        ledger.record("PASS" if e["n_rows"] == expect_edges else "FAIL", "structural[edges]", f"{e['n_rows']} rows, {expect_edges} expected")
    ledger.record("PASS" if e["n_rows"] == e["distinct_sources"] else "FAIL", "source uniqueness", f"{e['n_rows']} rows, {e['distinct_sources']} sources")
    ledger.record("INFO", "total references", f"{e['total_edges']}, sources that list themselves {e['self_listing']}, lists with repeats {e['dup_lists']} ({e['dup_instances']})")
    lost = missing_sources(edges, attributes).first()["missing_sources"]
    ledger.record("PASS" if not lost else "FAIL", "referential(sources)", f"{lost} sources that are no papers")
    z, t = zero_citation(edges, attributes).first(), target_coverage(edges, attributes).first()
    ledger.record("INFO", "papers without references", f"{z['zero_citation']} of {z['n_papers']}")
    ledger.record("INFO", "target coverage", f"{t['known_targets']} of {t['total_targets']} targets are papers, {t['parseable']} have a number")
    return ledger
