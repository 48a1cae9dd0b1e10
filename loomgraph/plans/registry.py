"""Queries of the reference-graph analytics, by name, and the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pid
from ..functions.ratios import percent
from ..operators import figures, graph, ingest, metrics, validation
from ..sources import readers, schemas, writers
from ..sources.tables import Tables
from ..streaming import parts
from ..streaming.ingest import earlier_available, ingest_available
from .fixture import SQL, Fixture, fixture
from .pair_batches import PairBatches

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(build: Callable[[Fixture], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(fixture(spark, sf_dir))
        ORACLES[name] = SQL + sql
        return build

    return register


_query("ingest_attributes", "SELECT id, year, field, author FROM attributes")(lambda x: x.attributes)
_query("ingest_edges", "SELECT source, targets FROM edges")(lambda x: x.edges)
_query("edge_list", "SELECT s AS src, t AS dst FROM e")(lambda x: graph.edge_list(x.edges))
_query("sources_distinct", "SELECT DISTINCT s AS id FROM e")(lambda x: graph.sources(x.edges))
_query("cited_distinct", "SELECT DISTINCT t AS id FROM e")(lambda x: graph.cited(x.edges))
_query("connected_ids", "SELECT id FROM ends")(lambda x: graph.connected(x.edges))
_query("isolated_papers", "SELECT id FROM attributes a WHERE NOT EXISTS (SELECT 1 FROM ends WHERE ends.id = a.pid)")(lambda x: graph.isolated(x.attributes, x.edges).select("id"))


@_query(
    "connected_summary",
    """SELECT (SELECT count(*) FROM attributes) AS total, (SELECT count(*) FROM retained) AS connected, (SELECT count(*) FROM attributes) - (SELECT count(*) FROM retained) AS isolated,
       100.0::DOUBLE * ((SELECT count(*) FROM attributes) - (SELECT count(*) FROM retained)) / (SELECT count(*) FROM attributes) AS pct_isolated""",
)
def _(x: Fixture) -> DataFrame:
    marked = x.attributes.select(pid("id").alias("id")).join(graph.connected(x.edges).withColumn("linked", F.lit(True)), "id", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("total"), F.count("linked").alias("connected")).withColumn("isolated", F.col("total") - F.col("connected"))
    return counts.withColumn("pct_isolated", percent(F.col("isolated"), F.col("total")))


_query("retain_connected", "SELECT id, year, field FROM retained")(lambda x: x.connected_attributes.select("id", "year", "field"))
_query("pre1975_fields", "SELECT pid AS id, field FROM works WHERE year < 1975 AND field <> 'Unknown'")(lambda x: x.earlier)
_query("pre1975_field_topk", "SELECT field, count(*) AS n FROM earlier GROUP BY field ORDER BY n DESC, field LIMIT 12")(lambda x: ingest.top_fields(x.earlier, x.config.top_fields))
_query("field_codes", "SELECT field, rank() OVER (ORDER BY field) - 1 AS code FROM (SELECT field FROM retained WHERE field <> 'Unknown' UNION SELECT field FROM earlier)")(
    lambda x: metrics.field_codes(x.connected_attributes, x.earlier)
)
_query("diversity_count", "SELECT id, diversity_count FROM div")(lambda x: x.diversity)
_query("diversity_count_backfilled", "SELECT id, diversity_count FROM divb")(lambda x: x.diversity_backfilled)
_query("attributes_with_diversity", "SELECT r.id, year, field, coalesce(diversity_count, 0)::INTEGER AS diversity_count FROM retained r LEFT JOIN div ON div.id = r.pid")(
    lambda x: metrics.with_diversity(x.connected_attributes, x.diversity).select("id", "year", "field", "diversity_count")
)
_query(
    "diversity_before_after",
    """SELECT year, count(*) AS n_papers, avg(coalesce(d.diversity_count, 0)) AS mean_old, avg(b.diversity_count) AS mean_new, avg(b.diversity_count - coalesce(d.diversity_count, 0)) AS mean_gain,
       100.0::DOUBLE * count(*) FILTER (WHERE b.diversity_count > coalesce(d.diversity_count, 0)) / count(*) AS pct_raised
       FROM retained r JOIN divb b ON b.id = r.pid LEFT JOIN div d ON d.id = r.pid GROUP BY year""",
)(lambda x: metrics.diversity_before_after(x.connected_attributes, metrics.diversity_both(x.edges, x.connected_attributes, x.earlier, x.codes)))
_query(
    "diversity_of_300_fields",
    """, f AS (SELECT pid, 'f' || pid % 300 AS field FROM retained UNION ALL SELECT pid, 'f' || pid % 300 FROM earlier)
       SELECT e.s AS id, count(DISTINCT CASE WHEN e.s <> e.t THEN f.field END)::INTEGER AS diversity_count FROM e LEFT JOIN f ON f.pid = e.t GROUP BY e.s""",
)(lambda x: metrics.diversity_count(x.edges, metrics.field_lookup(*(df.withColumn("field", F.concat(F.lit("f"), (n % 300).cast("string"))) for df, n in ((x.connected_attributes, pid("id")), (x.earlier, F.col("id")))))))
_query(
    "diversity_distribution",
    "SELECT coalesce(diversity_count, 0)::INTEGER AS diversity_count, count(*) AS papers FROM retained r LEFT JOIN div ON div.id = r.pid GROUP BY 1 ORDER BY 1 LIMIT 15",
)(lambda x: metrics.diversity_distribution(metrics.with_diversity(x.connected_attributes, x.diversity), x.config.first_rows))
_query("clean_attributes", "SELECT id, year, field, author FROM clean")(lambda x: x.clean_attributes)
_query("clean_edges", "SELECT source, targets FROM edges WHERE source IN (SELECT id FROM clean)")(lambda x: x.clean_edges)
_query("mutual_pairs", "SELECT 'W' || a AS paper_a, 'W' || b AS paper_b FROM pairs")(lambda x: x.pairs)
_query("mutual_pairs_batched", "SELECT (a % 20)::INTEGER AS batch_num, count(*) AS n_pairs FROM pairs GROUP BY 1")(lambda x: graph.pair_batches(x.pairs, x.config.pair_batches))
_query("n_cited", "SELECT id, n_cited FROM nc")(lambda x: x.n_cited)
_query("n_cited_raw", "SELECT id, n AS n_cited FROM (SELECT s AS id, count(*) - max((s = t)::INTEGER) AS n FROM ce GROUP BY s) WHERE n > 0")(lambda x: metrics.n_cited(x.clean_edges, distinct=False))
_query("n_mutual", "SELECT id, n_mutual FROM nm")(lambda x: x.n_mutual)
_query("papers_per_year", "SELECT year, count(*) AS n_papers FROM clean GROUP BY year")(lambda x: figures.papers_per_year(x.clean_attributes, x.config.first_year, x.config.last_year))
_query(
    "papers_growth",
    """, y AS (SELECT year, count(*) AS n FROM clean GROUP BY year)
       SELECT f.year AS first_year, l.year AS last_year, f.n AS first_n, l.n AS last_n, 100.0::DOUBLE * (l.n - f.n) / f.n AS growth_pct
       FROM y f, y l WHERE f.year = (SELECT min(year) FROM y) AND l.year = (SELECT max(year) FROM y)""",
)(lambda x: figures.growth(figures.papers_per_year(x.clean_attributes, x.config.first_year, x.config.last_year)))
_query("mean_mutual_per_year", "SELECT year, count(*) AS n_papers, sum(n_mutual)::DOUBLE / count(*) AS mean_mutual FROM papers GROUP BY year HAVING count(*) >= 5")(
    lambda x: figures.mean_mutual_per_year(x.papers, x.config.min_papers)
)
_query(
    "mutual_rate_per_year",
    """SELECT year, count(*) AS n_papers, sum(n_cited)::BIGINT AS sum_cited, sum(n_mutual)::BIGINT AS sum_mutual, 100.0::DOUBLE * sum(n_mutual) / sum(n_cited) AS rate_pct
       FROM papers GROUP BY year HAVING count(*) >= 5""",
)(lambda x: figures.mutual_rate_per_year(x.papers, x.config.min_papers))
_query(
    "citation_lag",
    """, g AS (SELECT abs(x.year - y.year) AS gap FROM pairs JOIN clean x ON x.pid = a JOIN clean y ON y.pid = b), k AS (SELECT * FROM (VALUES ('same_year', 0), ('within_1_year', 1), ('within_2_years', 2), ('within_3_years', 3)) AS v(threshold, far))
       SELECT threshold, count(*) FILTER (WHERE gap <= far) AS n_pairs, (SELECT count(*) FROM g) AS n_total,
       CASE WHEN (SELECT count(*) FROM g) = 0 THEN 0.0 ELSE 100.0::DOUBLE * count(*) FILTER (WHERE gap <= far) / (SELECT count(*) FROM g) END AS cumulative_pct FROM k LEFT JOIN g ON true GROUP BY threshold""",
)(lambda x: figures.citation_lag(x.pairs, x.clean_attributes))
_query("value_deciles", "SELECT n_cited, n_papers, decile FROM deciles")(lambda x: figures.value_deciles(x.in_window.where(F.col("n_cited") >= x.config.min_references)))
_query(
    "decile_share",
    """SELECT decile, grp AS "group", count(*) AS n_papers, count(*) FILTER (WHERE n_mutual > 0) AS n_with_mutual, 100.0::DOUBLE * count(*) FILTER (WHERE n_mutual > 0) / count(*) AS share_pct
       FROM grouped WHERE grp IS NOT NULL GROUP BY decile, grp""",
)(lambda x: figures.decile_share(x.grouped))
_query(
    "decile_rate",
    """SELECT decile, grp AS "group", count(*) AS n_papers, sum(n_cited)::BIGINT AS sum_cited, sum(n_mutual)::BIGINT AS sum_mutual, 100.0::DOUBLE * sum(n_mutual) / nullif(sum(n_cited), 0) AS rate_pct
       FROM grouped WHERE grp IS NOT NULL GROUP BY decile, grp""",
)(lambda x: figures.decile_rate(x.grouped))
_query("decile_sizes", "SELECT decile, count(*) AS n_papers FROM grouped GROUP BY decile")(lambda x: figures.decile_sizes(x.grouped))
_query(
    "decile_diagnostics",
    """SELECT (SELECT count(*) FROM papers WHERE n_cited >= 3) AS n_cohort, (SELECT count(*) FROM papers WHERE n_cited < 3) AS n_under,
       (SELECT count(*) FROM nc WHERE n_cited >= 3) - (SELECT count(*) FROM papers WHERE n_cited >= 3) AS n_year_excluded,
       (SELECT count(*) FROM papers WHERE n_cited >= 3 AND diversity_count = 0) AS n_zero_diversity,
       (SELECT count(*) FROM (SELECT n_cited FROM grouped GROUP BY n_cited HAVING count(DISTINCT decile) > 1)) AS n_split""",
)(lambda x: figures.decile_diagnostics(x.in_window, x.n_cited, x.config.min_references))
_query("validate_attributes", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE try_cast(ltrim(id, 'W') AS BIGINT) IS NULL) AS bad_ids, count(DISTINCT pid) AS distinct_ids FROM attributes")(
    lambda x: validation.attribute_counts(x.attributes)
)
_query(
    "validate_years",
    "SELECT count(*) FILTER (WHERE year IS NULL) AS null_years, count(*) FILTER (WHERE year < 1980) AS below, count(*) FILTER (WHERE year > 2005) AS above, min(year) AS min_year, max(year) AS max_year FROM attributes",
)(lambda x: validation.years(x.attributes, 1980, 2005))
_query("validate_year_coverage", "SELECT y::INTEGER AS year FROM range(1970, 2021) r(y) WHERE y NOT IN (SELECT year FROM attributes)")(lambda x: validation.missing_years(x.attributes, 1970, 2020))
_query(
    "validate_fields", "SELECT count(DISTINCT field) AS n_fields, count(*) FILTER (WHERE field IS NULL) AS null_fields, count(*) FILTER (WHERE field = 'Unknown') AS unknown_fields FROM attributes"
)(lambda x: validation.fields(x.attributes))
_query(
    "validate_edges_shape",
    """, per AS (SELECT s, count(*) AS n, count(DISTINCT t) AS k, bool_or(s = t) AS own FROM e GROUP BY s)
       SELECT count(*) AS n_rows, count(DISTINCT s) AS distinct_sources, sum(n)::BIGINT AS total_edges, count(*) FILTER (WHERE own) AS self_listing, count(*) FILTER (WHERE n <> k) AS dup_lists, sum(n - k)::BIGINT AS dup_instances FROM per""",
)(lambda x: validation.edges_shape(x.edges))
_query("validate_referential", "SELECT count(*) AS missing_sources FROM edges WHERE source NOT IN (SELECT id FROM clean)")(lambda x: validation.missing_sources(x.edges, x.clean_attributes))
_query("validate_target_coverage", "SELECT count(*) AS total_targets, count(t) AS parseable, count(*) FILTER (WHERE t IN (SELECT pid FROM attributes)) AS known_targets FROM e")(
    lambda x: validation.target_coverage(x.edges, x.attributes)
)
_query(
    "validate_zero_citation",
    "SELECT (SELECT count(*) FROM attributes) AS n_papers, (SELECT count(*) FROM edges) AS n_sources, (SELECT count(*) FROM attributes) - (SELECT count(*) FROM edges) AS zero_citation",
)(lambda x: validation.zero_citation(x.edges, x.attributes))
_query(
    "check_pairs_endpoints",
    "SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a NOT IN (SELECT pid FROM earlier_half)) AS missing_a, count(*) FILTER (WHERE b NOT IN (SELECT pid FROM earlier_half)) AS missing_b FROM pairs",
)(lambda x: validation.pair_endpoints(x.pairs, x.clean_attributes.where("year < 1995")))
ORACLES["check_pairs_endpoints"] = ORACLES["check_pairs_endpoints"].replace("SELECT count(*) AS n_pairs", ", earlier_half AS (SELECT pid FROM clean WHERE year < 1995) SELECT count(*) AS n_pairs")


@_query(
    "check_pairs_unknown",
    """, all_pairs AS (SELECT DISTINCT x.s AS a, x.t AS b FROM e x JOIN e y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t)
       SELECT count(*) AS unknown_matches FROM all_pairs p JOIN attributes r ON (r.pid = p.a OR r.pid = p.b) WHERE r.field = 'Unknown'""",
)
def _(x: Fixture) -> DataFrame:
    return validation.pairs_unknown(graph.mutual_pairs(x.edges), x.attributes)


_query("validate_n_mutual_invariant", "SELECT coalesce((SELECT sum(n_mutual) FROM nm), 0)::BIGINT AS sum_mutual, (SELECT count(*) FROM pairs) AS n_pairs, true AS holds")(
    lambda x: validation.n_mutual_invariant(x.n_mutual, x.pairs)
)
_query(
    "validate_n_cited_parity",
    """, per AS (SELECT count(*) AS n, sum(n_cited)::BIGINT AS total FROM nc)
       SELECT n AS stored_rows, total AS stored_sum, n AS recounted_rows, total AS recounted_sum, true AS equal FROM per""",
)(lambda x: validation.n_cited_parity(graph.edge_list(x.clean_edges).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_cited")), x.clean_edges))
_query("metric_file_stats", "SELECT count(*) AS n_rows, 0::BIGINT AS bad_rows, sum(n_cited)::BIGINT AS total, min(n_cited) AS least, max(n_cited) AS most FROM nc")(
    lambda x: validation.metric_stats(x.n_cited.select(F.col("id").cast("string").alias("id"), F.col("n_cited").cast("string").alias("n_cited")), "n_cited")
)


# The same checks on tables with faults


_query("validate_n_mutual_broken", """, k AS (SELECT * FROM nm WHERE id % 7 <> 0), c AS (SELECT coalesce((SELECT sum(n_mutual) FROM k), 0)::BIGINT AS sum_mutual, (SELECT count(*) FROM pairs) AS n_pairs)
       SELECT sum_mutual, n_pairs, sum_mutual = 2 * n_pairs AS holds FROM c""")(lambda x: validation.n_mutual_invariant(x.n_mutual.where("id % 7 <> 0"), x.pairs))  # fmt: skip
_query(
    "validate_n_cited_repeats",
    """, raw AS (SELECT * FROM (SELECT s AS id, count(*) - max((s = t)::INTEGER) AS n FROM ce GROUP BY s) WHERE n > 0),
       counts AS (SELECT (SELECT count(*) FROM raw) AS stored_rows, (SELECT sum(n) FROM raw)::BIGINT AS stored_sum, (SELECT count(*) FROM nc) AS recounted_rows, (SELECT sum(n_cited) FROM nc)::BIGINT AS recounted_sum)
       SELECT *, stored_rows = recounted_rows AND stored_sum = recounted_sum AS equal FROM counts""",
)(lambda x: validation.n_cited_parity(metrics.n_cited(x.clean_edges, distinct=False), x.clean_edges))
_query(
    "metric_file_bad_rows",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE id % 5 = 0 OR id % 3 = 0) AS bad_rows, (coalesce(sum(n_cited) FILTER (WHERE id % 5 <> 0 AND id % 3 <> 0), 0))::BIGINT AS total,
       min(n_cited) FILTER (WHERE id % 5 <> 0 AND id % 3 <> 0) AS least, max(n_cited) FILTER (WHERE id % 5 <> 0 AND id % 3 <> 0) AS most FROM nc""",
)(lambda x: validation.metric_stats(x.n_cited.selectExpr("if(id % 5 = 0, 'W', '') || id as id", "if(id % 3 = 0, '-', '') || n_cited as n_cited"), "n_cited"))
_query(
    "validate_years_null",
    "SELECT count(*) FILTER (WHERE pid % 13 = 0) AS null_years, count(*) FILTER (WHERE year < 1980 AND pid % 13 <> 0) AS below, count(*) FILTER (WHERE year > 2005 AND pid % 13 <> 0) AS above, "
    "min(year) FILTER (WHERE pid % 13 <> 0) AS min_year, max(year) FILTER (WHERE pid % 13 <> 0) AS max_year FROM attributes",
)(lambda x: validation.years(x.attributes.withColumn("year", F.when(pid("id") % 13 != 0, F.col("year"))), 1980, 2005))
_query(
    "validate_fields_null",
    "SELECT count(DISTINCT field) FILTER (WHERE pid % 3 <> 0) AS n_fields, count(*) FILTER (WHERE pid % 3 = 0) AS null_fields, count(*) FILTER (WHERE field = 'Unknown' AND pid % 3 <> 0) AS unknown_fields FROM attributes",
)(lambda x: validation.fields(x.attributes.withColumn("field", F.when(pid("id") % 3 != 0, F.col("field")))))
_query(
    "validation_completeness",
    "SELECT id AS key, 'missing' AS state FROM attributes WHERE year < 1990 UNION ALL SELECT id, 'stale' FROM attributes WHERE year >= 2000",
)(lambda x: validation.completeness(x.attributes.where("year < 2000").select(F.col("id").alias("key")), x.attributes.where("year >= 1990").select(F.col("id").alias("key"))))


@_query(
    "validation_ledger",
    """, d AS (SELECT CASE WHEN pid % 50 <> 0 THEN pid END AS pid, year FROM attributes WHERE year <> 1990)
       SELECT CASE WHEN count(*) = 10 THEN 'PASS' ELSE 'FAIL' END AS status, 'structural[attributes]' AS label FROM d
       UNION ALL SELECT CASE WHEN count(*) = count(pid) THEN 'PASS' ELSE 'FAIL' END, 'id parse' FROM d
       UNION ALL SELECT CASE WHEN count(DISTINCT pid) = count(*) THEN 'PASS' ELSE 'FAIL' END, 'id uniqueness' FROM d
       UNION ALL SELECT CASE WHEN min(year) >= 1975 AND max(year) <= 2010 THEN 'PASS' ELSE 'FAIL' END, 'year validity' FROM d
       UNION ALL SELECT CASE WHEN count(DISTINCT year) = 36 THEN 'PASS' ELSE 'WARN' END, 'year coverage' FROM d
       UNION ALL SELECT CASE WHEN count(*) = count(DISTINCT source) THEN 'PASS' ELSE 'FAIL' END, 'source uniqueness' FROM edges
       UNION ALL SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, 'referential(sources)' FROM e WHERE s NOT IN (SELECT pid FROM d WHERE pid IS NOT NULL)
       UNION ALL SELECT 'INFO', unnest(['field domain', 'total references', 'papers without references', 'target coverage'])""",
)
def _(x: Fixture) -> DataFrame:
    faulty = x.attributes.where("year <> 1990").withColumn("id", F.when(pid("id") % 50 != 0, F.col("id")).otherwise(F.concat(F.lit("Wx"), "id")))
    return validation.validate(faulty, x.edges, x.config.first_year, x.config.last_year, expect_attributes=10).summary(x.spark).select("status", "label")


# Files: written by one side, read by the other


@_query("works_json_files", "SELECT id, year, field, author FROM attributes")
def _(x: Fixture) -> DataFrame:
    path = f"{x.fresh()}/works"
    x.works.write.mode("overwrite").option("compression", "gzip").json(path)
    return ingest.attributes(readers.works_json(x.spark, path), x.config.first_year, x.config.last_year)


@_query(
    "works_variant_files",
    """SELECT id, year, CASE WHEN field = 'Unknown' OR pid % 4 = 1 OR pid % 4 = 2 THEN 'Unknown' WHEN pid % 4 = 3 THEN field END AS field, author FROM attributes""",
)
def _(x: Fixture) -> DataFrame:
    """Of four works one has a null for its field's name, one no name, one a null for its field."""
    path, case = f"{x.fresh()}/variant", pid(F.substring_index("id", "/", -1)) % 4
    name = F.when(case == 3, F.col("topics")[0]["field"]["display_name"])
    field = F.when(case != 2, F.struct(name.alias("display_name")))
    works = x.works.withColumn("topics", F.when(F.col("topics").isNotNull(), F.array(F.struct(field.alias("field")))))
    every = F.struct(*works.columns)
    line = F.when(case == 1, F.to_json(every)).otherwise(F.to_json(every, {"ignoreNullFields": "false"}))
    works.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return ingest.attributes(ingest.from_variant(readers.works_variant(x.spark, path)), x.config.first_year, x.config.last_year)


@_query("works_stream_files", "SELECT source, targets FROM edges")
def _(x: Fixture) -> DataFrame:
    path = f"{x.fresh()}/stream"
    x.works.write.mode("overwrite").option("compression", "gzip").json(f"{path}/works")
    for _ in range(2):  # the second call finds nothing new
        ingest_available(x.spark, f"{path}/works", f"{path}/out", f"{path}/mark", x.config.first_year, x.config.last_year)
    return x.spark.read.parquet(f"{path}/out/edges").drop("batch")


@_query("works_parquet_files", "SELECT pid AS id, field FROM earlier")
def _(x: Fixture) -> DataFrame:
    path = f"{x.fresh()}/flat"
    x.works_flat.write.mode("overwrite").parquet(path)
    return ingest.earlier_fields(readers.works_parquet(x.spark, path), x.config.before_year)


@_query("earlier_stream_files", "SELECT pid AS id, field FROM earlier")
def _(x: Fixture) -> DataFrame:
    path = f"{x.fresh()}/earlier"
    x.works_flat.write.mode("overwrite").parquet(f"{path}/works")
    for _ in range(2):
        earlier_available(x.spark, f"{path}/works", f"{path}/out", f"{path}/mark", x.config.before_year)
    return x.spark.read.parquet(f"{path}/out")


@_query("manifest_files", "SELECT DISTINCT 'works/year=' || year || '.gz' AS url FROM attributes")
def _(x: Fixture) -> DataFrame:
    path = f"{x.fresh()}/manifest"
    urls = x.attributes.select(F.struct(F.concat(F.lit("works/year="), "year", F.lit(".gz")).alias("url")).alias("file")).distinct()
    urls.agg(F.collect_list("file").alias("files")).write.mode("overwrite").json(path)  # a year each
    return readers.manifest(x.spark, path)


@_query("csv_files", """SELECT id, year::VARCHAR AS year, field, author || ', "' || id || '"' || chr(10) || 'a\\' AS author FROM attributes""")
def _(x: Fixture) -> DataFrame:
    """Commas, quotes, line breaks and a backslash at the end come back as they were."""
    path = f"{x.fresh()}/csv"
    awkward = F.concat("author", F.lit(', "'), "id", F.lit('"\na\\'))
    writers.write_csv(x.attributes.select("id", "year", "field", awkward.alias("author")), path)
    return readers.csv(x.spark, path, schemas.ATTRIBUTES)


@_query("csv_bad_rows", "SELECT source, split_part(targets, ';', 1) AS targets FROM edges WHERE ltrim(source, 'W')::BIGINT % 3 = 0")
def _(x: Fixture) -> DataFrame:
    """Rows with a cell too few or too many are dropped."""
    path = f"{x.fresh()}/bad"
    line = F.concat("source", F.element_at(F.array(F.lit(""), F.concat(F.lit(","), F.split_part("targets", F.lit(";"), F.lit(1)))), F.when(pid("source") % 3 == 1, 1).otherwise(2)))
    line = F.concat(line, F.when(pid("source") % 3 == 2, F.lit(",W1")).otherwise(""))
    x.edges.select(line.alias("source,targets")).write.mode("overwrite").options(header=True, sep="\t").csv(path)
    return readers.csv(x.spark, path, schemas.EDGES, skip_bad=True)


@_query("table_swapped", "SELECT year, count(*) AS n_papers FROM clean GROUP BY year")
def _(x: Fixture) -> DataFrame:
    """A table replaced by itself, after one with a row too few was turned away."""
    path = f"{x.fresh()}/per_year"
    per_year = figures.papers_per_year(x.clean_attributes, x.config.first_year, x.config.last_year)
    n = writers.write_parquet(per_year, path)
    try:
        writers.write_parquet(per_year.limit(0), path, n)
    except writers.RowCountMismatch:
        writers.write_parquet(writers.read_parquet(x.spark, path), path, n)
    return writers.read_parquet(x.spark, path)


@_query("cohort_bucketed", "SELECT id, year, n_cited, n_mutual, diversity_count FROM papers")
def _(x: Fixture) -> DataFrame:
    """Papers, counts and diversity as bucketed tables, joined where they lie."""
    tables = Tables(x.spark, f"loomgraph_{uuid.uuid4().hex}", 4, x.fresh())
    tables.save("papers", x.clean_attributes.withColumn("pid", pid("id")), "pid")
    for name, df in (("n_cited", x.n_cited), ("n_mutual", x.n_mutual), ("diversity", x.diversity_backfilled)):
        tables.save(name, df, "id")
    rated = metrics.with_diversity(tables.read("papers"), tables.read("diversity"))
    return figures.cohort(rated, tables.read("n_cited"), tables.read("n_mutual"), x.config.first_year, x.config.last_year).select("id", "year", "n_cited", "n_mutual", "diversity_count")


def _years_as_parts(x: Fixture, path: str) -> None:
    """The works as JSON lines, a file a year; in each a line that is no record."""
    lines = x.works.select("publication_year", F.to_json(F.struct(*x.works.columns)).alias("value"))
    bad = x.works.select("publication_year").distinct().select("publication_year", F.concat(F.lit('{"id": "broken '), "publication_year").alias("value"))
    lines.unionByName(bad).repartition(8, "publication_year").write.partitionBy("publication_year").option("compression", "gzip").text(path)


@_query("parts_edges", "SELECT source, targets FROM edges")
def _(x: Fixture) -> DataFrame:
    """Taken part by part, twice; a second run finds nothing new."""
    path = x.fresh()
    _years_as_parts(x, f"{path}/in")
    taken = parts.works_parts(x.spark, f"{path}/out", x.config.first_year, x.config.last_year, per_batch=10)
    for _ in range(2):
        taken.run(parts.listed(x.spark, f"{path}/in"))
    return taken.table("edges")


@_query("parts_rejects", "SELECT year::VARCHAR AS year, '{\"id\": \"broken ' || year AS line, count(*) AS n_rows FROM works GROUP BY year")
def _(x: Fixture) -> DataFrame:
    """Rejected lines and rows taken, by part."""
    path = x.fresh()
    _years_as_parts(x, f"{path}/in")
    taken = parts.works_parts(x.spark, f"{path}/out", x.config.first_year, x.config.last_year)
    taken.run(parts.listed(x.spark, f"{path}/in"))
    year = F.regexp_extract("part", "publication_year=(\\d+)", 1).alias("year")
    return taken.ledger().join(taken.rejects().drop("batch"), "part").select(year, "line", "n_rows")


@_query("parts_completeness", "SELECT year::VARCHAR AS key, 'missing' AS state FROM (SELECT DISTINCT year FROM works WHERE year > 2005) UNION ALL SELECT DISTINCT year::VARCHAR, 'stale' FROM works WHERE year < 1970")
def _(x: Fixture) -> DataFrame:
    """The storage against the ledger: years that weren't taken yet, and years that were and are gone."""
    path = x.fresh()
    _years_as_parts(x, f"{path}/in")
    there = parts.listed(x.spark, f"{path}/in").withColumn("year", F.regexp_extract("part", "publication_year=(\\d+)", 1)).cache()
    taken = parts.works_parts(x.spark, f"{path}/out", x.config.first_year, x.config.last_year)
    taken.run(there.where("year <= 2005").drop("year"))
    found = taken.completeness(there.where("year >= 1970"))
    return found.select(F.regexp_extract("key", "publication_year=(\\d+)", 1).alias("key"), "state")


@_query("manifest_scan", "SELECT pid AS id, field FROM works WHERE year < 1975 AND field <> 'Unknown' AND year % 2 = 0")
def _(x: Fixture) -> DataFrame:
    """A manifest that names the even years' files: the others aren't read."""
    path = x.fresh()
    flat = x.works_flat.repartition(8, "publication_year").withColumn("y", F.col("publication_year"))
    flat.write.partitionBy("y").parquet(f"{path}/flat")
    there = parts.listed(x.spark, f"{path}/flat", "*.parquet").where(F.regexp_extract("part", "y=(\\d+)", 1).cast("int") % 2 == 0)
    there.agg(F.collect_list(F.struct(F.col("path").alias("url"))).alias("files")).write.json(f"{path}/manifest")  # names of files
    taken = parts.earlier_parts(x.spark, f"{path}/out", x.config.before_year, per_batch=9)
    taken.run(parts.manifest_parts(x.spark, f"{path}/manifest"))
    return taken.table("earlier")


@_query("mutual_pairs_resumed", "SELECT 'W' || a AS paper_a, 'W' || b AS paper_b FROM pairs")
def _(x: Fixture) -> DataFrame:
    """Pairs by batches, two of which are built again."""
    batches = PairBatches(x.spark, x.fresh(), x.config.pair_batches)
    batches.deal(x.clean_edges, files=1)
    batches.run()
    for k in (3, 7):
        batches.forget(k)
    batches.run()
    return batches.pairs()
