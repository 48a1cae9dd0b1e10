"""A reference graph derived from the tables part and lineitem, and the same in SQL.

Papers are parts; a paper lists those that follow it in an order. Integer rules only, so that two engines agree. Nested
records are built first and go through the same ingest as files do.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import figures, graph, ingest, metrics
from .config import FIXTURE, Config

OUTSIDE = 1_000_000_000
URL = "https://example.org/"


class Fixture:
    """Each property is a frame; those that several queries read are persisted."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = FIXTURE):
        self.spark, self.sf_dir, self.config = spark, sf_dir, config

    def release(self) -> None:
        """Gives back what is persisted; frames made before are worked out anew if they are read."""
        for frame in vars(self).values():
            if isinstance(frame, DataFrame):
                frame.unpersist()

    def fresh(self) -> str:
        """A folder of its own for files that a query reads, in the shared checkpoint folder; another at each call."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not self.spark.sparkContext.master.startswith("local") or "cluster" in self.spark.sparkContext.master:
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return f"{shared.rstrip('/')}/loomgraph-files-{uuid.uuid4().hex}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self) -> DataFrame:
        field = F.when(F.col("p_type") == "ECONOMY", F.lit(None)).otherwise(F.col("p_type"))
        return self._table("part").select((F.col("p_partkey") + 1).alias("pid"), (F.col("p_size") + 1965).alias("year"), field.alias("field"), "p_name", "p_partkey")

    @cached_property
    def references(self) -> DataFrame:
        """src, dst: a bag."""
        line = self._table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        citing = line.where("l_partkey % 5 <> 0 and l_orderkey % (1 + l_partkey % 24) = 0")
        b = line.select("l_orderkey", *[F.col(c).alias(f"b_{c}") for c in ("l_linenumber", "l_suppkey", "l_partkey")])
        both = citing.join(b, "l_orderkey").where("l_linenumber <= b_l_linenumber and l_suppkey <> b_l_suppkey")
        to = F.col("b_l_partkey") + 1 + F.when(F.col("b_l_partkey") % 11 == 0, OUTSIDE).otherwise(0)
        own = self.parts.where("p_partkey % 37 = 0")
        return both.select((F.col("l_partkey") + 1).alias("src"), to.alias("dst")).unionByName(own.select(F.col("pid").alias("src"), F.col("pid").alias("dst")))

    @cached_property
    def works(self) -> DataFrame:
        """Nested records; a work without a field has no topics, one without references a null list."""
        url = lambda c: F.concat(F.lit(f"{URL}W"), c.cast("string"))
        listed = self.references.groupBy("src").agg(F.array_sort(F.collect_list(url(F.col("dst")))).alias("referenced_works"))
        papers = self.parts.join(listed, F.col("pid") == F.col("src"), "left")
        topics = F.when(F.col("field").isNotNull(), F.array(F.struct(F.struct(F.col("field").alias("display_name")).alias("field"))))
        authors = F.transform(F.split("p_name", " "), lambda w: F.struct(F.struct(w.alias("display_name")).alias("author")))
        return papers.select(url(F.col("pid")).alias("id"), F.col("year").alias("publication_year"), topics.alias("topics"), authors.alias("authorships"), "referenced_works")

    @cached_property
    def works_flat(self) -> DataFrame:
        """The other record shape, with one nested field."""
        topic = F.struct(F.struct(F.col("field").alias("display_name")).alias("field")).alias("primary_topic")
        return self.parts.select(F.concat(F.lit(f"{URL}W"), F.col("pid").cast("string")).alias("id"), F.col("year").alias("publication_year"), topic)

    @cached_property
    def attributes(self) -> DataFrame:
        return ingest.attributes(self.works.drop("referenced_works"), self.config.first_year, self.config.last_year).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return ingest.edges(self.works, self.config.first_year, self.config.last_year).persist()

    @cached_property
    def earlier(self) -> DataFrame:
        return ingest.earlier_fields(self.works_flat, self.config.before_year)

    @cached_property
    def connected_attributes(self) -> DataFrame:
        return graph.retain_connected(self.attributes, self.edges)

    @cached_property
    def codes(self) -> DataFrame:
        """Of every paper's field: isolated papers may have more, which changes no count."""
        return metrics.field_codes(self.attributes, self.earlier)

    @cached_property
    def diversity(self) -> DataFrame:
        return metrics.diversity_count(self.edges, metrics.field_lookup(self.connected_attributes, codes=self.codes))

    @cached_property
    def diversity_backfilled(self) -> DataFrame:
        return metrics.diversity_count(self.edges, metrics.field_lookup(self.connected_attributes, self.earlier, self.codes))

    @cached_property
    def clean_attributes(self) -> DataFrame:
        return graph.clean_attributes(self.connected_attributes)

    @cached_property
    def clean_edges(self) -> DataFrame:
        return graph.clean_edges(self.edges, self.clean_attributes).persist()

    @cached_property
    def pairs(self) -> DataFrame:
        return graph.mutual_pairs(self.clean_edges).persist()

    @cached_property
    def n_cited(self) -> DataFrame:
        return metrics.n_cited(self.clean_edges)

    @cached_property
    def n_mutual(self) -> DataFrame:
        return metrics.n_mutual(self.pairs)

    @cached_property
    def papers(self) -> DataFrame:
        """Papers with references, in the window: for the yearly series."""
        return figures.cohort(self.clean_attributes, self.n_cited, self.n_mutual, self.config.first_year, self.config.last_year)

    @cached_property
    def in_window(self) -> DataFrame:
        """The same with diversity: for the deciles."""
        rated = metrics.with_diversity(self.clean_attributes, self.diversity_backfilled)
        return figures.cohort(rated, self.n_cited, self.n_mutual, self.config.first_year, self.config.last_year).persist()

    @cached_property
    def grouped(self) -> DataFrame:
        return figures.grouped(self.in_window.where(F.col("n_cited") >= self.config.min_references))


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """One for the application and folder, so that queries share what is persisted; that of another folder is released."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        for (application, _), old in _FIXTURES.items():
            if application == key[0]:
                old.release()
        _FIXTURES.clear()
        _FIXTURES[key] = Fixture(spark, sf_dir)
    return _FIXTURES[key]


#: The same graph in SQL, as common table expressions.
SQL = """
WITH works AS (SELECT p_partkey + 1 AS pid, 'W' || (p_partkey + 1) AS id, (1965 + p_size)::INTEGER AS year, CASE WHEN p_type = 'ECONOMY' THEN 'Unknown' ELSE p_type END AS field,
                      array_to_string(string_split(p_name, ' '), '; ') AS author FROM part),
attributes AS (SELECT * FROM works WHERE year BETWEEN 1975 AND 2010),
refs AS (SELECT a.l_partkey + 1 AS s, b.l_partkey + 1 + CASE WHEN b.l_partkey % 11 = 0 THEN 1000000000 ELSE 0 END AS t FROM lineitem a, lineitem b
         WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber <= b.l_linenumber AND a.l_suppkey <> b.l_suppkey AND a.l_partkey % 5 <> 0 AND a.l_orderkey % (1 + a.l_partkey % 24) = 0
         UNION ALL SELECT p_partkey + 1, p_partkey + 1 FROM part WHERE p_partkey % 37 = 0),
e AS (SELECT s, t FROM refs WHERE s IN (SELECT pid FROM attributes)),
edges AS (SELECT 'W' || s AS source, string_agg('W' || t, ';' ORDER BY 'W' || t) AS targets FROM e GROUP BY s),
ends AS (SELECT s AS id FROM e UNION SELECT t FROM e),
retained AS (SELECT * FROM attributes WHERE pid IN (SELECT id FROM ends)),
earlier AS (SELECT pid, field FROM works WHERE year < 1975 AND field <> 'Unknown'),
div AS (SELECT e.s AS id, count(DISTINCT CASE WHEN r.field <> 'Unknown' AND e.s <> e.t THEN r.field END)::INTEGER AS diversity_count FROM e LEFT JOIN retained r ON r.pid = e.t GROUP BY e.s),
divb AS (SELECT e.s AS id, count(DISTINCT CASE WHEN r.field <> 'Unknown' AND e.s <> e.t THEN r.field END)::INTEGER AS diversity_count
         FROM e LEFT JOIN (SELECT pid, field FROM retained UNION ALL SELECT * FROM earlier) r ON r.pid = e.t GROUP BY e.s),
clean AS (SELECT * FROM retained WHERE field <> 'Unknown'),
ce AS (SELECT s, t FROM e WHERE s IN (SELECT pid FROM clean)),
pairs AS (SELECT DISTINCT x.s AS a, x.t AS b FROM ce x JOIN ce y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t),
nc AS (SELECT s AS id, count(DISTINCT t) AS n_cited FROM ce WHERE s <> t GROUP BY s),
nm AS (SELECT p AS id, count(*) AS n_mutual FROM (SELECT a AS p FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY p),
papers AS (SELECT nc.id, nc.n_cited, coalesce(nm.n_mutual, 0) AS n_mutual, c.year, coalesce(divb.diversity_count, 0) AS diversity_count
           FROM nc JOIN clean c ON c.pid = nc.id LEFT JOIN nm ON nm.id = nc.id LEFT JOIN divb ON divb.id = nc.id WHERE c.year BETWEEN 1975 AND 2010),
hist AS (SELECT n_cited, count(*) AS n_papers FROM papers WHERE n_cited >= 3 GROUP BY n_cited),
deciles AS (SELECT h.n_cited, h.n_papers, least(10, greatest(1, floor((((SELECT coalesce(sum(l.n_papers), 0) FROM hist l WHERE l.n_cited < h.n_cited) + h.n_papers / 2.0::DOUBLE)
            / (SELECT sum(n_papers) FROM hist)) * 10.0)::INTEGER + 1))::INTEGER AS decile FROM hist h),
grouped AS (SELECT p.*, d.decile, CASE WHEN diversity_count BETWEEN 1 AND 2 THEN 'non-diverse' WHEN diversity_count >= 3 THEN 'diverse' END AS grp
            FROM papers p JOIN deciles d ON d.n_cited = p.n_cited WHERE p.n_cited >= 3)
"""
