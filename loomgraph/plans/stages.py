"""The stages from ingested tables to figures, each a table in a folder: done ones are skipped, chosen ones run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import pid
from ..operators import figures, graph, ingest, metrics
from ..sources import schemas, writers
from ..sources.tables import Tables
from .config import Config


class Stages:
    """attributes and edges are frames; `earlier` are the fields of works before the window, if there are any."""

    NAMES = ["retained", "diversity", "rated", "clean_attributes", "clean_edges", "pairs", "n_cited", "n_mutual", "mean_per_year", "rate_per_year", "papers_per_year", "decile_share", "decile_rate", "citation_lag"]
    #: What each stage reads of the others.
    READS = {
        "diversity": ["retained"], "rated": ["retained", "diversity"], "clean_attributes": ["rated"], "clean_edges": ["clean_attributes"], "pairs": ["clean_edges"], "n_cited": ["clean_edges"],
        "n_mutual": ["pairs"], "papers_per_year": ["clean_attributes"], "citation_lag": ["pairs", "clean_attributes"],
        **{name: ["clean_attributes", "n_cited", "n_mutual"] for name in ("mean_per_year", "rate_per_year", "decile_share", "decile_rate")},
    }
    #: Stages whose tables are bucketed, by their key, where `tables` are given.
    KEYS = {"diversity": "id", "rated": "pid", "clean_attributes": "pid", "n_cited": "id", "n_mutual": "id"}

    def __init__(self, spark: SparkSession, folder: str, attributes: DataFrame, edges: DataFrame, earlier: DataFrame | None = None, config: Config = Config(), tables: Tables | None = None):
        self.spark, self.folder, self.config, self.tables = spark, folder.rstrip("/"), config, tables
        self.attributes, self.edges = attributes, edges
        self.earlier = earlier if earlier is not None else spark.createDataFrame([], schemas.PRE_FIELDS)

    def _bucketed(self, name: str) -> bool:
        return self.tables is not None and name in self.KEYS

    def done(self, name: str) -> bool:
        """Whether the stage's table was committed whole."""
        return self.tables.exists(name) if self._bucketed(name) else writers.current(self.spark, f"{self.folder}/{name}") is not None

    def read(self, name: str) -> DataFrame:
        if not self.done(name):
            raise FileNotFoundError(f"stage {name!r} has no table in {self.folder}; run it first")
        return self.tables.read(name) if self._bucketed(name) else writers.read_parquet(self.spark, f"{self.folder}/{name}")

    def _write(self, name: str, df: DataFrame, expected: int | None) -> None:
        if not self._bucketed(name):
            writers.write_parquet(df, f"{self.folder}/{name}", expected)
            return
        key = self.KEYS[name]
        self.tables.save(name, df if key in df.columns else df.withColumn(key, pid("id")), key, expected)

    def build(self, name: str) -> DataFrame:
        c, read = self.config, self.read
        if name == "retained":
            return graph.retain_connected(self.attributes, self.edges)
        if name == "diversity":
            return metrics.diversity_count(self.edges, metrics.field_lookup(read("retained"), self.earlier))
        if name == "rated":
            return metrics.with_diversity(read("retained"), read("diversity"))
        if name == "clean_attributes":
            return graph.clean_attributes(read("rated"))
        if name == "clean_edges":
            return graph.clean_edges(self.edges, read("clean_attributes"))
        if name == "pairs":
            return graph.mutual_pairs(read("clean_edges"))
        if name == "n_cited":
            return metrics.n_cited(read("clean_edges"))
        if name == "n_mutual":
            return metrics.n_mutual(read("pairs"))
        if name == "papers_per_year":
            return figures.papers_per_year(read("clean_attributes"), c.first_year, c.last_year)
        if name == "citation_lag":
            return figures.citation_lag(read("pairs"), read("clean_attributes"))
        papers = figures.cohort(read("clean_attributes"), read("n_cited"), read("n_mutual"), c.first_year, c.last_year)
        if name == "mean_per_year":
            return figures.mean_mutual_per_year(papers, c.min_papers)
        if name == "rate_per_year":
            return figures.mutual_rate_per_year(papers, c.min_papers)
        grouped = figures.grouped(papers.where(f"n_cited >= {c.min_references}"))
        return figures.decile_share(grouped) if name == "decile_share" else figures.decile_rate(grouped)

    def run(self, stages: list[str] | None = None, again: bool = False) -> list[str]:
        """Runs the stages (all unless named) that aren't done, or all of them with `again`; returns those that ran.

        A stage that is done, and reads one that ran, runs too: no table is older than what it was made of.
        """
        wanted = self.NAMES if stages is None else stages
        if unknown := [s for s in wanted if s not in self.NAMES]:
            raise ValueError(f"unknown stages {unknown}; there are {self.NAMES}")
        ran: list[str] = []
        for name in self.NAMES:
            done, stale = self.done(name), any(s in ran for s in self.READS.get(name, []))
            if (name in wanted and (again or not done)) or (done and stale):
                # adding diversity may neither lose nor multiply papers; a table that does isn't put in place
                expected = self.read("retained").count() if name == "rated" else None
                self._write(name, self.build(name), expected)
                ran.append(name)
        return ran

    def summary(self) -> DataFrame:
        """stage, n_rows of each stage that is done, in their order."""
        rows = [(name, self.read(name).count()) for name in self.NAMES if self.done(name)]
        return self.spark.createDataFrame(rows, "stage string, n_rows long")

    def reports(self) -> dict[str, DataFrame]:
        """What a run is summed up by, as frames of a few rows: growth, gain of diversity, its distribution, lags, decile diagnostics."""
        c, rated, clean = self.config, self.read("rated"), self.read("clean_attributes")
        papers = figures.cohort(clean, self.read("n_cited"), self.read("n_mutual"), c.first_year, c.last_year)
        return {
            "growth": figures.growth(self.read("papers_per_year")),
            "diversity_gain": metrics.diversity_before_after(rated, metrics.diversity_both(self.edges, self.read("retained"), self.earlier)).orderBy("year"),
            "diversity_distribution": metrics.diversity_distribution(rated, c.first_rows),
            "earlier_fields": ingest.top_fields(self.earlier, c.top_fields),
            "citation_lag": self.read("citation_lag").orderBy("n_pairs"),
            "deciles": figures.decile_diagnostics(papers, self.read("n_cited"), c.min_references),
        }
