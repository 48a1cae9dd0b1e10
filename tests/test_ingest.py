import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.operators import ingest
from loomgraph.plans.config import Config
from loomgraph.plans.stages import Stages
from loomgraph.sources import readers, schemas, writers
from loomgraph.streaming.ingest import earlier_available, ingest_available

URL = "https://example.org/"


def work(n, year, topics=None, authors=None, refs=None, **more):
    out = {"id": f"{URL}W{n}" if n else "", "publication_year": year, "topics": topics, "authorships": authors, "referenced_works": refs}
    return {k: v for k, v in out.items() if v is not ...} | more


def named(name):
    return [{"field": {"display_name": name}}]


def write(path, works):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(w) + "\n" for w in works)


WORKS = [
    work(1, 1975, named("A"), [{"author": {"display_name": n}} for n in ("x", "", None, "y")], [f"{URL}W2", f"{URL}W3"]),
    work(2, 2023, ..., ..., ..., other=1),
    work(3, 1980, [], [], []),
    work(4, 1980, [{"field": None}]),
    work(5, 1980, named(None)),
    work(6, 1974), work(7, 2024), work(8, None), work(0, 2000),
]


def test_nested_records(spark, tmp_path):
    write(tmp_path / "day=1/part.gz", WORKS)
    works = readers.works_json(spark, str(tmp_path))
    got = {r["id"]: (r["year"], r["field"], r["author"]) for r in ingest.attributes(works).collect()}
    assert got == {"W1": (1975, "A", "x; y"), "W2": (2023, "Unknown", ""), "W3": (1980, "Unknown", ""), "W4": (1980, "Unknown", ""), "W5": (1980, "Unknown", "")}
    assert [tuple(r) for r in ingest.edges(works).collect()] == [("W1", "W2;W3")]


def test_a_null_name_is_told_from_a_missing_one(spark, tmp_path):
    more = [work(10, 1980, [{"field": {}}]), work(11, 1980, ["text"]), work(12, 1980, {"no": "list"}), work(13, "1980", named("B")), work(14, 1980, named("Ü"), None, None), work(15, 1980, ["x", {"field": {"display_name": "second"}}])]
    write(tmp_path / "v/part.gz", WORKS + more)
    with gzip.open(tmp_path / "v/part.gz", "at") as f:
        f.write('{"id": "broken\n')
    works = ingest.from_variant(readers.works_variant(spark, str(tmp_path / "v")))
    got = {r["id"]: (r["year"], r["field"], r["author"]) for r in ingest.attributes(works).collect()}
    unknown = (1980, "Unknown", "")
    assert got == {
        "W1": (1975, "A", "x; y"), "W2": (2023, "Unknown", ""), "W3": unknown, "W4": unknown, "W5": (1980, None, ""), "W10": unknown, "W11": unknown,
        "W12": unknown, "W13": (1980, "B", ""), "W14": (1980, "Ü", ""), "W15": unknown,
    }
    assert [tuple(r) for r in ingest.edges(works).collect()] == [("W1", "W2;W3")]


def test_whole_files_are_sampled(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}/part.gz", [work(k + 1, 2000), work(k + 11, 2000)])
    assert readers.works_json(spark, str(tmp_path), max_files=2).count() == 4


def test_earlier_fields_reach_the_scan(spark, tmp_path):
    rows = [(f"{URL}W7", 1970, (("A",),)), (f"{URL}W8", 1975, (("A",),)), (f"{URL}W9", 1970, None)]
    spark.createDataFrame(rows, schemas.WORKS_PARQUET).write.parquet(str(tmp_path / "p"))
    df = ingest.earlier_fields(readers.works_parquet(spark, str(tmp_path / "p")))
    assert [tuple(r) for r in df.collect()] == [(7, "A")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(publication_year,1975)" in plan and "IsNotNull(primary_topic.field.display_name)" in plan


def test_csv_dialect(spark, tmp_path):
    names = ['say ""hi""', "back\\slash\\", "two\nlines", "", "a,b"]
    (tmp_path / "a.csv").write_text("id,year,field,author\n" + "".join(f'W{i},2000,F,"{n}"\n' for i, n in enumerate(names)))
    got = [r["author"] or "" for r in readers.csv(spark, str(tmp_path / "a.csv"), schemas.ATTRIBUTES).collect()]
    assert got == [n.replace('""', '"') for n in names]
    assert readers.check_header(spark, str(tmp_path / "a.csv"), ["id", "title"]) == ["title"]
    df = spark.createDataFrame([("W1", "2000", "F", n.replace('""', '"')) for n in names], schemas.ATTRIBUTES)
    writers.write_csv(df, str(tmp_path / "out"))
    assert sorted(r["author"] or "" for r in readers.csv(spark, str(tmp_path / "out"), schemas.ATTRIBUTES).collect()) == sorted(n.replace('""', '"') for n in names)


def test_bad_rows_are_dropped_whatever_is_selected(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,targets\nW1,W2\nW3\nW4,W5,W6\nW7,W8\n")
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    try:
        df = readers.csv(spark, str(tmp_path / "e.csv"), schemas.EDGES, skip_bad=True)
        assert df.count() == 2 and [r[0] for r in df.select("source").collect()] == ["W1", "W7"]
    finally:
        spark.conf.unset("spark.sql.csv.parser.columnPruning.enabled")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"url": "a"}, {"url": "b"}]}, indent=1))
    assert [r["url"] for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2000, 0.5), (2001, None)], "year int, rate double").orderBy("year")
    assert writers.small_csv(df, {"rate": ".6f"}) == "year,rate\n2000,0.500000\n2001,\n"
    assert writers.write_parquet(df, str(tmp_path / "p"), 2) == 2
    with pytest.raises(writers.RowCountMismatch):
        writers.write_parquet(df.limit(1), str(tmp_path / "p"), 3)
    kept = writers.read_parquet(spark, str(tmp_path / "p"))
    assert kept.count() == 2  # the table that didn't pass isn't put in place
    assert writers.write_parquet(kept.union(kept), str(tmp_path / "p"), 4) == 4
    assert writers.read_parquet(spark, str(tmp_path / "p")).count() == 4
    with pytest.raises(FileNotFoundError):
        writers.read_parquet(spark, str(tmp_path / "none"))


def test_gates_are_observed_in_the_write(spark, tmp_path):
    """One job writes and counts; a gate that fails leaves the table as it was."""
    path, tracker = str(tmp_path / "g"), spark.sparkContext.statusTracker()
    df = spark.range(100, numPartitions=3).withColumnRenamed("id", "n")
    spark.sparkContext.setJobGroup("gates", "")
    found = writers.write_gated(df, path, 100, {"no_nulls": F.count_if(F.col("n").isNull()) == 0, "small": F.max("n") < 100})
    assert found == {"n_rows": 100, "no_nulls": True, "small": True} and len(tracker.getJobIdsForGroup("gates")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(writers.GateFailed, match="small"):
        writers.write_gated(df.selectExpr("n + 50 as n"), path, gates={"small": F.max("n") < 100})
    assert writers.current(spark, path) == 1 and writers.read_parquet(spark, path).count() == 100
    assert writers.write_gated(df.limit(0), path, 0, {"empty": F.count(F.lit(1)) == 0})["n_rows"] == 0
    assert writers.read_parquet(spark, path).count() == 0


@pytest.mark.parametrize("at", ["write", "gate", "commit", "clean"])
def test_a_write_broken_off_anywhere_leaves_one_whole_table(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    for n in (1, 2):
        writers.write_parquet(spark.range(n), path)
    real = writers._files

    class Broken(Exception):
        pass

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if (name, at) in (("create", "commit"), ("delete", "clean")):
                raise Broken
            return getattr(self.fs, name)

    with monkeypatch.context() as m:
        m.setattr(writers, "_files", lambda *a: (Files(real(*a)[0]), real(*a)[1]))
        rows = spark.range(3, numPartitions=1)
        if at == "write":
            rows = rows.selectExpr("if(id < 2, id, raise_error('lost')) as id")
        with pytest.raises((Broken, writers.RowCountMismatch, PySparkException)):
            writers.write_parquet(rows, path, 7 if at == "gate" else 3)
    assert writers.read_parquet(spark, path).count() == (3 if at == "clean" else 2)
    assert writers.write_parquet(spark.range(4), path, 4) == 4 and writers.read_parquet(spark, path).count() == 4
    assert len(list((tmp_path / "t/data").iterdir())) == 2  # this one and the one before


def test_configuration_from_outside():
    assert Config.read({}) == Config() and Config.read({"LOOMGRAPH_FIRST_YEAR": "1990", "OTHER": "x"}) == Config(first_year=1990)
    with pytest.raises(ValueError):
        Config.read({"LOOMGRAPH_MIN_PAPERS": "many"})


def test_reader_options(spark, tmp_path):
    write(tmp_path / "w/part.gz", WORKS)
    assert readers.works_json(spark, str(tmp_path / "w"), options=readers.PUBLIC).count() == len(WORKS)


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(source / "1.gz", WORKS)
    for n in (5, 5):  # the second call finds nothing new
        ingest_available(spark, str(source), out, mark)
        assert spark.read.parquet(f"{out}/attributes").count() == n
    write(source / "2.gz", [work(21, 2000, named("B"), None, [f"{URL}W1"])])
    ingest_available(spark, str(source), out, mark)
    assert spark.read.parquet(f"{out}/attributes").count() == 6 and spark.read.parquet(f"{out}/edges").count() == 2


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    write(source / "1.gz", WORKS)
    ingest_available(spark, str(source), out, str(mark))
    for name in ("0", ".0.crc"):  # as if the run had been broken off between writing the tables and the commit
        (mark / "commits" / name).unlink()
    ingest_available(spark, str(source), out, str(mark))
    assert spark.read.parquet(f"{out}/attributes").count() == 5 and spark.read.parquet(f"{out}/edges").count() == 1


def test_earlier_fields_go_on_where_they_stopped(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    works = lambda n: spark.createDataFrame([(f"{URL}W{n}", 1970, (("A",),)), (f"{URL}W{n + 1}", 1970, None), (f"{URL}W{n + 2}", 1980, (("A",),))], schemas.WORKS_PARQUET)
    for n, new in ((1, True), (1, False), (2, True)):
        if new:
            works(10 * n).coalesce(1).write.parquet(f"{source}/{n}")
        earlier_available(spark, source, out, mark)
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [10 * i for i in range(1, n + 1)]


def test_stages(spark, tmp_path):
    a = spark.createDataFrame([(f"W{i}", 2000 + i % 2, "AB"[i % 2], "") for i in range(1, 9)], "id string, year int, field string, author string")
    e = spark.createDataFrame([("W1", "W2;W3;W4"), ("W2", "W1"), ("W3", "W1;W4;W5")], "source string, targets string")
    stages = Stages(spark, str(tmp_path / "s"), a, e, config=Config(min_papers=1))
    with pytest.raises(ValueError, match="unknown stages"):
        stages.run(["nothing"])
    with pytest.raises(FileNotFoundError):
        stages.run(["pairs"])
    assert stages.run() == Stages.NAMES and stages.run() == []
    assert sorted(map(tuple, stages.read("pairs").collect())) == [("W1", "W2"), ("W1", "W3")]
    assert stages.run(["pairs"], again=True) == ["pairs", "n_mutual", "mean_per_year", "rate_per_year", "decile_share", "decile_rate", "citation_lag"]  # none is older than what it is made of
    assert stages.run(["citation_lag"], again=True) == ["citation_lag"]
    reports = {name: df.collect() for name, df in stages.reports().items()}
    assert [tuple(r) for r in reports["growth"]] == [(2000, 2001, 1, 4, 300.0)] or len(reports["growth"]) == 1
    assert {r["threshold"] for r in reports["citation_lag"]} == {"same_year", "within_1_year", "within_2_years", "within_3_years"}
    assert reports["deciles"][0]["n_split"] == 0 and sum(r["papers"] for r in reports["diversity_distribution"]) == stages.read("rated").count()
    assert {r["stage"]: r["n_rows"] for r in stages.summary().collect()}["pairs"] == 2
    assert sum(r["n_mutual"] for r in stages.read("n_mutual").collect()) == 4
