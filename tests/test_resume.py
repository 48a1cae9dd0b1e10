"""Parts with a ledger, bucketed tables, pairs by batches, and the whole job: what is left after faults and second runs."""

import gzip
import json
import shutil

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import figures, graph, metrics
from loomgraph.plans import job
from loomgraph.plans.config import Config
from loomgraph.plans.pair_batches import PairBatches
from loomgraph.plans.registry import QUERIES
from loomgraph.sources import schemas
from loomgraph.sources.tables import Tables
from loomgraph.sources.writers import RowCountMismatch
from loomgraph.streaming import parts
from tests.test_ingest import URL, named, work, write

SF = "/root/testdata/sf0.001"


def taken(p):
    return sorted(r["id"] for r in p.table("attributes").collect()), {r["part"].split("/")[-1]: (r["n_rows"], r["n_rejected"], r["error"] is not None) for r in p.ledger().collect()}


def test_bad_lines_and_broken_parts_are_named(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(5):
        write(source / f"{k}.gz", [work(10 * k + i, 2000, named("A"), None, [f"{URL}W1"]) for i in range(1, 4)])
    with gzip.open(source / "1.gz", "at") as f:
        f.write("no record\n")
    whole = gzip.compress("".join(json.dumps(work(30 + i, 2000, named("x" * i))) + "\n" for i in range(1, 900)).encode())
    (source / "3.gz").write_bytes(whole[: len(whole) // 2])
    (source / "4.gz").write_bytes(gzip.compress(b""))
    p = parts.works_parts(spark, str(tmp_path / "out"), per_batch=3)
    there = lambda: parts.listed(spark, str(source))
    assert p.run(there()) == 2
    ids = sorted(f"W{10 * k + i}" for k in (0, 1, 2) for i in (1, 2, 3))
    ledger = {"0.gz": (3, 0, False), "1.gz": (3, 1, False), "2.gz": (3, 0, False), "3.gz": (0, 0, True), "4.gz": (0, 0, False)}
    assert taken(p) == (ids, ledger)
    assert [(r["part"].split("/")[-1], r["line"]) for r in p.rejects().collect()] == [("1.gz", "no record")]
    assert [(r["key"].split("/")[-1], r["state"]) for r in p.completeness(there()).collect()] == [("3.gz", "missing")]
    assert p.run(there()) == 0  # nothing new; the broken one isn't tried again as it is
    (source / "3.gz").write_bytes(whole)  # mended
    (source / "0.gz").unlink()
    assert p.run(there()) == 1
    assert len(p.table("attributes").collect()) == 9 + 899
    assert [(r["key"].split("/")[-1], r["state"]) for r in p.completeness(there()).collect()] == [("0.gz", "stale")]


def test_a_broken_batch_is_done_again(spark, tmp_path, monkeypatch):
    for k in range(4):
        write(tmp_path / f"in/{k}.gz", [work(10 * k + i, 2000, named("A"), None, [f"{URL}W1"]) for i in range(1, 4)])
    p = parts.works_parts(spark, str(tmp_path / "out"), per_batch=2)
    there = parts.listed(spark, str(tmp_path / "in"))
    broken = {**p.tables, "edges": lambda w: 1 / 0}
    with monkeypatch.context() as m:
        m.setattr(p, "tables", broken)
        with pytest.raises(ZeroDivisionError):
            p.run(there)
    assert p.ledger().count() == 0 and p.table("attributes").count() == 0  # what was left isn't seen
    assert p.run(there) == 2 and len(taken(p)[0]) == 12 == len(set(taken(p)[0]))
    assert p.table("edges").count() == 12 and p.rejects().count() == 0


def test_only_what_a_manifest_names_is_read(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"{URL}W{k}", 1960, (("A",),))], schemas.WORKS_PARQUET).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "in/2").joinpath("unreadable.parquet").write_text("no table")
    files = [str(f) for k in (0, 2) for f in (tmp_path / f"in/{k}").glob("part-*.parquet")]
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"url": f} for f in files]}))
    p = parts.earlier_parts(spark, str(tmp_path / "out"))
    assert p.run(parts.manifest_parts(spark, str(tmp_path / "m.json"))) == 1
    assert sorted(r["id"] for r in p.table("earlier").collect()) == [0, 2]
    assert p.run(parts.listed(spark, str(tmp_path / "in"), "*.parquet")) == 1  # now all of them: the unreadable one is named
    assert sorted(r["id"] for r in p.table("earlier").collect()) == [0, 1, 2]
    assert [r["part"].split("/")[-1] for r in p.ledger().where("error is not null").collect()] == ["unreadable.parquet"]


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, no_broadcast):
    tables = Tables(spark, "papers_test", 4, str(tmp_path))
    assert not tables.exists("papers")
    with pytest.raises(FileNotFoundError):
        tables.read("papers")
    a = spark.createDataFrame([(i, f"W{i}", 2000 + i % 3, "A") for i in range(200)], "pid bigint, id string, year int, field string")
    counts = spark.createDataFrame([(i, i % 7 + 1) for i in range(0, 200, 2)], "id bigint, n bigint")
    assert tables.save("papers", a, "pid") == 200
    for name, column in (("n_cited", "n_cited"), ("n_mutual", "n_mutual"), ("diversity", "diversity_count")):
        tables.save(name, counts.withColumnRenamed("n", column), "id")
    rated = metrics.with_diversity(tables.read("papers"), tables.read("diversity"))
    joined = figures.cohort(rated, tables.read("n_cited"), tables.read("n_mutual"), 1975, 2023)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100 and joined.where("n_cited != n_mutual or n_cited != diversity_count").count() == 0
    with pytest.raises(RowCountMismatch):
        tables.save("papers", a.limit(10), "pid", expected=200)
    assert tables.read("papers").count() == 200
    before = tables.read("papers")
    assert tables.save("papers", a.where("pid < 50"), "pid", expected=50) == 50
    assert tables.read("papers").count() == 50 and before.count() == 200  # a reader of the version before goes on
    tables.save("papers", a.limit(1), "pid")
    assert tables._versions("papers", False) == [2, 3]  # the first is gone; what was turned away left no trace


def test_pairs_by_batches(spark, tmp_path):
    e = spark.createDataFrame([(f"W{i}", ";".join(f"W{(i * k) % 40 + 1}" for k in range(1, 9))) for i in range(1, 41)], "source string, targets string")
    batches = PairBatches(spark, str(tmp_path / "b"), 6)
    batches.deal(e, files=2)
    assert batches.run() == list(range(6)) and batches.run() == []
    want = sorted(map(tuple, graph.mutual_pairs(e).collect()))
    assert sorted(map(tuple, batches.pairs().collect())) == want and want
    (tmp_path / "b/_committed/4").unlink()
    shutil.rmtree(tmp_path / "b/pairs/batch=4", ignore_errors=True)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "b/pairs").rglob("*.parquet")}
    assert batches.run() == [4]
    assert all(f.stat().st_mtime_ns == t for f, t in kept.items())  # only the one batch was written
    assert sorted(map(tuple, batches.pairs().collect())) == want
    plan = batches.build(4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan and "= 4)" in plan


def test_the_whole_job_goes_on_where_it_was(spark, tmp_path, capsys):
    lists = {1: (2, 3, 4), 2: (1,), 3: (1, 4, 5), 4: (3,), 5: (900,)}
    write(tmp_path / "in/1.gz", [work(n, 2000 + n % 2, named("AB"[n % 2]), None, [f"{URL}W{t}" for t in to]) for n, to in lists.items()])
    spark.createDataFrame([(f"{URL}W900", 1960, (("C",),))], schemas.WORKS_PARQUET).coalesce(1).write.parquet(str(tmp_path / "old"))
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"url": str(f)} for f in (tmp_path / "old").glob("part-*")]}))
    args = job.arguments(["--works", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--earlier-manifest", str(tmp_path / "m.json"), "--bucketed", "whole_job"])
    config = Config(min_papers=1, min_references=1)
    first = job.run(spark, args, config)
    assert len(first["ran"].split()) == 14 and "pairs,3" in first["stages"] and "same_year" in first["citation_lag"] and "FAIL" not in first["ledger"]
    again = job.run(spark, args, config)
    assert again["ran"] == "\n" and {k: v for k, v in again.items() if k != "ran"} == {k: v for k, v in first.items() if k != "ran"}
    write(tmp_path / "in/2.gz", [work(6, 2001, named("A"), None, [f"{URL}W5", f"{URL}W1"]), work(7, 2001, named("A"), None, [f"{URL}W6"])])
    more = job.run(spark, args, config)
    assert len(more["ran"].split()) == 14 and "retained,7" in more["stages"]


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_files") or n.startswith(("parts_", "manifest", "mutual_pairs_", "cohort_", "csv_", "table_"))])
def test_queries_over_files_can_be_repeated(spark, name):
    rows = [sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1]
