"""The pipeline on the smallest tables, each stage against brute force or what it promises."""

import collections
from pathlib import Path

import corpus_pipeline
from tests.llm.test_dedup import cut_brute, jaccard_brute, spaceless

from loomgraph.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        held[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    before, after = held["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert sum(labels.get(r["doc_id"]) == 0 and r["doc_id"] not in kept for r in before) <= 1
    before, after = held["exact_dedup"]
    assert sorted(spaceless(r["text"]) for r in after) == sorted({spaceless(r["text"]) for r in before})
    before, after = held["jaccard_join"]
    components = [eval(x) for x in jaccard_brute([(r["doc_id"], r["text"]) for r in before])]
    assert {r["doc_id"] for r in after} == {c for _, _, c in components}
    before, after = held["suffix_array_dedup"]
    want = {eval(x)[0]: eval(x) for x in cut_brute([(r["doc_id"], r["text"]) for r in before])}
    for r in after:
        _, n, gone, _, _ = want[r["doc_id"]]
        assert 0 <= n - gone - len(r["text"].encode()) <= 6 and r["n_chars"] == len(r["text"])  # a cut may break a character
    before, after = held["packing"]
    tokens = collections.Counter()
    for r in after:
        tokens[r["doc_id"]] += r["length"]
    assert tokens.keys() == {r["doc_id"] for r in before} and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in after)


def _tables(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, len(t or ""), "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_over_odd_rows(spark, odd_rows, tmp_path):
    """Every document that the stages keep is packed once, with the tokens of its text; without labels none is toxic."""
    _tables(spark, tmp_path, odd_rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = {}
    for i, t in sorted(odd_rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
        first.setdefault(spaceless(t), (i, t))
    components = [eval(x) for x in jaccard_brute(list(first.values()))]
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == {i for i, _, least in components if i is not None and i == least}
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for i, pieces in by_doc.items():
        if i is not None:
            assert [s for s, *_ in sorted(pieces)] == [sum(n for _, n, _ in sorted(pieces)[:k]) for k in range(len(pieces))]


def test_run_over_nothing(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_lost_driver_goes_on_where_it_stood(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path, [(k, f"text number {k} of some words") for k in range(6)])
    ran, broken = [], [True]

    def stage(name, fails=False):
        def of(spark, docs, sf_dir):
            ran.append(name)
            if fails and broken[0]:
                raise RuntimeError("lost")
            return docs.where(f"doc_id <> {len(name)}")

        return name, of

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("bb"), stage("ccc", True), stage("dddd")])
    work = f"{tmp_path}/work"
    try:
        corpus_pipeline.run(spark, str(tmp_path), work)
        raise AssertionError("the third stage breaks off")
    except RuntimeError:
        pass
    assert ran == ["a", "bb", "ccc"]
    broken[0] = False
    (Path(work) / "2_bb" / "_SUCCESS").unlink()  # a table without its mark is not whole
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path), work).collect()}
    assert got == {0, 5} and ran == ["a", "bb", "ccc", "bb", "ccc", "dddd"]
