import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import figures, graph, metrics, validation


def edges(spark, **lists):
    return spark.createDataFrame([(k, v) for k, v in lists.items()], "source string, targets string")


def papers(spark, rows):
    return spark.createDataFrame(rows, "id string, year int, field string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pairs(spark):
    e = edges(spark, W1="W2;W2;W5", W2="W1", W3="W1;W3")
    assert rows(graph.mutual_pairs(e)) == [("W1", "W2")]
    assert rows(graph.mutual_pairs(edges(spark, W10="W9", W9="W10"))) == [("W9", "W10")]  # by number, not by letters
    assert rows(graph.sources(e)) == [(1,), (2,), (3,)] and rows(graph.cited(e)) == [(1,), (2,), (3,), (5,)]


def test_pairs_of_a_random_graph(spark):
    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.dictionaries(st.integers(1, 9), st.lists(st.integers(1, 12), min_size=1, max_size=8), min_size=1))
    def check(lists):
        e = spark.createDataFrame([(f"W{k}", ";".join(f"W{t}" for t in v)) for k, v in lists.items()], "source string, targets string")
        want = {(f"W{a}", f"W{b}") for a in lists for b in lists if a < b and b in lists[a] and a in lists[b]}
        found = graph.mutual_pairs(e)
        assert set(map(tuple, found.collect())) == want
        counted = {r["id"]: r["n_mutual"] for r in metrics.n_mutual(found).collect()}
        assert sum(counted.values()) == 2 * len(want)
        cited = {r["id"]: r["n_cited"] for r in metrics.n_cited(e).collect()}
        assert cited == {k: len(set(v) - {k}) for k, v in lists.items() if set(v) - {k}}

    check()


def test_n_cited(spark):
    e = edges(spark, W1="W1;W1", W2="W3;W4;W4;W2", W5="W999")
    assert rows(metrics.n_cited(e)) == [(2, 2), (5, 1)]
    assert rows(metrics.n_cited(e, distinct=False)) == [(1, 1), (2, 3), (5, 1)]
    assert tuple(validation.edges_shape(e).first()) == (3, 3, 7, 2, 2, 2)


def test_diversity(spark):
    a = papers(spark, [("W1", 2000, "A"), ("W2", 2000, "B"), ("W3", 2000, "Unknown"), ("W4", 2000, None), ("W6", 2001, "A")])
    e = edges(spark, W1="W1;W2;W3;W4;W77;W99", W2="W2")
    earlier = spark.createDataFrame([(77, "C"), (2, "C")], "id bigint, field string")
    before = metrics.diversity_count(e, metrics.field_lookup(a))
    after = metrics.diversity_count(e, metrics.field_lookup(a, earlier))
    assert rows(before) == [(1, 1), (2, 0)] and rows(after) == [(1, 2), (2, 0)]
    rated = metrics.with_diversity(a, before)
    assert {r["id"]: r["diversity_count"] for r in rated.collect()} == {"W1": 1, "W2": 0, "W3": 0, "W4": 0, "W6": 0}
    both = metrics.diversity_both(e, a, earlier)
    assert rows(both) == [(1, 1, 2), (2, 0, 0)]
    change = metrics.diversity_before_after(rated, both).first()
    assert tuple(change) == (2000, 2, 0.5, 1.0, 0.5, 50.0)
    assert rows(graph.clean_attributes(a).select("id")) == [("W1",), ("W2",), ("W6",)]
    assert rows(graph.isolated(a, e).select("id")) == [("W6",)] and graph.retain_connected(a, e).count() == 4


def test_diversity_of_many_fields(spark):
    a = papers(spark, [(f"W{k}", 2000, f"F{k}") for k in range(1, 201)])
    e = edges(spark, W900=";".join(f"W{k}" for k in range(1, 201)))
    assert rows(metrics.diversity_count(e, metrics.field_lookup(a))) == [(900, 200)]
    more = papers(spark, [(f"W{k}", 2000, f"F{k % 700}") for k in range(1, 1001)])
    late = spark.createDataFrame([(k, f"F{k % 900}") for k in range(1001, 2001)], "id bigint, field string")
    e = edges(spark, W900=";".join(f"W{k}" for k in range(1, 2001)), W5000="W1;W701;W2", W5001="W5001")
    assert rows(metrics.diversity_both(e, more, late)) == [(5000, 2, 2), (5001, 0, 0), (900, 700, 900)]


def _cohort(spark, counts):
    data = [(i, n, i % 2, 2000, d) for i, (n, d) in enumerate(counts)]
    return spark.createDataFrame(data, "id bigint, n_cited bigint, n_mutual bigint, year int, diversity_count int")


def test_deciles_keep_ties_together(spark):
    assert rows(figures.value_deciles(_cohort(spark, [(7, 1)] * 100))) == [(7, 100, 6)]
    wide = figures.value_deciles(_cohort(spark, [(n, 3) for n in range(3, 103)])).orderBy("n_cited").collect()
    deciles = [r["decile"] for r in wide]
    assert deciles == sorted(deciles) and set(deciles) == set(range(1, 11))


def test_groups_shares_and_rates(spark):
    grouped = figures.grouped(_cohort(spark, [(3, 0), (3, 1), (3, 2), (3, 3)]))
    assert sorted((r["diversity_count"], r["group"]) for r in grouped.collect()) == [(0, None), (1, "non-diverse"), (2, "non-diverse"), (3, "diverse")]
    assert rows(figures.decile_share(grouped)) == [(6, "diverse", 1, 1, 100.0), (6, "non-diverse", 2, 1, 50.0)]
    assert rows(figures.decile_rate(grouped).select("group", "rate_pct")) == [("diverse", 100.0 / 3), ("non-diverse", 100.0 / 6)]
    nothing = figures.mutual_rate_per_year(_cohort(spark, [(0, 1)]), 1).first()
    assert nothing["rate_pct"] is None  # no references, no rate, no error


def test_lag(spark):
    a = papers(spark, [(f"W{i}", 2000 + i, "A") for i in range(6)])
    p = spark.createDataFrame([("W0", "W0"), ("W0", "W1"), ("W0", "W2"), ("W5", "W2"), ("W0", "W4"), ("W0", "W99")], "paper_a string, paper_b string")
    assert {r["threshold"]: (r["n_pairs"], r["n_total"]) for r in figures.citation_lag(p, a).collect()} == {"same_year": (1, 5), "within_1_year": (2, 5), "within_2_years": (3, 5), "within_3_years": (4, 5)}
    assert {r["cumulative_pct"] for r in figures.citation_lag(p.limit(0), a).collect()} == {0.0}


def test_either_end_join(spark):
    a = papers(spark, [("W1", 2000, "Unknown"), ("W2", 2000, "Unknown"), ("W3", 2000, "A"), ("W4", 2000, "A")])
    for pair, n in ((("W1", "W2"), 2), (("W1", "W3"), 1), (("W3", "W4"), 0), (("W1", "W1"), 1)):
        assert validation.pairs_unknown(spark.createDataFrame([pair], "paper_a string, paper_b string"), a).first()[0] == n


def test_validation(spark):
    a = papers(spark, [("W1", 1975, "A"), ("W3", 1977, "A"), ("Wabc", 1977, "A"), ("", 1975, None), ("W12.7", 1977, "A")])
    assert tuple(validation.attribute_counts(a).first()) == (5, 3, 2)
    assert rows(validation.missing_years(a, 1975, 1977)) == [(1976,)]
    ledger = validation.validate(a, edges(spark, W1="W3", W9="W1"), 1975, 1977, expect_attributes=5)
    assert [r["status"] for r in ledger.summary(spark).collect()][:3] == ["FAIL", "FAIL", "FAIL"]
    with pytest.raises(validation.ValidationFailed, match="id parse"):
        ledger.close()
    done = spark.createDataFrame([("a",), ("c",)], "key string")
    assert rows(validation.completeness(spark.createDataFrame([("a",), ("b",)], "key string"), done)) == [("b", "missing"), ("c", "stale")]
    raw = spark.createDataFrame([("1", "4"), ("2", "-1"), ("x", "3"), ("4", "2")], "id string, n string")
    assert tuple(validation.metric_stats(raw, "n").first()) == (4, 2, 6, 2, 4)


def test_empty_tables(spark):
    e, a = edges(spark, W1="W2").limit(0), papers(spark, [("W1", 2000, "A")]).limit(0)
    assert graph.mutual_pairs(e).count() == 0 and metrics.n_cited(e).count() == 0
    assert metrics.diversity_count(e, metrics.field_lookup(a)).count() == 0
    assert figures.value_deciles(_cohort(spark, [(3, 1)]).limit(0)).count() == 0
    assert figures.growth(figures.papers_per_year(a, 1975, 2023)).select(F.col("growth_pct")).first()[0] is None
