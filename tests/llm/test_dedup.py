import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import edited, prose, thue_morse

from loomgraph.llm import toxicity, components, exact_dedup, jaccard_join, substring_dedup
from loomgraph.llm.suffix_array import common_prefixes, induced_sort


def spaceless(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_exact(odd, odd_rows, empty):
    groups = collections.defaultdict(list)
    for i, t in odd_rows:
        groups[spaceless(t)].append((-len(t or ""), i is None, i))
    want = []
    for i, t in odd_rows:
        own = groups[spaceless(t)]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, keep, len(own), i == keep, hashlib.sha256(spaceless(t).encode()).hexdigest()))
    got = exact_dedup.exact_dedup(odd, capacity=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(spaceless(r["text"]) for r in kept.collect()) == dict.fromkeys(groups, 1)


def test_hot_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 4)
    rows = [(k % 7, "hot text" + " " * (k % 3)) for k in range(40)] + [(50, "other")] * 3 + [(None, "no id")] * 2 + [(None, "no  id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, capacity=1).collect()
    assert len(got) == len(rows) and {(r["group_size"], r["keep_id"]) for r in got} == {(40, 0), (3, 50), (3, None)}
    kept = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in exact_dedup.keep_first(docs).collect())
    assert [x[1] for x in kept] == [0, 50, None] and spaceless(kept[0][2]) == "hottext"


def test_colliding_keys_share_a_chain(odd, odd_rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_key", lambda: F.length("norm").cast("long") % 3)
    got = exact_dedup.exact_dedup(odd).collect()
    distinct = {spaceless(t) for _, t in odd_rows}
    assert len(got) == len(odd_rows) and len({r["key"] for r in got}) == 3
    assert {(r["key"], r["place"]) for r in got} == {(k, p) for k in range(3) for p in range(1, 1 + sum(len(t) % 3 == k for t in distinct))}
    size = collections.Counter(spaceless(t) for _, t in odd_rows)
    assert sorted(r["group_size"] for r in got) == sorted(size[spaceless(t)] for _, t in odd_rows)


def test_directory_doubles_until_no_bucket_is_overfull():
    r = random.Random(1)
    for spread in (1, 40):
        sizes = collections.Counter(r.randrange(1 << exact_dedup.MAX_DEPTH) // spread for _ in range(4000))
        depth, buckets = exact_dedup.directory(sizes, 100)
        assert sum(n for *_, n in buckets) == 4000 and depth == max(bits for _, bits, _ in buckets)
        starts = [prefix << (exact_dedup.MAX_DEPTH - bits) for prefix, bits, _ in buckets]
        assert starts == sorted(set(starts)) and starts[0] == 0
        for prefix, bits, n in buckets:
            width = 1 << (exact_dedup.MAX_DEPTH - bits)
            own = sum(v for c, v in sizes.items() if prefix * width <= c < (prefix + 1) * width)
            assert own == n and (n <= 100 or bits == exact_dedup.MAX_DEPTH)
            if bits:  # its parent was overfull
                assert sum(v for c, v in sizes.items() if c // (2 * width) == prefix // 2) > 100


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def jaccard_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, len(s), least.get(find(k)))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("block", "bits"), [(2000, 64), (2, 64), (2, 2)])
def test_jaccard(odd, odd_rows, monkeypatch, block, bits):
    """With two bits of a digest nearly all sets share theirs with others."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "DIGEST_BITS", bits)
    got = jaccard_join.jaccard_join(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == jaccard_brute(odd_rows)


def test_documents_without_id_link(spark):
    base = prose(40, 150)
    rows = [(None, base), (None, edited(base, 1, 0.01)), (None, edited(base, 2, 0.01)), (None, prose(41, 90)), (7, prose(42, 200)), (None, edited(prose(42, 200), 3, 0.01)), (None, None), (8, ""), (7, prose(43, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == jaccard_brute(rows)
    kept = [r["text"] for r in jaccard_join.keep_representatives(docs).collect()]
    assert sum(t in [x for _, x in rows[:3]] for t in kept) == 1 and len(kept) == 6 and rows[4][1] in kept and rows[5][1] not in kept


def test_many_members_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    base = prose(50, 60)
    rows = [(k, edited(base, 60 + k, 0.004 * (k % 12))) for k in range(90)] + [(100 + k, base + " " + prose(70 + k, 4 * k)) for k in range(8)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == jaccard_brute(rows)


def test_sizes_of_points_meet():
    """Pairs whose points have different numbers of groups are held against each other, and no link is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    draw = lambda k: np.unique(rng.integers(0, 2**64, k, dtype=np.uint64))
    sets = [draw(int(k)) for k in rng.integers(1, 300, 40)]
    sets = [x for s in sets for x in (s, np.unique(np.concatenate([s[: int(len(s) * 0.93)], draw(int(len(s) * 0.12))])))]
    for hubs in (1, 9):
        hub = np.sort(np.arange(len(sets)) % hubs)
        points = [jaccard_join.point(s, int(jaccard_join._groups(np.array([len(s)]))[0])) for s in sets]
        whole = np.zeros(len(sets), np.int64)
        columns = {"hub": hub, "i": whole, "j": whole, "side": whole + 2, "cls": np.arange(len(sets)), "component": np.arange(len(sets)), "head": np.ones(len(sets), bool), "n": np.array([len(s) for s in sets], np.int32)}
        batch = pa.RecordBatch.from_pydict({**columns, "point": [p.tobytes() for p, _ in points], "excess": [e for _, e in points]})
        got = {(a, b) for out in jaccard_join._search([batch]) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
        want = {(a, b) for b in range(len(sets)) for a in range(b) if hub[a] == hub[b] and 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - both)}
        assert want and want <= got and len(got) < 4 * len(want)


def test_long_sets_keep_whole_hashes(monkeypatch):
    h = np.unique(np.random.default_rng(5).integers(0, 2**64, 900, dtype=np.uint64))
    monkeypatch.setattr(jaccard_join, "SHORT", 700)
    (short, a), (long, b) = (jaccard_join.unpacked(jaccard_join.packed(x)) for x in (h[:700], h))
    assert (a, b) == (5, 8) and (long == h).all() and (short == h[:700] >> np.uint64(24)).all()
    assert jaccard_join.overlap(short, a, long, b) == jaccard_join.overlap(long, b, short, a) == 700
    assert jaccard_join.overlap(long, b, long ^ np.uint64(1), b) == len(np.intersect1d(h, h ^ np.uint64(1)))
    assert jaccard_join.overlap(*jaccard_join.unpacked(jaccard_join.packed(h[:0])), long, b) == 0


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_near_copies_keep_one_document(odd):
    kept = jaccard_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 6 in ids and not ids & {7, 8, 9, 10}


def test_r_tree_bound_misses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2000, rng.integers(1, 400), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], rng.integers(0, 9, 3, dtype=np.uint64)])) for s in sets]
    points, n = np.array([jaccard_join.point(s, 128)[0] for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard_join.RTree(points, n, np.array([jaccard_join.point(s, 128)[1] for s in sets]))
    seen = 0
    for k, s in enumerate(sets):
        found = set(tree.search(points[k], int(n[k]), 0).tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 75 * (len(s) + len(t) - both):
                assert j in found
        seen += len(found)
    assert seen < len(sets) ** 2 / 4


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(12)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[k] == v for k, v in got.items()) and {k for k, v in root.items() if v != k} <= got.keys()


def cut_brute(rows, size=200):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(x[i : i + size] for x in raw for i in range(len(x) - size + 1))
    out = []
    for (i, _), x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if count[x[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        n_spans = sum(1 for k in range(len(x)) if gone[k] and (not k or not gone[k - 1]))
        out.append(repr((i, len(x), sum(gone), n_spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 3, 1])
def test_substrings(odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = substring_dedup.cut(odd).select("doc_id", "__n_bytes", "__n_removed", "__n_spans", "__kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == cut_brute(odd_rows)


@pytest.mark.parametrize("hot", [256, 1])
def test_doubled_lines_meet_single_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = []
    for k in range(12):
        head, line = prose(300 + k, 40), prose(400 + k, 40)[: 60 + 8 * k] + "\n"
        rows += [(3 * k, head + line + line + prose(500 + k, 40)), (3 * k + 1, head + line + prose(600 + k, 40)), (3 * k + 2, prose(700 + k, 40) + line * 3)]
    got = substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__n_bytes", "__n_removed", "__n_spans", "__kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == cut_brute(rows)


def periodic(seed: int) -> str:
    """Stretches of short periods, of several lengths, with other text around."""
    r = random.Random(seed)
    out = []
    for k in range(6):
        unit = prose(1000 + r.randrange(6), 12)[: r.choice((1, 2, 3, 7, 40, 60, 101, 150))]
        out += [prose(2000 + seed + k, r.randrange(6)), (unit * 2000)[: r.randrange(100, 1800)]]
    return "".join(out)


@pytest.mark.parametrize("hot", [256, 1])
def test_periods_are_cut_and_still_meet(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = [(k, periodic(k)) for k in range(40)] + [(100, "q" * 5000), (101, prose(3, 40) + "z" * 200), (102, "z" * 260), (103, ("ab" * 3000) + ("abc" * 2000)), (104, "ab" * 100)]
    got = substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__n_bytes", "__n_removed", "__n_spans", "__kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == cut_brute(rows)


def test_squeezed_texts_keep_their_windows():
    r, cut = random.Random(9), 0
    for seed in range(60):
        raw = np.frombuffer(periodic(seed).encode(), np.uint8)
        h = substring_dedup.signed(substring_dedup.grams(raw, substring_dedup.GRAM))
        at = substring_dedup.squeezed(raw, int(h[r.randrange(len(h))]))
        windows = lambda x: collections.Counter(x[i : i + 200] for i in range(len(x) - 199))
        long, short = windows(raw.tobytes()), windows(raw[at].tobytes())
        assert long.keys() == short.keys() and all((n > 1) == (short[w] > 1) for w, n in long.items())
        left = set(at.tolist())
        assert all(long[raw[i : i + 200].tobytes()] > 1 for i in range(len(raw)) if i not in left)
        cut += len(at) < len(raw)
    assert cut > 20


@pytest.mark.parametrize("again", [False, True])
def test_blocks_come_in_small_batches(again):
    if again:  # one long context, its anchor's gram in each window
        core = prose(5, 20).encode()[: substring_dedup.GRAM]
        bodies = [b"".join(core + prose(k, 20).encode()[:100] for k in range(200))]
        anchor = int(substring_dedup.grams(np.frombuffer(core, np.uint8), substring_dedup.GRAM).view(np.int64)[0])
    else:
        bodies, anchor = [prose(k, 150).encode()[:352] for k in range(100)], 5
    windows = [len(b) - substring_dedup.SPAN + 1 for b in bodies]
    n = len(bodies)
    columns = {"anchor": [anchor] * n, "ctx": range(n), "n": [1] * n, "again": [again] * n, "first": [0] * n, "place": [-20] * n, "windows": windows, "body": bodies}
    batch = pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()})
    made = list(substring_dedup._blocks(iter([batch]), 1))
    assert max(b.nbytes for b in made) < 1.5 * substring_dedup.BLOCK_BYTES
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["ctx"], r["first"], r["windows"], r["body"]) for r in rows] == [(c, k, 1, b[k : k + substring_dedup.SPAN]) for c, b in enumerate(bodies) for k in range(windows[c])]
    assert not list(substring_dedup._blocks(iter([batch.slice(0, 0)]), 1))


def test_long_texts_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "a" * 5_000_000), (2, "b" + "a" * 4_999_999 + "c"), (3, prose(5, 50))], "doc_id long, text string")
    start = time.monotonic()
    got = {r["doc_id"]: (r["__n_removed"], r["__n_spans"]) for r in substring_dedup.cut(docs).collect()}
    assert got == {1: (5_000_000, 1), 2: (4_999_999, 1), 3: (0, 0)} and time.monotonic() - start < 60


def test_removed_passages_leave_the_other_columns(odd, empty):
    new = substring_dedup.remove_repeats(odd)
    assert new.columns == odd.columns
    rows = {r["doc_id"]: r for r in new.collect()}
    assert rows[13]["kept"] == "mine" and rows[13]["n_chars"] == len(rows[13]["text"]) and rows[5]["text"] == "one two three four five"
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_texts_that_fool_a_power_of_two(spark):
    x, y = thue_morse(11)
    rows = [(1, f"{x} a b c d"), (2, f"{y} a b c d"), (3, x + prose(1, 40)), (4, y + prose(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == jaccard_brute(rows)
    got = substring_dedup.cut(docs).select("doc_id", "__n_bytes", "__n_removed", "__n_spans", "__kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == cut_brute(rows)


def test_hashes_are_modulo_the_prime():
    from loomgraph.llm.shared import BASE, PRIME, prefix_hash, span_hash, times

    r = np.random.default_rng(8)
    a, b = (np.concatenate([r.integers(0, PRIME, 500, dtype=np.uint64), np.array([0, 1, PRIME - 1], np.uint64)]) for _ in range(2))
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)]
    codes = r.integers(0, 0x110000, 700).astype(np.uint32)
    want, total = [0], 0
    for k, c in enumerate(codes.tolist()):
        total = (total + (c + 1) * pow(BASE, k, PRIME)) % PRIME
        want.append(total)
    assert prefix_hash(codes).tolist() == want
    again = prefix_hash(np.concatenate([codes[5:], codes]))
    at = np.arange(5, 600)
    assert (span_hash(prefix_hash(codes), at, at + 60) == span_hash(again, at - 5, at + 55)).all()


@pytest.mark.parametrize("bulk", [0, 2, 64])
def test_suffix_arrays(monkeypatch, bulk):
    from loomgraph.llm import suffix_array

    monkeypatch.setattr(suffix_array, "BULK", bulk)
    r = random.Random(3)
    for _ in range(300):
        kinds = r.choice((1, 2, 3, 5, 30))
        text = [r.randrange(kinds) for _ in range(r.randint(1, 90))]
        order = induced_sort(text, kinds)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = common_prefixes(np.array(text), np.array(order), 12)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert common[b] == min(12, k)


def test_columns_of_any_name_stay(spark):
    """Columns with dots and clashing names go through every filter as they came."""
    text = prose(70, 60)
    rows = [(1, text, "en", "s", len(text), "x", 1), (2, text, "en", "s", len(text), "y", 2), (3, prose(71, 40), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `__text` long")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for keep, n in ((exact_dedup.keep_first, 2), (jaccard_join.keep_representatives, 2), (lambda d: toxicity.keep_clean(d, labels), 3)):
        got = keep(docs)
        assert got.columns == docs.columns and got.count() == n
    got = substring_dedup.remove_repeats(docs.withColumnRenamed("__text", "a b"))
    assert got.columns == [*docs.columns[:-1], "a b"] and {r["a.b"] for r in got.collect()} == {"x", "y", None}
