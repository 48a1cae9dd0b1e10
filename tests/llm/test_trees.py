"""Merkle manifest and prefix trie against brute force, on odd rows and on trees of many shapes."""

import hashlib
import random
import zlib

import pytest

from loomgraph.llm import merkle, prefix_trie
from loomgraph.llm.merkle import document_leaves, manifest
from tests.llm.conftest import prose


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_brute(leaves):
    """(root, for each leaf [(before, after)] of its siblings by level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 3 : i - i % 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
            at[k] = i // 3
        level = [H(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def merkle_brute(rows):
    """Of (doc_id, text, lang, source, n_chars): what the query returns, by (doc_id, leaf)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t, d=(doc_id, source, lang, n): H([field(x) for x in (*d, t)])
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf(text)), doc_id, leaf(text), leaf(text.replace("\n", "") if changed else text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(groups[s], key=lambda x: x[0]), *tree_brute([x[2] for x in sorted(groups[s], key=lambda x: x[0])])) for s in order]
    root, upper = tree_brute([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), more in zip(trees, upper, strict=True):
        for (_, doc_id, leaf, given), path in zip(own, paths, strict=True):
            path = [*path, *more]
            proof = H([d for a, b in path for d in [*a, *b]])
            for a, b in path:
                given = H([*a, given, *b])
            out.append((doc_id, leaf, subroot, root, proof, given, given == root))
    return sorted(out, key=repr)


def merkle_of(docs):
    out = manifest(document_leaves(docs)).verified(merkle.F.coalesce("other", "leaf"))
    return sorted(
        ((r["doc_id"], *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_digest", "folded")), r["verified"]) for r in out.collect()), key=repr
    )


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_merkle_of_odd_rows(spark, odd, odd_rows, empty):
    assert merkle_of(odd) == merkle_brute([(i, t, "en" if i else None, None, len(t or "")) for i, t in odd_rows])
    assert merkle_of(empty) == []


@pytest.mark.parametrize("slab", [2, 6])
def test_merkle_of_many_shapes(spark, monkeypatch, slab):
    """Sources of 1 to 250 rows, null and empty names, one that holds most rows; slabs so low that trees span several."""
    monkeypatch.setattr(merkle, "SLAB", slab)
    r = random.Random(slab)
    sizes = {None: 4, "": 1, "ß": 2, "a": 3, "b": 9, "c": 10, "z.y": 27, "hot": 250, **{f"s{k}": r.randrange(1, 6) for k in range(12)}}
    rows = [(r.randrange(10**6), f"line {k}\nand {k % 7}", r.choice(["en", None]), s, r.choice([k, None])) for s, n in sizes.items() for k in range(n)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "extra") for x in rows], f"{COLUMNS}, `a.b` string").repartition(5)
    want = merkle_brute(rows)
    assert merkle_of(docs) == want
    assert {x[-1] for x in want} == {True, False}


def test_merkle_of_one_row_and_of_copies(spark):
    one = spark.createDataFrame([(7, "x", "en", "s", 1)], COLUMNS)
    got = merkle_of(one)
    assert got == merkle_brute([(7, "x", "en", "s", 1)]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H([])
    same = [(7, "x\ny", "en", "s", 1)] * 30 + [(8, "z", "en", None, 1)]
    assert merkle_of(spark.createDataFrame(same, COLUMNS).repartition(4)) == merkle_brute(same)


def test_a_proof_fails_for_another_leaf(spark, odd):
    m = manifest(document_leaves(odd))
    F = merkle.F
    assert m.verified(F.col("leaf")).where("verified").count() == odd.count()
    assert m.verified(F.unhex(F.sha2(F.col("leaf"), 256))).where("verified").count() == 0


def turns_brute(rows):
    """{conv_id: [(role, text)]} of (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest[:32]), role, text))
    return {c: [x[1:] for x in sorted(own)] for c, own in convs.items()}


def rebuilt_brute(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(c - 20 * int(c / 20)) , [])[:h] + own[h:]
    return out


def trie_brute(convs):
    nodes = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    words = lambda k: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", k[-1][1]) if w]) if k else 0
    children, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + (len(members) - 1) * words(k)
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
    out = []
    for k, members in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k)).encode()).hexdigest()
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children.get(k, 0), leaves[k], saved[k], ends))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def random_turns(seed, convs, most):
    r = random.Random(seed)
    texts = [prose(k, 3) for k in range(2)] + ["", None, "a  b", " a\tb "]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(texts[: 2 + r.randrange(5)])) for c in range(convs) for t in range(r.randrange(1, most))]
    same = [(c, t, "user", f"common {t}") for c in range(1000, 1000 + convs // 3) for t in range(4)]
    long_ = [(c, t, "user", "deep" if t < 60 or c == 2001 else "other") for c in (2000, 2001, 2002) for t in range(60 + 20 * (c - 2000))]
    rows += same + long_ + [(-7, 1, "user", "negative"), (None, 1, "user", "of none"), (3000, 0, None, None), (3000, 0, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,lead", [(1, 32), (12, 1)])
def test_trie_against_brute_force(spark, parts, lead, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEADING", lead)
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = random_turns(parts, 60, 9)
    frame = spark.createDataFrame([(*x, 1) for x in rows], f"{TURNS}, `key.x` int").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = turns_brute(rows)
        assert trie_of(prefix_trie.prefix_trie(frame)) == trie_brute(own)
        assert trie_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame)))) == trie_brute(rebuilt_brute(own))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_turnless_and_empty(spark):
    rows = [(5, 0, "user", "x"), (26, 0, "user", "y"), (27, 0, "user", "z")]  # 20 and 0 aren't there to lend a turn
    frame = spark.createDataFrame(rows, TURNS)
    got = trie_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame))))
    assert got == trie_brute(rebuilt_brute(turns_brute(rows)))
    assert trie_of(prefix_trie.prefix_trie(frame.limit(0))) == []
    same = [(c, 0, "user", "x") for c in range(1, 9)]
    assert trie_of(prefix_trie.prefix_trie(spark.createDataFrame(same, TURNS))) == trie_brute(turns_brute(same))
