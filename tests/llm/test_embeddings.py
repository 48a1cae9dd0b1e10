"""Embedding near-dedup against brute force: links, components, hot buckets, odd vectors."""

import numpy as np
import pytest

from loomgraph.llm import embedding_dedup
from loomgraph.llm.embedding_dedup import SIMILAR, codes, hadamard, near_embeddings


def brute(rows):
    """{place: (links, component)} of (vec_id, vector) rows."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= SIMILAR:
                near[a].add(b)
    out, seen = {}, set()
    for k in range(len(rows)):
        if k not in seen:
            todo, own = [k], {k}
            while todo:
                for b in near[todo.pop()] - own:
                    own.add(b)
                    todo.append(b)
            seen |= own
            ids = [rows[i][0] for i in own if rows[i][0] is not None]
            out |= {i: (len(near[i]), min(ids) if ids else None) for i in own}
    return out


def clusters(seed, sizes, dim, spread):
    r = np.random.default_rng(seed)
    out = []
    for n in sizes:
        c = r.normal(size=dim)
        out += [c / np.linalg.norm(c) + r.normal(size=dim) * s / np.sqrt(dim) for s in r.uniform(0, spread, n)]
    return np.array(out)


def check(spark, rows, block, kind="float"):
    frame = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int").repartition(4)
    got = sorted(map(tuple, near_embeddings(frame, block).collect()), key=repr)
    found = brute(rows)
    want = sorted(((i, *found[k], i == found[k][1]) for k, (i, _) in enumerate(rows)), key=repr)
    return got, want


@pytest.mark.parametrize("block", [6, 512])
def test_clusters(spark, block):
    """Tight and loose groups; block 6 sends most buckets through cores and pairs of blocks."""
    x = np.float32(np.concatenate([clusters(1, [40, 25, 1, 1, 2], 16, 0.1), clusters(2, [30], 16, 0.35)]))
    rows = [(int(k) * 3 % 1000, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(5000 + k, rows[0][1]) for k in range(50)]
    got, want = check(spark, rows, block)
    links, wanted = {r[0]: r[1] for r in got}, {r[0]: r[1] for r in want}
    assert all(links[i] <= n for i, n in wanted.items())
    assert sum(links.values()) >= 0.98 * sum(wanted.values())
    tight = [r for r in want if r[0] >= 5000 or r[0] < 195]
    assert [r for r in got if r[0] >= 5000 or r[0] < 195] == tight


def test_odd_vectors(spark):
    v = [0.5, 0.25, -1.0]
    rows = [(1, v), (2, [2 * c for c in v]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [1.0, float("nan"), 2.0]), (9, [float("inf"), 1.0, 1.0])]
    rows += [(None, v), (None, [1.0, 7.0, 1.0]), (1, v), (10, [0.5, 0.25]), (11, [1.0]), (12, [3.0]), (13, [-1.0]), (14, [1e-30, 0.0, -0.0]), (15, [1.0, -0.0, 0.0]), (16, [1e-200, 1e-200, 0.0]), (17, [1e200, 1e200, 0.0])]
    rows_float = [r for r in rows if r[0] not in (16, 17)]
    got, want = check(spark, rows_float, 512)
    assert got == want
    got, _ = check(spark, rows, 512, "double")
    assert {r[0]: r[1:] for r in got}[16] == (1, 16, True)
    assert check(spark, [], 512)[0] == []


def test_recall_at_the_limit():
    """Pairs at a cosine of exactly SIMILAR: 98 % meet at least; so the promise of 0.9 holds for any input."""
    r = np.random.default_rng(3)
    for dim in (32, 64, 100):
        x = r.normal(size=(4000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = r.normal(size=x.shape)
        y -= (x * y).sum(1, keepdims=True) * x
        y = SIMILAR * x + np.sqrt(1 - SIMILAR**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = codes(x), codes(y)
        met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
        assert met.mean() >= 0.98
        assert (embedding_dedup._first_meeting(a, b)[~met] == np.iinfo(np.int64).max).all()


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(hadamard(x), x @ h / 4)
