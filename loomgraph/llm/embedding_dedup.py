"""Near copies among embeddings: cross-polytope hashes after fast Hadamard rotations, probed buckets, verified pairs.

Vectors with the same components are one class, counted first. A class's hash in a table joins HASHES cross-polytope hashes:
after three rounds of random signs and a fast Hadamard transform, the coordinate of largest magnitude and its sign. Besides
its home bucket a class visits the next likely ones, as the coordinates next in magnitude say. Two classes meet where one's
home is among the other's buckets; of all that meet, those with a cosine of SIMILAR or more are linked. A pair that meets in
several buckets counts in the first of them only (its hashes are worked out again to tell), so no pairs are kept: a bucket
gives each class a sum of links and its local component. Ids are shuffled to count the buckets; vectors only where
more than one class meets.

Hot buckets, of more than `block` classes: a pivot's members within half the angle of SIMILAR are all linked to one
another, by the triangle inequality, so they form a core that is counted by one grouping, and pairs inside it are never
looked at. What else a hot bucket holds is dealt into blocks of about `block`, and pairs of blocks are the tasks' groups: where
many distinct vectors in one bucket form no core, work grows with the square of their number, rows of a block with its blocks.

Recall: of pairs at a cosine of exactly 0.95, 99.7 % meet in 64 dimensions and 97 % in 384; more where they are closer. None
below it is linked.

Cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing, not even their copies.
Vectors of different lengths link with nothing of each other's. Rows that repeat a vec_id count as vectors of their own. A null
vec_id is never the smallest, unless all of a component are null. Scale plays no part. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_batches, discard, materialize, mix, table

SIMILAR = 0.95
#: Tables, cross-polytope hashes of a table, buckets that a class visits in a table (its home is the first).
TABLES, HASHES, PROBES = 5, 3, 6
#: Coordinates of each hash that probes choose from.
NEXT = 4
#: Classes of a bucket that one task compares with one another.
BLOCK = 512
#: Rounds in which pivots are chosen, each in a table of its own.
CORE_ROUNDS = 2
SEED = 20240611


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray) -> np.ndarray:
    """Buckets (rows, TABLES, at most PROBES) of unit vectors of one length; [:, :, 0] are the homes."""
    n, dim = x.shape
    wide = 1 << max(0, dim - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, wide - dim)))
    few = min(NEXT, wide)
    choices = list(product(range(few), repeat=HASHES))
    out = np.zeros((n, TABLES, min(PROBES, len(choices))), np.int64)
    for t in range(TABLES):
        cost, code = np.zeros((n, len(choices))), np.zeros((n, len(choices)), np.uint64)
        for k in range(HASHES):
            signs = np.random.default_rng([SEED, dim, t, k]).choice([-1.0, 1.0], size=(3, wide))
            y = x
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            first = np.argsort(-size, axis=1, kind="stable")[:, :few]
            own = np.take_along_axis(size, first, 1)
            corner = (2 * first + (np.take_along_axis(y, first, 1) < 0)).astype(np.uint64)
            at = [c[k] for c in choices]
            cost += ((own[:, :1] - own) ** 2)[:, at]
            code = code * np.uint64(2 * wide) + corner[:, at]
        best = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        named = np.take_along_axis(code, best, 1) * np.uint64(TABLES) + np.uint64(t)
        out[:, t] = mix(named + np.uint64(dim * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
    return out


def _units(vectors: list[bytes], kind: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(positions, unit vectors) for each length among the vectors."""
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    where = [np.flatnonzero(size == n) for n in np.unique(size)]
    found = []
    for own in where:
        x = np.frombuffer(b"".join([vectors[i] for i in own]), kind).reshape(len(own), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
        found.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    return where, found


def _read(kind: str):
    """vec_id, digest and bytes of each vector; both null where it can't link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held = []
            for v in batch.column("embedding"):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and v.values is not None and len(v.values) and not v.values.null_count else None
                good = x is not None and np.isfinite(x).all() and x.any()
                held.append((x + 0.0).astype(kind).tobytes() if good else None)  # of -0.0 and 0.0, one
            digests = [None if h is None else hashlib.blake2b(h, digest_size=16).digest() for h in held]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(held, pa.binary())], ["vec_id", "digest", "vector"])

    return run


def _hash(kind: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cid = batch.column("cid").to_numpy()
            for own, x in zip(*_units(batch.column("vector").to_pylist(), kind), strict=True):
                c = codes(x)
                n, tables, probes = c.shape
                columns = [c.ravel(), np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n), np.tile(np.arange(probes) == 0, n * tables), np.repeat(cid[own], tables * probes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["code", "t", "home", "cid"])

    return run


def _near_pivot(kind: str):
    """cid, core: the pivot, of those within half the angle of SIMILAR of it."""
    least = np.cos(np.arccos(SIMILAR) / 2) + 1e-9

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own, pivot = batch.column("vector").to_pylist(), batch.column("pivot_vector").to_pylist()
            near = np.zeros(len(own), bool)
            for k, (a, b) in enumerate(zip(own, pivot, strict=True)):
                if len(a) == len(b):
                    x, y = np.frombuffer(a, kind).astype(np.float64), np.frombuffer(b, kind).astype(np.float64)
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    near[k] = x @ y >= least * np.sqrt((x @ x) * (y @ y))
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("cid").filter(keep), batch.column("pivot").filter(keep)], ["cid", "core"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which pairs of classes with buckets a, b meet first: of the first table, the least."""
    most = np.iinfo(np.int64).max
    found = np.full(len(a), most)
    for t in range(a.shape[1] - 1, -1, -1):
        here = np.full(len(a), most)
        for home, other in ((a[:, t, 0], b[:, t]), (b[:, t, 0], a[:, t])):
            here = np.where((home[:, None] == other).any(axis=1), np.minimum(here, home), here)
        found = np.where(here < most, here, found)
    return found


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position in each one's component, of links a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _pairs(crossed: bool, rows: dict, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a bucket's classes with a cosine of SIMILAR or more, one of them at home there. crossed: only between sides."""
    home, side, core = (rows[c] for c in ("home", "side", "core"))
    found = [(np.zeros(0, np.int64),) * 2]
    for own, x in zip(*_units(rows["vector"], kind), strict=True):
        g = x @ x.T >= SIMILAR
        g &= home[own][:, None] | home[own][None, :]
        g &= (core[own][:, None] != core[own][None, :]) | (core[own] < 0)[:, None]
        if crossed:
            g &= side[own][:, None] != side[own][None, :]
        i, j = np.nonzero(np.triu(g, 1))
        found.append((own[i], own[j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(held: pa.RecordBatch, a: np.ndarray, b: np.ndarray, kind: str) -> pa.RecordBatch:
    """cid, links, least cid of the local component, of the pairs (positions a, b in held) that meet first where they were found."""
    code, cid, weight = (held.column(c).to_numpy() for c in ("code", "cid", "n"))
    own, once = np.unique(cid[np.concatenate([a, b])], return_index=True)
    vectors = held.column("vector").take(pa.array(np.concatenate([a, b])[once])).to_pylist()
    here = np.zeros(len(a), bool)
    x, y = np.searchsorted(own, cid[a]), np.searchsorted(own, cid[b])
    for some, units in zip(*_units(vectors, kind), strict=True):
        buckets, place = codes(units), np.full(len(own), -1)
        place[some] = np.arange(len(some))
        for k in range(0, len(a), 50_000):
            i, j = place[x[k : k + 50_000]], place[y[k : k + 50_000]]
            both = i >= 0
            here[k : k + 50_000][both] = _first_meeting(buckets[i[both]], buckets[j[both]]) == code[a[k : k + 50_000]][both]
    a, b, x, y = a[here], b[here], x[here], y[here]
    links = np.zeros(len(own), np.int64)
    np.add.at(links, x, weight[b])
    np.add.at(links, y, weight[a])
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (own, links, own[_labels(len(own), x, y)])], ["cid", "links", "least"])


def _meet(kind: str):
    names = ("home", "side", "core")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in _ended(it):
            held = left if batch is None else pa.concat_batches([left, batch]) if left is not None and len(left) else batch
            left = None
            if held is None or not len(held):
                continue
            keys = [held.column(c).to_numpy(zero_copy_only=False) for c in ("code", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(held)]])
            if batch is not None:  # the last bucket may go on
                left = held.slice(int(starts[-1]))
                starts, ends = starts[:-1], ends[:-1]
            found = []
            for s, e in zip(starts, ends, strict=True):
                if e - s > 1:
                    own = held.slice(int(s), int(e - s))
                    rows = {c: own.column(c).to_numpy(zero_copy_only=False) for c in names} | {"vector": own.column("vector").to_pylist()}
                    a, b = _pairs(keys[1][s] != keys[2][s], rows, kind)
                    if len(a):
                        found.append((a + s, b + s))
            if found:
                yield _counted(held, *(np.concatenate(x) for x in zip(*found, strict=True)), kind)

    return run


def _ended(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from it
    yield None


def _cores(slim: DataFrame, classes: DataFrame, block: int, kind: str) -> DataFrame | None:
    """cid, core of the classes in cores, or None where there is no hot bucket."""
    cored = None
    vectors = classes.select("cid", "vector")
    for t in range(CORE_ROUNDS):
        homes = slim.where((F.col("t") == t) & F.col("home")).select("code", "cid")
        homes = homes if cored is None else homes.join(cored.select("cid"), "cid", "left_anti")
        hot = homes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot")).where(F.col("n") > block).select("code", "pivot")
        pivots = hot.join(vectors.select(F.col("cid").alias("pivot"), F.col("vector").alias("pivot_vector")), "pivot")
        near = homes.join(pivots, "code").join(vectors, "cid").select("cid", "vector", "pivot", "pivot_vector")
        found = near.mapInArrow(_near_pivot(kind), "cid long, core long")
        cored = materialize(found if cored is None else cored.unionByName(found))
        if cored.isEmpty():
            return None
    return cored


def _grouped(slim: DataFrame, block: int) -> DataFrame:
    """code, i, j, side, home, cid, core of the classes to compare: each group of (code, i, j) is of one or two blocks."""
    buckets = slim.groupBy("code").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("homes")).where("size > 1 and homes")
    met = slim.join(buckets.drop("homes"), "code")
    cold = met.where(F.col("size") <= block).select("code", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "home", "cid", "core")
    hot = met.where(F.col("size") > block).drop("size")
    parts = hot.groupBy("code", "core").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    before = F.sum("blocks").over(Window.partitionBy("code").orderBy("core")) - F.col("blocks")  # a row for each core
    parts = materialize(parts.withColumn("before", before.cast("int")))
    blocks = parts.select("code", "core", F.explode(F.sequence("before", F.col("before") + F.col("blocks") - 1)).alias("b"))
    other = blocks.select("code", F.col("core").alias("core_j"), F.col("b").alias("j"))
    pairs = blocks.withColumnRenamed("b", "i").join(other, "code").where("i <= j and not (core >= 0 and core = core_j)")
    sides = F.expr("if(i = j, array(struct(i as b, 0 as side)), array(struct(i as b, 0 as side), struct(j as b, 1 as side)))")
    ends = pairs.select("code", "i", "j", F.explode(sides).alias("s")).select("code", "i", "j", "s.b", "s.side")
    placed = hot.join(parts, ["code", "core"]).withColumn("b", (F.col("before") + F.pmod(F.xxhash64("cid"), F.col("blocks"))).cast("int"))
    return cold.unionByName(placed.join(ends, ["code", "b"]).select(*cold.columns))


def near_embeddings(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id long, embedding array<float> or array<double>)."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(given.mapInArrow(_read(kind), "vec_id long, digest binary, vector binary"))
    held = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = materialize(held.withColumn("cid", F.monotonically_increasing_id()))
    slim = materialize(classes.select("cid", "vector").mapInArrow(_hash(kind), "code long, t int, home boolean, cid long"))
    cored = _cores(slim, classes, block, kind)
    if cored is None:
        with_core = slim.select("code", "home", "cid", F.lit(-1).cast("long").alias("core"))
    else:
        with_core = materialize(slim.join(cored, "cid", "left").select("code", "home", "cid", F.coalesce("core", F.lit(-1)).alias("core")))
    groups = _grouped(with_core, block).join(classes.select("cid", "n", "vector"), "cid").repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")
    found = groups.select("code", "i", "j", "side", "home", "cid", "core", "n", "vector").mapInArrow(_meet(kind), "cid long, links long, least long")
    if cored is not None:
        members = cored.join(classes.select("cid", "n"), "cid")
        sums = members.groupBy("core").agg(F.sum("n").alias("all"))
        found = found.unionByName(members.join(sums, "core").select("cid", (F.col("all") - F.col("n")).alias("links"), F.col("core").alias("least")))
    found = materialize(found)
    linked = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    own = classes.select("cid", "digest", "least_id", "n").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("least_id").alias("component_id"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    judged = own.join(least, "component", "left").join(links, "cid", "left")
    judged = judged.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    judged = materialize(judged)
    discard(slim)
    out = rows.select("vec_id", "digest").join(judged, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


#: All pairs, by brute force.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= {SIMILAR} * a.norm * b.norm),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c ON c.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""
