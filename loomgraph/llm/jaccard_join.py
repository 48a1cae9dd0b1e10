"""N-gram Jaccard join: every pair of documents with 100 * |A and B| >= 75 * |A or B| over five-word shingles, exactly.

Documents with equal shingle sets are one class, named by a 64-bit digest. A second digest tells different sets that share
one (about N * N / 2**65 names of N sets): these are named by the second. Classes are joined.

1. Prefixes: a set's first floor(n / 4) + 1 shingles in one order for all share one with each partner's. The order puts
   the commonest shingles last (a bounded list from counts over all documents), then goes by hash, so that a line that
   many documents share seldom makes candidates. Any order is right; this one keeps groups small. Of a linked pair the
   smaller set shares one of its first n - ceil(6n / 7) + 1 shingles (its `head`), so tokens in no head are dropped.
2. Links to one member: each class of a token is paired with the one whose prefix others share most (the token's hub).
   Pairs that come often enough are verified on the sets. This links most copies without pairing them all.
3. All the rest: tokens that still hold several components meet at their hub, each class once, as a point: its hashed
   shingles' counts in groups, as many groups as the set has members (a power of two). Over a hub's points an R-tree
   (nodes: the largest counts of each coordinate, and the range of sizes) is searched by every member for members of other
   components, as the overlap of two sets is at most the sum of the smaller coordinates. Surviving pairs are verified.
   So no link between different components is missed, and copies that are already linked aren't paired. Hubs with more
   than BLOCK members are searched in blocks; blocks of the hub's largest component aren't paired with each other.

Components follow by star contraction. Nothing is capped, and no group's pairs are all emitted.

Cases: null and empty texts, or texts without words, have an empty set, no links and themselves as component. Documents
without an id link like others; component_id is null only where no document of a component has an id. With fewer than five
words the whole sequence is one shingle. Very long texts are taken whole, a step of their own. Rows that repeat are copies.
Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_batches, batches, discard, materialize, row_key, signed, table
from .shingles import digests, shingle_sets

#: Groups of a point: as many as the set has shingles, rounded up to a power of two within these.
FEWEST, MOST = 64, 8192
#: Shingles that count as common: the LISTED commonest of those found LOCALLY times in COUNTED shingles of a task.
LISTED, LOCALLY, COUNTED = 65_536, 3, 1_000_000
SALTS = 64
#: Members of a hub that one task searches against as many others.
BLOCK = 2_000
LEAF = 16
#: Bits of a class's first digest; fewer only in tests.
DIGEST_BITS = 64
#: Bytes of a hash that sets of up to SHORT shingles keep for verification (longer ones keep all 8): two such sets' hashes
#: clash with odds of |A| * |B| / 2**40, under 1 / 4000.
TOKEN_BYTES, SHORT = 5, 16_384


def _named(h: np.ndarray, bounds: np.ndarray, clashes: np.ndarray, bits: int) -> np.ndarray:
    """The class of each set: its digest, or the second one where different sets share the first."""
    cls = signed(digests(h, bounds) >> np.uint64(64 - bits))
    return np.where(np.isin(cls, clashes), signed(digests(h, bounds, 1)), cls) if len(clashes) else cls


def _describe(it, bits: int):
    """A row for each document (kind 0), and the shingles that are common in the task (kind 1: cls is the shingle, n its count)."""
    held, size = [], 0
    names = ["kind", "doc_id", "k2", "cls", "check", "n"]

    def common():
        v, c = np.unique(np.concatenate(held), return_counts=True)
        v, c = v[c >= LOCALLY], c[c >= LOCALLY]
        nothing = pa.nulls(len(v), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), np.int32)), nothing, nothing, pa.array(signed(v)), nothing, pa.array(c.astype(np.int64))], names)

    for batch, i, j, raw, off in batches(it, ["doc_id", "k2", "text"]):
        h, bounds = shingle_sets(raw, off)
        held.append(h)
        size += len(h)
        cls, check = pa.array(_named(h, bounds, (), bits)), pa.array(signed(digests(h, bounds, 1)))
        own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), *own, cls, check, pa.array(np.diff(bounds))], names)
        if size > COUNTED:
            yield common()
            held, size = [], 0
    if size:
        yield common()


def _prefixes(it, common: np.ndarray, clashes: np.ndarray, bits: int):
    """(token, common, head, cls, n) of the prefix of each set; a set that comes again soon in a task is left out."""
    seen: set[int] = set()
    for _, i, j, raw, off in batches(it, ["k2", "text"]):
        h, bounds = shingle_sets(raw, off)
        if len(seen) > 100_000:
            seen.clear()
        new, cls = np.ones(j - i, bool), _named(h, bounds, clashes, bits)
        for k, d in enumerate(cls.tolist()):
            new[k] = d not in seen
            seen.add(d)
        n = np.diff(bounds)
        of = np.repeat(np.arange(j - i), n)
        late = np.zeros(len(h), bool)
        if len(common):
            late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        order = np.lexsort((late, of))  # stable: by hash within
        place = np.arange(len(h)) - bounds[of]
        take = (place < n[of] // 4 + 1) & new[of]
        h, late, of, place = h[order][take], late[order][take], of[take], place[take]
        head = place < n[of] - _needed(n[of], n[of]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(late), pa.array(head), pa.array(cls[of]), pa.array(n[of].astype(np.int32))], ["token", "common", "head", "cls", "n"])


def _groups(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), FEWEST, MOST)


def point(h: np.ndarray, groups: int) -> tuple[np.ndarray, int]:
    """Counts (to 255) of the hashes by their leading bits, and what goes beyond 255."""
    counts = np.bincount((h >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    held = np.minimum(counts, 255).astype(np.uint8)
    return held, int((counts - held).sum())


def _sets(it, clashes: np.ndarray, bits: int):
    """The sets of the wanted classes, sorted and packed, and their points."""
    seen: set[int] = set()
    for batch, i, j, raw, off in batches(it, ["wanted", "text"]):
        h, bounds = shingle_sets(raw, off)
        cls, n = _named(h, bounds, clashes, bits), np.diff(bounds)
        wanted = batch.column(0).slice(i, j - i).to_numpy()
        held = [k for k in np.flatnonzero(cls == wanted) if not (cls[k] in seen or seen.add(cls[k]))]
        points = [point(h[bounds[k] : bounds[k + 1]], int(g)) for k, g in zip(held, _groups(n[held]), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cls[held]), pa.array(n[held].astype(np.int32)), pa.array([p.tobytes() for p, _ in points], pa.binary()), pa.array([e for _, e in points], pa.int64()),
                pa.array([packed(h[bounds[k] : bounds[k + 1]]) for k in held], pa.binary()),
            ],
            ["cls", "n", "point", "excess", "hashes"],
        )


def packed(h: np.ndarray) -> bytes:
    """The leading bytes of sorted hashes, behind a byte that says how many of each."""
    width = TOKEN_BYTES if len(h) <= SHORT else 8
    return bytes([width]) + (h >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, int]:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").reshape(-1), width


def overlap(x: np.ndarray, of_x: int, y: np.ndarray, of_y: int) -> int:
    """How many hashes two unpacked sets share, by as many bytes as both have."""
    width = min(of_x, of_y)
    both = np.union1d(x >> np.uint64(8 * (of_x - width)), y >> np.uint64(8 * (of_y - width)))
    return len(x) + len(y) - len(both)


def _needed(na, nb):
    """Least overlap of a link: 100 * i >= 75 * (na + nb - i)."""
    return -((-3 * (na + nb)) // 7)


def _verified(it):
    for batch in it:
        a, b = batch.column(0), batch.column(1)
        ok = np.zeros(batch.num_rows, bool)
        last, y = None, None
        for k, (sa, sb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if sb != last:
                last, y = sb, unpacked(sb)
            x = unpacked(sa)
            both = overlap(*x, *y)
            ok[k] = 100 * both >= 75 * (len(x[0]) + len(y[0]) - both)
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])


class RTree:
    """Packed over count vectors in order of set size: each node has its members' largest counts, excess and range of sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray, excess: np.ndarray):
        order = np.argsort(n, kind="stable")
        self.order = order
        self.levels = [(points[order], n[order], n[order], excess[order])]
        while len(self.levels[-1][1]) > LEAF:
            p, low, high, e = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at)))

    def search(self, point: np.ndarray, n: int, excess: int) -> np.ndarray:
        """Members whose overlap with the point may reach that of a link."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, low, high, e = (x[at] for x in self.levels[depth])
            fits = (4 * high >= 3 * n) & (3 * low <= 4 * n)
            at, p, low, e = at[fits], p[fits], low[fits], e[fits]
            at = at[np.minimum(p, point).sum(axis=1, dtype=np.int64) + np.minimum(e, excess) >= _needed(n, np.maximum(low, (3 * n + 3) // 4))]
            if depth and len(at):
                at = (at[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


class Members:
    """Rows of one or more hubs. Sets that can link differ in size by a third at most, so their points' groups are as many or twice as many."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        self.side, self.cls, self.comp, self.n, self.excess = (get(c).to_numpy() for c in ("side", "cls", "component", "n", "excess"))
        self.n = self.n.astype(np.int64)
        self.head = get("head").to_numpy(zero_copy_only=False)
        self.raw = get("point").to_pylist()
        self.size = np.array([len(p) for p in self.raw], np.int64)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.n
        ok = (self.comp[a] != self.comp[b]) & ((self.side[a] == 2) | (self.side[a] != self.side[b])) & (4 * n[a] >= 3 * n[b]) & (4 * n[b] >= 3 * n[a])
        return ok & self.head[np.where(n[a] <= n[b], a, b)]

    def points(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """The rows' points (of `groups` or twice as many groups), with neighbouring groups put together in the latter."""
        out = np.empty((len(rows), groups), np.uint16)
        for twice in (False, True):
            own = np.flatnonzero(self.size[rows] == groups << twice)
            if len(own):
                p = np.frombuffer(b"".join([self.raw[k] for k in rows[own]]), np.uint8).reshape(len(own), -1)
                out[own] = p.reshape(len(own), groups, 2).sum(axis=2, dtype=np.uint16) if twice else p
        return out

    def leaves(self, start: np.ndarray, size: np.ndarray):
        """Pairs in runs of at most LEAF rows: one node each, whose members are held against each other, all runs at once."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, LEAF + 1):
            own = start[size == k]
            for i in range(k if len(own) else 0):
                for j in range(i):
                    ok = self.may_link(own + i, own + j)
                    a.append(own[ok] + i)
                    b.append(own[ok] + j)
        a, b = np.concatenate(a), np.concatenate(b)
        groups = np.minimum(self.size[a], self.size[b])
        for g in np.unique(groups):
            x, y = a[groups == g], b[groups == g]
            rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            p = self.points(rows, int(g))
            for k in range(0, len(x), 4096):
                u, v = x[k : k + 4096], y[k : k + 4096]
                bound = np.minimum(p[at[k : k + len(u)]], p[at[len(x) + k : len(x) + k + len(u)]]).sum(axis=1, dtype=np.int64)
                ok = bound + np.minimum(self.excess[u], self.excess[v]) >= _needed(self.n[u], self.n[v])
                yield u[ok], v[ok]

    def tree(self, start: int, end: int):
        """Pairs in a longer run: an R-tree for each number of groups, searched by rows with as many and twice as many."""
        rows = np.arange(start, end)
        for g in np.unique(self.size[rows]):
            held = rows[self.size[rows] == g]
            tree = RTree(self.points(held, int(g)), self.n[held], self.excess[held])
            for b in range(0, len(rows), 512):
                asking = rows[b : b + 512]
                asking = asking[(self.size[asking] == g) | (self.size[asking] == 2 * g)]
                for k, p in zip(asking, self.points(asking, int(g)), strict=True):
                    got = held[tree.search(p, int(self.n[k]), int(self.excess[k]))]
                    got = got[(self.cls[got] > self.cls[k]) | (self.size[k] != g)]
                    got = got[self.may_link(np.full(len(got), k), got)]
                    yield np.full(len(got), k), got


def _search(it):
    """Pairs of different components that the points don't rule out, of each run of rows with one (hub, i, j)."""

    def pairs(batch: pa.RecordBatch, starts: np.ndarray):
        """starts: of the runs, and the end of the last."""
        rows, size = Members(batch), np.diff(starts)
        found = [*rows.leaves(starts[:-1], size), (np.zeros(0, np.int64),) * 2]
        for k in np.flatnonzero(size > LEAF):
            found += rows.tree(starts[k], starts[k + 1])
        a, b = (rows.cls[np.concatenate([f[k] for f in found])] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held = None
    for batch in it:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
        if len(starts) > 1:
            yield pairs(batch.slice(0, starts[-1]), starts)
        held = batch.slice(starts[-1])
    if held is not None:
        yield pairs(held, np.array([0, held.num_rows]))


def _often(found: DataFrame, part: int) -> DataFrame:
    """(a, b) of sizes that can link, found with a part of the tokens that linked sets share.

    Of a set's |A| // 4 + 1 prefix shingles at most |A| - o are not in the other, o being the overlap of a link; and those
    up to the earlier end of both prefixes are in both prefixes. So linked sets share the lesser of both bounds.
    """
    pairs = found.where("4 * na >= 3 * nb and 4 * nb >= 3 * na").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    o = F.ceil(3 * (F.col("na") + F.col("nb")) / 7.0)
    shared = F.least(*[F.floor(F.col(n) / 4.0) + 1 - F.col(n) + o for n in ("na", "nb")])
    return pairs.where(F.col("c") * part >= shared).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of `pairs`. Rows of one b come together, so that its set is unpacked once."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = one.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described, classes): doc_id, k2 (of row_key), cls, n for each document row; cls, rep for each class.

    rep is the component's first document: absent (whether it has no id), doc_id, k2.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key()[1], F.coalesce("text", F.lit("")).alias("text"))
    bits = DIGEST_BITS
    described = materialize(text.mapInArrow(lambda it: _describe(it, bits), "kind int, doc_id long, k2 long, cls long, check long, n long"))
    common = described.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(LISTED).collect()
    common = np.sort(np.array([r["cls"] for r in common], np.int64).view(np.uint64))
    rows = described.where("kind = 0").select("doc_id", "k2", "cls", "check", "n")
    first = F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "k2")).alias("rep")
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(first, (F.min("check") != F.max("check")).alias("clash")))
    clashes = np.array([r["cls"] for r in classes.where("clash").select("cls").collect()], np.int64)  # a handful: see above
    if len(clashes):
        discard(classes)
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(clashes.tolist()), F.col("check")).otherwise(F.col("cls")))
        classes = materialize(rows.where("n > 0").groupBy("cls").agg(first))

    # 1: tokens that two classes hold, in a head of one; a common token's rows are split by salts, and stay whatever their number
    held = spark.sparkContext.broadcast(common)  # at most LISTED values
    prefixes = text.where(F.length("text") > 0).select("k2", "text").mapInArrow(lambda it: _prefixes(it, held.value, clashes, bits), "token long, common boolean, head boolean, cls long, n int")
    salted = prefixes.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int") + 1).otherwise(0)).drop("common")
    group = Window.partitionBy("token", "salt")
    grouped = salted.withColumn("low", F.min("cls").over(group)).withColumn("high", F.max("cls").over(group)).withColumn("any", F.max("head").over(group))
    grouped = grouped.where("low < high and any or salt > 0").groupBy("token", "salt", "cls").agg(F.max("head").alias("head"), F.max("n").alias("n")).drop("salt")
    # the share of a class's prefix that others have: highest for a text that many others are edited from
    alike = F.count(F.lit(1)).over(Window.partitionBy("cls")) / F.floor(F.col("n") / 4.0 + 1)
    members = materialize(grouped.withColumn("alike", alike.cast("float")))

    # the members' sets, once
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select(F.col("rep.k2").alias("k2"), F.col("cls").alias("wanted"))
    sets = materialize(text.join(wanted, "k2").select("wanted", "text").mapInArrow(lambda it: _sets(it, clashes, bits), "cls long, n int, point binary, excess long, hashes binary"))

    # 2: each member with its token's hub
    first = F.min(F.struct((-F.col("alike")).alias("rank"), F.col("cls").alias("b"), F.col("n").alias("nb"))).alias("first")
    hubs = materialize(members.groupBy("token").agg(first, F.count(F.lit(1)).alias("m"), F.max("head").alias("any")).where("m > 1 and any").select("token", "first.b", "first.nb"))
    stars = members.join(hubs, "token").where("cls <> b").select(F.col("cls").alias("a"), "b", F.col("n").alias("na"), "nb")
    links = materialize(_verify(_often(stars, 4), sets))
    linked = components(links)

    # 3: what may link different components
    placed = materialize(members.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "head", F.coalesce("component", "cls").alias("component")))
    discard(members)
    still = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    at_hub = placed.join(still.join(hubs, "token").select("token", F.col("b").alias("hub")), "token")
    at_hub = materialize(at_hub.groupBy("hub", "cls").agg(F.max("head").alias("head"), F.min("component").alias("component")))
    parts = at_hub.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("hub").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("most")).where("m > 1")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    parts = parts.where("most.m < m").select("hub", F.col("most.component").alias("most"), blocks(F.col("most.m")).alias("k"), blocks(F.col("m") - F.col("most.m")).alias("l"))
    # blocks 0..k-1 are those of the largest component, which need no pairs among themselves; k..k+l-1 are the others'
    spread = at_hub.join(parts, "hub").withColumn("block", F.when(F.col("component") == F.col("most"), F.expr("pmod(xxhash64(cls), k)")).otherwise(F.expr("k + pmod(xxhash64(cls), l)")).cast("int"))
    # where there is one block of either kind, they are searched together
    spread = spread.withColumn("block", F.expr("if(k = 1 and l = 1, 0, block)")).withColumn("other", F.explode(F.expr("if(k = 1 and l = 1, array(0), sequence(if(block < k, k, 0), k + l - 1))")))
    spread = spread.select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "cls", "component", "head",
    )
    full = spread.join(sets.select("cls", "n", "point", "excess"), "cls").select("hub", "i", "j", "side", "cls", "component", "head", "n", "point", "excess")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(full.repartition(n_parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(_search, "a long, b long").distinct())
    more = materialize(_verify(found, sets))
    discard(sets, placed, at_hub, hubs, found)
    last = linked if more.isEmpty() else components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    labelled = classes.join(last.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    out = materialize(labelled.join(labelled.groupBy("component").agg(F.min("rep").alias("least")), "component").select("cls", F.col("least").alias("rep")))
    discard(classes, links, more, linked)
    return rows, out


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, cls, kept for each document row. kept: the component's first by id, then by k2."""
    rows, classes = jaccard_components(docs)
    least, kept = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("rep.doc_id")), (F.col("n") == 0) | ((F.col("k2") == F.col("rep.k2")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id")))
    return rows.join(classes, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), "cls", "k2", kept.alias("kept"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id, with its columns as they came; all without words stay.

    Rows alike in id and text share a verdict. Where no document of a component has an id, one text of it stays.
    """
    gone = jaccard_join(docs).where(~F.col("kept")).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key()
    return docs.join(gone, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("cls", "k2", "kept")


#: Every shared shingle of every pair, and all reachable documents: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * common >= 75 * (nx + ny - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""
