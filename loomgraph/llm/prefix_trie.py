"""Prefix trie of conversations by Patricia construction: sort, keep branch, end and leaf points, expand the edges at the end.

A turn is the first 128 bits of SHA-256 over its role and text; a prefix of d turns is a chained 128-bit digest, so that a
conversation is a path: the digests of its prefixes, one behind the other. Paths in byte order are in trie order, and two
paths share as many turns as their digests agree from the start. Texts leave the tables once, as digests and word counts.

Equal paths are counted first: their ids are sorted over all tasks, joined by commas where they lie, and only the joined
pieces meet (SHA-256 has to run over one path's ids in order; its memory is a piece). The distinct paths are range-partitioned
by their first turns and sorted. A task walks its paths with a stack of points: where a path leaves the one before, the
points below are done, and a point is set where it leaves in the middle of an edge. A point adds up members, leaves and
tokens of its subtree; when it is done, the edge above it is expanded: the nodes inside it have the point's members and
leaves, and its tokens and those of the turns between (edge suffix sums).

Only prefixes that the first path of a task shares with the path before, or the last with the path after, go on beyond the
task. A task emits its part of their sums, and a grouping adds them up: a prefix's words count as new in one task only, the
one that meets it first, so all sums are additive. A child whose parent is a point gets the parent's id by a join.

Cases: turns without conv_id belong to no conversation. Null role or text is empty. Null turns come first; turns of one number
are ordered by their digest, and repeated rows are turns of their own. A conversation left without turns is a member (and end)
of the root. Very long texts are hashed whole. A task holds one conversation's path (24 bytes a turn) and two paths while
it walks. Empty table: no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merkle import CRC32
from .shared import discard, materialize, table

#: Bytes of a prefix's digest.
WIDE = 16
#: Turns of a path that partitions are chosen by.
LEADING = 32
#: Bytes of ids that one row holds on their way to the digest of a path's members.
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations that lend their first turns, and how many a conversation takes at most.
LENDER, LENT = 20, 4
NODES = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean, inner boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ..), digest, words of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDE)
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    return slim.select("conv_id", place.alias("pos"), "digest", "words")


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns where a conversation c begins with the first h = crc32(c) % LENT turns of conversation c - c % LENDER instead of its own.

    Each conversation has a row of pos -1 besides, without a turn.
    """
    own = materialize(own)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    convs = own.where("pos = 0").select("conv_id", F.expr(f"conv_id - conv_id % {LENDER}").alias("lender"), h.alias("h"))
    heads = own.where(f"conv_id % {LENDER} = 0 and pos < {LENT - 1}").withColumnRenamed("conv_id", "lender")
    taken = convs.join(heads, "lender").where("pos < h")  # at most LENDER borrowers of LENT - 1 turns each
    kept = own.where(F.col("pos") >= h)
    marks = convs.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return taken.select("conv_id", "pos", "digest", "words").unionByName(kept).unionByName(marks)


def _chain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, path, words (int64s) of each conversation, of rows sorted by conversation and place."""
    at, path, words, out = None, [], [], []

    def flush() -> pa.RecordBatch:
        got = list(zip(*out, strict=True)) if out else [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "words"])

    for batch in it:
        for conv, digest, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")), strict=True):
            if conv != at:
                if at is not None:
                    out.append((at, b"".join(path), np.array(words, np.int64).tobytes()))
                at, path, words = conv, [], []
            if digest is not None:
                path.append(hashlib.blake2b((path[-1] if path else b"") + digest, digest_size=WIDE).digest())
                words.append(n)
        yield flush()
    if at is not None:
        out.append((at, b"".join(path), np.array(words, np.int64).tobytes()))
    yield flush()


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, first, n, ids: joined ids of one key, of rows sorted by key and id."""
    key, ids, size = None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "n", "ids"])

    for batch in it:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or size >= PIECE):
                yield piece()
                ids, size = [], 0
            key = k
            ids.append(conv)
            size += 12
    if ids:
        yield piece()


def _ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv_id (the smallest), n, ends: of pieces sorted by key and first id."""
    key, out, held = None, [], None

    def done():
        out.append((key, held[0], held[1], held[2].hexdigest()))

    for batch in it:
        for k, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids")), strict=True):
            if held is not None and k == key:
                held[1] += n
                held[2].update(b"," + ids.encode())
                continue
            if held is not None:
                done()
            key, held = k, [first, n, hashlib.sha256(ids.encode())]
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "conv_id", "n", "ends"])
            out = []
    if held is not None:
        done()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "conv_id", "n", "ends"])


def distinct_paths(rows: DataFrame) -> DataFrame:
    """key, path, words, conv_id (the smallest), n and ends (digest of all ids) of each distinct path. rows: of turns() or rebuilt()."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "words")
    paths = materialize(ordered.mapInArrow(_chain, "conv_id long, path binary, words binary").withColumn("key", F.substring("path", -WIDE, WIDE)))
    ids = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ids.mapInArrow(_pieces, "key binary, first long, n long, ids string").repartition("key").sortWithinPartitions("key", "first")
    counted = pieces.mapInArrow(_ends, "key binary, conv_id long, n long, ends string")
    return counted.join(paths, ["key", "conv_id"]).select("path", "words", "conv_id", "n", "ends")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share: their digests agree up to there and nowhere behind."""
    n = min(len(a), len(b)) // WIDE
    if not n:
        return 0
    x, y = (np.frombuffer(p, f"V{WIDE}", n) for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class _Point:
    """A point of the compressed tree on the walked path: sums of what lies at and below it, as far as it was met."""

    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "ends", "deeper")

    def __init__(self, depth: int):
        self.depth, self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.deeper = depth, None, 0, 0, 0, 0, None, False

    def take(self, conv: int, n: int, leaves: int, saved: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n += n
        self.leaves += leaves
        self.saved += saved


class Walk:
    """The sorted paths of one task. before, after: turns shared with the path before its first and behind its last (-1: none)."""

    def __init__(self, before: int, after: int):
        self.before, self.after, self.first, self.out = before, after, True, []
        self.path, self.words, self.old = b"", np.zeros(0, np.int64), 0
        self.stack = [_Point(0)]

    def add(self, path: bytes, words: np.ndarray, conv: int, n: int, ends: str) -> None:
        shared = 0 if self.first else _common(self.path, path)
        self._leave(shared, False)
        if self.first:  # prefixes that an earlier task has met are points of their own
            self.old = self.before
            self.stack += [_Point(d) for d in range(1, self.old + 1)]
            for p in self.stack[:-1]:
                p.deeper = True
            self.first = False
        self.path, self.words = path, words
        depth = len(path) // WIDE
        if self.stack[-1].depth < depth:
            self.stack[-1].deeper = True
            self.stack.append(_Point(depth))
        self.stack[-1].take(conv, n, 0, 0)
        self.stack[-1].ends = ends

    def finish(self) -> None:
        self._leave(0, True)
        self._emit(self.stack.pop(), -1, True)

    def _leave(self, shared: int, last: bool) -> None:
        """Ends the points deeper than `shared`."""
        while self.stack[-1].depth > shared:
            point = self.stack.pop()
            if self.stack[-1].depth < shared:
                self.stack.append(_Point(shared))
                self.stack[-1].deeper = True
            above = self.stack[-1]
            saved = self._emit(point, above.depth, last)
            above.take(point.conv, point.n, point.leaves, saved)
            above.children += above.depth + 1 > self.old
        self.old = min(self.old, shared)

    def _emit(self, point: _Point, above: int, last: bool) -> int:
        """The nodes of the edge from depth `above` (exclusive) down to the point; returns the tokens of its upmost one's subtree."""
        beyond = max(self.old, self.after if last else 0)  # prefixes up to this depth, the root at least, go on in other tasks
        if not point.deeper and not (last and self.after >= point.depth):
            point.leaves = 1
        saved, key = point.saved, lambda d: self.path[WIDE * (d - 1) : WIDE * d] if d > 0 else b""
        for d in range(point.depth, above, -1):
            saved += (point.n - (d > self.old)) * int(self.words[d - 1]) if d else 0
            children, ends = (point.children, point.ends) if d == point.depth else (1, None)
            self.out.append((key(d), key(d - 1) if d else None, d, point.conv, point.n, children, point.leaves, saved, ends, d <= beyond, d - 1 > max(above, beyond)))
        return saved

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.bool_()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in NODES.split(", ")])


def _walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, walk = None, None
    for batch in it:
        columns = (batch.column(c).to_pylist() for c in ("part", "before", "after", "path", "words", "conv_id", "n", "ends"))
        for p, before, after, path, words, conv, n, ends in zip(*columns, strict=True):
            if p != part:
                if walk is not None:
                    walk.finish()
                    yield walk.batch()
                part, walk = p, Walk(before, after)
            walk.add(path, np.frombuffer(words, np.int64), conv, n, ends)
            if len(walk.out) > 5_000:
                yield walk.batch()
        if walk is not None:
            yield walk.batch()
    if walk is not None:
        walk.finish()
        yield walk.batch()


def _shared_with(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        part, *ends = (batch.column(c).to_pylist() for c in ("part", "last_before", "first", "last", "first_after"))
        before, after = ([none if a is None or b is None else _common(a, b) for a, b in zip(x, y, strict=True)] for x, y, none in ((*ends[:2], 0), (*ends[2:], -1)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(before, pa.int64()), pa.array(after, pa.int64())], ["p", "before", "after"])


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. rows: of turns() or rebuilt()."""
    lead = F.substring("path", 1, LEADING * WIDE)
    found = materialize(distinct_paths(rows))
    paths = materialize(found.repartitionByRange(lead).sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id()))
    discard(found)
    part = F.shiftright("at", 33).alias("part")
    tasks = paths.groupBy(part).agg(F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last"))  # a row a partition
    order = Window.orderBy("part")
    edges = tasks.select("part", F.lag("last").over(order).alias("last_before"), "first", "last", F.lead("first").over(order).alias("first_after"))
    edges = materialize(edges.mapInArrow(_shared_with, "p long, before long, after long"))
    near = paths.withColumn("part", part).join(edges, F.col("part") == F.col("p")).drop("p").repartition("part").sortWithinPartitions("part", "at")
    nodes = materialize(near.select("part", "before", "after", "path", "words", "conv_id", "n", "ends").mapInArrow(_walk, NODES))
    discard(paths, edges)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = nodes.where("open").groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"))
    whole = nodes.where("not open").select(*open_.columns, "inner").unionByName(open_.withColumn("inner", F.lit(False)))
    # parents of what isn't inside an edge: points, and any open node
    points = whole.where("not inner or ends is not null or n_children != 1").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where("not open and inner").select(*open_.columns, F.col("conv_id").alias("parent_conv_id"))
    top = whole.where("not inner").drop("inner").join(points, "parent", "left").select(*inner.columns)
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    return inner.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(turns(conversations))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


_WORDS = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"
_TURN = "sha256(strlen(role) || ':' || role || text)"
ORACLE = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(digest, 32)) - 1 AS pos
  FROM (SELECT *, {_TURN} AS digest, {_WORDS.format("text")} AS words FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.digest, t.words FROM c JOIN t ON t.conv_id = c.lender WHERE t.pos < h
  UNION ALL SELECT c.conv_id, t.pos, t.digest, t.words FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos >= h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix, words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, prefix),
ends AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(prefix, depth) AS prefix FROM p GROUP BY conv_id) GROUP BY prefix),
children AS (SELECT left(prefix, 64 * (depth - 1)::INTEGER) AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (SELECT DISTINCT x.prefix AS top, y.prefix FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
sums AS (SELECT b.top, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM below b JOIN node n ON n.prefix = b.prefix LEFT JOIN children k ON k.prefix = b.prefix GROUP BY b.top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM node n JOIN sums s ON s.top = n.prefix LEFT JOIN children k ON k.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
LEFT JOIN node q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.prefix = left(n.prefix, 64 * (n.depth - 1)::INTEGER)
"""
