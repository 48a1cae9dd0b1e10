"""Suffix-array dedup: each byte covered by a SPAN-byte string that also starts anywhere else is removed.

Strings of SPAN bytes ("windows") are dealt to shards so that equal ones meet: a window's anchor is the GRAM-byte gram in
it with the least hash (leftmost of equal ones), and windows of a document with one anchor are a run; the run's bytes are
its context. Equal windows have equal anchors. So:

1. Anchors that occur once in all texts are done: no window of theirs occurs twice (runs in which one anchor's gram comes
   again are marked and stay in).
2. Contexts that occur twice are removable as they are; their copies meet map-side, however many.
3. Where different contexts have one anchor, the distinct ones go, once each, to the anchor's shard. Shards are read in
   chunks of whole anchors: a chunk's suffix array is induced (suffix_array), permuted common prefixes of SPAN or more
   with a neighbour mark the windows that occur again. Stretches of a short period are cut first, by whole periods: their
   inner windows all occur again, and two of each phase stay behind to meet those of other contexts.
4. An anchor with more distinct contexts than HOT of ordinary length have bytes (a passage that very many documents share, at its edges) is split into
   shards first, by windows' place relative to the anchor in blocks and by the bytes common to a block's windows (a run with
   the anchor's gram several times falls into stretches first, so that each window has its place as elsewhere): blocks alone
   with these bytes are done, blocks in which all agree are settled by their count, up to HOT that don't agree are a shard
   with a suffix array as in 3, and more are split again into smaller blocks (BLOCKS), at last windows, which agree. The
   counts begin map-side; no task gets such an anchor whole.

Removed stretches come back as intervals by document. The texts are shuffled twice (to fetch contexts, to cut); what
decides is slim rows. Strings are judged on the input, matches never cross documents, and overlaps count. Contexts and
blocks are held equal by 61-bit hashes modulo a prime within one anchor's 64 bits; suffix arrays compare bytes.

Cases: null text is empty. Texts under SPAN bytes keep all. Rows that repeat contain each other's strings, so both lose
what is SPAN bytes long or more. A text made of one repeated string is one run. Extra columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, batches, column_bytes, discard, materialize, mix, prefix_hash, row_key, signed, span_hash, table
from .suffix_array import common_prefixes, suffix_array

SPAN, GRAM = 200, 48
HOT, BLOCKS = 1000, (64, 16, 4, 1)
#: A text's nearest grams of one anchor whose distances are tried as periods.
NEAREST = 4
#: Bytes of contexts that share a suffix array (a shard's are never parted).
CHUNK = 300_000
#: Bytes of blocks' stretches in an Arrow batch; blocks of one place repeat each of a context's bytes SPAN times.
BLOCK_BYTES = 1_000_000
RUN = "anchor long, ctx long, k1 long, k2 long, start long, windows int, lead int, again boolean"


_ODD = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64)] * 2


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each gram of `size` bytes that only chooses anchors: grams that share it are told apart later."""
    if len(_POWERS[0]) <= len(raw):
        _POWERS[:] = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * len(raw), b % 2**64, np.uint64)])) for b in (_ODD, pow(_ODD, -1, 2**64)))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(raw)], out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * _POWERS[1][: len(prefix) - size])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(raw: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, start, windows, lead, again, anchor, ctx) of each run: lead is the anchor's place behind start."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, none.astype(bool), none.astype(np.uint64), none.astype(np.uint64)
    h = grams(raw, gram)
    at = np.arange(len(h))
    pos = (_least((h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64), span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(off, np.arange(len(pos)), side="right") - 1
    window = np.flatnonzero(np.arange(len(pos)) + span <= off[row + 1])
    if not len(window):
        return none, none, none, none, none.astype(bool), none.astype(np.uint64), none.astype(np.uint64)
    pos, row = pos[window], row[window]
    new = np.ones(len(window), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    anchor = h[pos[first]]
    # neighbouring runs whose anchors are alike are one: texts of a short period
    apart = np.ones(len(first), bool)
    apart[1:] = (anchor[1:] != anchor[:-1]) | (row[first[1:]] != row[first[:-1]])
    joined = np.diff(np.append(np.flatnonzero(apart), len(first))) > 1
    first, anchor = first[apart], anchor[apart]
    last = np.append(first[1:], len(window)) - 1
    start, end = window[first], window[last]
    prefix = prefix_hash(raw)
    return row[first], start - off[row[first]], end - start + 1, pos[first] - start, joined, anchor, span_hash(prefix, start, end + span)


def _runs(it):
    for batch, i, j, raw, off in batches(it, ["k1", "k2", "text"]):
        row, start, windows, lead, again, anchor, ctx = runs(raw, off)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(anchor)), pa.array(signed(ctx)), batch.column(0).slice(i, j - i).take(rows), batch.column(1).slice(i, j - i).take(rows),
             pa.array(start), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(again)],
            ["anchor", "ctx", "k1", "k2", "start", "windows", "lead", "again"],
        )


def squeezed(raw: np.ndarray, anchor: int, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The places of raw's bytes that stay when stretches of a short period lose whole periods.

    A stretch of period p keeps span + 2p - 1 bytes or up to p more. So each window that was in raw is still there, those
    that came again still do, and a window that begins at a place that goes lies in such a stretch: it came again.
    """
    at = np.arange(len(raw))
    own = np.flatnonzero(signed(grams(raw, gram)) == anchor)
    periods = np.unique(np.concatenate([own[k:] - own[:-k] for k in range(1, NEAREST + 1)]))
    for p in periods[periods <= span].tolist():
        text = raw[at]
        first, end = _stretches(text[p:] == text[:-p])
        gone = (end + p - first - (span + 2 * p - 1)) // p * p
        cut = np.flatnonzero(gone >= span)
        if len(cut):
            stays = np.ones(len(text), bool)
            for a, n in zip(first[cut] + 2 * p, gone[cut], strict=True):
                stays[a : a + n] = False
            at = at[stays]
    return at


def _bodies(it):
    """The bytes of the wanted contexts of each text, and where (in what is left) how many were cut as periodic."""
    names = ["anchor", "ctx", "n", "hot", "again", "lead", "windows", "body", "cuts"]
    cut_type = pa.list_(pa.struct([("at", pa.int32()), ("gone", pa.int32())]))
    for batch in it:
        raw, off = column_bytes(batch.column(1))
        wanted = batch.column(0)
        flat, ends = wanted.flatten(), wanted.offsets.to_numpy()
        ends = ends - ends[0]
        got = {k: flat.field(k) for k in ("anchor", "ctx", "n", "hot", "again", "lead", "windows", "start")}
        text = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        start = off[text] + got["start"].to_numpy()
        stop = start + got["windows"].to_numpy() + SPAN - 1
        for a in range(0, len(text), 20_000):
            b = min(len(text), a + 20_000)
            bodies = [raw[x:y].tobytes() for x, y in zip(start[a:b], stop[a:b], strict=True)]
            windows, cuts = got["windows"].slice(a, b - a).to_numpy().copy(), [None] * (b - a)
            for k in np.flatnonzero((windows > 2 * SPAN) & got["again"].slice(a, b - a).to_numpy(zero_copy_only=False)):
                whole = raw[start[a + k] : stop[a + k]]
                at = squeezed(whole, got["anchor"][a + int(k)].as_py())
                if len(at) < len(whole):
                    gap = np.flatnonzero(np.diff(at) > 1) + 1
                    bodies[k], cuts[k] = whole[at].tobytes(), [{"at": int(i), "gone": int(at[i] - at[i - 1] - 1)} for i in gap]
                    windows[k] = len(at) - SPAN + 1
            made = [pa.array(windows, pa.int32()), pa.array(bodies, pa.binary()), pa.array(cuts, cut_type)]
            yield pa.RecordBatch.from_arrays([*(got[k].slice(a, b - a) for k in names[:-3]), *made], names)


def repeated(bodies: list[bytes]) -> list[np.ndarray]:
    """For each body, which of its windows occur again in the bodies, by their suffix array."""
    data = np.zeros(sum(len(b) + 1 for b in bodies), np.int32)
    at = 0
    for b in bodies:
        data[at : at + len(b)] = np.frombuffer(b, np.uint8).astype(np.int32) + 1  # 0 ends a body
        at += len(b) + 1
    order = suffix_array(data)
    common = common_prefixes(data, order, SPAN)
    again = common >= SPAN
    again[order[:-1][again[order[1:]]]] = True  # a long prefix in common with the next one
    out, at = [], 0
    for b in bodies:
        out.append(again[at : at + len(b) - SPAN + 1])
        at += len(b) + 1
    return out


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shard(it):
    """Intervals of windows of each context that occur again; rows come sorted by shard, one row a context's stretch counts."""
    held: list[tuple] = []

    def judged(items):
        own = list({row[1:4]: row for row in items}.values())
        out = []
        for (_, anchor, ctx, first, _), mask in zip(own, repeated([row[4] for row in own]), strict=True):
            for a, b in zip(*_stretches(mask), strict=True):
                out.append((anchor, ctx, first + a, first + b))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "ctx", "first", "last"])

    size = 0
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > CHUNK and held[-1][0] != row[0]:
                yield judged(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield judged(held)
    pa.default_memory_pool().release_unused()


BODY = "anchor long, ctx long, n long, hot boolean, again boolean, lead int, windows int, body binary, cuts array<struct<at: int, gone: int>>"
PART = "key long, same long, n long, anchor long, ctx long, again boolean, first int, place int, windows int, body binary"


def _blocks(it, size: int):
    """The stretches of windows (first in its context, place by the anchor) cut into blocks of places k * size .. k * size + size - 1.

    key: of the anchor, the block and the bytes common to all its windows; same: of the stretch's bytes.
    """
    names = [c.split()[0] for c in PART.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int32()] * 3 + [pa.binary()]
    out, held = [], 0

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in it:
        for anchor, ctx, n, again, first, place, windows, body in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            raw = np.frombuffer(body, np.uint8)
            prefix = prefix_hash(raw)
            at = np.arange(windows)
            spots = place + at
            if again:  # each window goes by the leftmost of the anchor's grams in it, as equal windows elsewhere do
                own = np.flatnonzero(signed(grams(raw, GRAM)) == anchor)
                spots = at - own[np.searchsorted(own, at)]
            block = spots // size
            a = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (spots[1:] != spots[:-1] + 1)]))
            b = np.append(a[1:], windows)
            core = a - spots[a] + block[a] * size
            where = mix(block[a].astype(np.uint64))
            key = signed(mix(span_hash(prefix, core + size - 1, core + SPAN) ^ where ^ np.uint64(anchor & (2**64 - 1))))
            same = signed(mix(span_hash(prefix, a, b + SPAN - 1) + (b - a).astype(np.uint64)))
            for k in range(len(a)):
                out.append((key[k], same[k], n, anchor, ctx, False, first + a[k], spots[a[k]], b[k] - a[k], body[a[k] : b[k] + SPAN - 1]))
                held += len(out[-1][-1])
                if held > BLOCK_BYTES:
                    yield made(out)
                    out, held = [], 0
    if out:
        yield made(out)
    pa.default_memory_pool().release_unused()


def _split(bodies: DataFrame) -> list[DataFrame]:
    """For anchors with very many contexts, a table for each size of blocks: those that agree (alike), and small shards of those that don't."""
    columns = ["anchor", "ctx", "n", "again", "first", "place", "windows", "body"]
    rest = bodies.withColumn("first", F.lit(0)).withColumn("place", -F.col("lead")).select(*columns)
    found = []
    for size in BLOCKS:
        blocks = materialize(rest.mapInArrow(lambda it, size=size: _blocks(it, size), PART))
        keys = blocks.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), (F.min("same") == F.max("same")).alias("alike")).where("total > 1")
        judged = materialize(blocks.join(keys.select("key", "alike", (F.col("rows") <= HOT).alias("few")), "key"))
        discard(blocks)
        found.append(judged)
        rest = judged.where("not alike and not few").select(*columns)
    return found


def intervals(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): for each document row with something to remove, the byte intervals, which may overlap."""
    arrow_batches(docs.sparkSession)
    text = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    found = text.where(F.octet_length("text") >= SPAN).mapInArrow(_runs, RUN)
    often = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor"))
    held = materialize(found.join(often, "anchor"))
    discard(often)
    first = lambda c: F.first(c).alias(c)  # noqa: E731  of the one row each group's buffer began with
    contexts = materialize(
        held.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), *map(first, ("k1", "k2", "start", "windows", "lead")))
    )
    size = F.sum(F.col("windows").cast("long") + SPAN - 1)
    mixed = contexts.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("again").alias("any_again"), (size > HOT * (2 * SPAN - GRAM)).alias("hot")
    )
    wanted = contexts.join(mixed.where("least = 1 and (kinds > 1 or any_again)").select("anchor", "hot"), "anchor")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "ctx", "n", "hot", "again", "lead", "windows", "start")).alias("wanted"))
    bodies = materialize(
        text.join(wanted, ["k1", "k2"]).select("wanted", "text").mapInArrow(_bodies, BODY)
    )
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = bodies.where("not hot").select(F.col("anchor").alias("shard"), "anchor", "ctx", F.lit(0).alias("first"), "body")
    split = _split(bodies.where("hot"))
    for judged in split:
        shards = shards.unionByName(judged.where("not alike and few").select(F.col("key").alias("shard"), "anchor", "ctx", "first", "body"))
    shards = shards.repartition(n_parts, "shard").sortWithinPartitions("shard", "anchor", "ctx", "first")
    windows = shards.mapInArrow(_shard, "anchor long, ctx long, first long, last long")
    for judged in split:
        stretch = judged.where("alike").select("anchor", "ctx", F.col("first").cast("long").alias("first"), (F.col("first") + F.col("windows")).cast("long").alias("last"))
        windows = windows.unionByName(stretch)
    whole = contexts.where("n > 1").select("anchor", "ctx", F.lit(0).cast("long").alias("first"), F.col("windows").cast("long").alias("last"))
    windows = windows.join(contexts.where("n > 1").select("anchor", "ctx"), ["anchor", "ctx"], "left_anti").unionByName(whole)
    none = F.lit(None).cast("long")
    cuts = bodies.where("cuts is not null and n = 1").select("anchor", "ctx", none.alias("first"), none.alias("last"), "cuts")
    both = windows.unionByName(cuts, allowMissingColumns=True).groupBy("anchor", "ctx")
    spans = both.agg(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("found"), F.first("cuts", ignorenulls=True).alias("cuts"))
    # places in what was left become places in the context; what was cut goes too
    spans = spans.withColumn("cuts", F.coalesce("cuts", F.expr("cast(array() as array<struct<at: int, gone: int>>)")))
    placed = lambda x: x + F.aggregate(F.filter("cuts", lambda c: c["at"] <= x), F.lit(0).cast("long"), lambda n, c: n + c["gone"])
    found = F.transform("found", lambda w: F.struct(placed(w["first"]).alias("first"), (placed(w["last"] - 1) + 1).alias("last")))
    gone = F.transform("cuts", lambda c: F.struct((placed(c["at"]) - c["gone"]).alias("first"), placed(c["at"]).alias("last")))
    verdicts = materialize(spans.select("anchor", "ctx", F.concat(found, gone).alias("windows")))
    cut = held.select("anchor", "ctx", "k1", "k2", "start").join(verdicts, ["anchor", "ctx"]).select("k1", "k2", "start", F.explode("windows").alias("w"))
    span = F.struct((F.col("start") + F.col("w.first")).alias("a"), (F.col("start") + F.col("w.last") + SPAN - 1).alias("b"))
    out = materialize(cut.groupBy("k1", "k2").agg(F.collect_list(span).alias("spans")))
    discard(held, contexts, bodies, verdicts, *split)
    return out


def _cut(it):
    """n_bytes, n_removed, n_spans, kept_sha256 and the kept text behind the columns (.., spans, text) as they come."""
    for batch in it:
        at = batch.schema.get_field_index("__spans")
        spans, texts = batch.column(at).to_pylist(), batch.column(at + 1).cast(pa.binary()).to_pylist()
        out = []
        for own, text in zip(spans, texts, strict=True):
            text = text or b""
            kept, end, n_spans = [], 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in own or ()):
                if a > end or not n_spans:
                    kept.append(text[end:a])
                    n_spans += 1
                    end = b
                else:
                    end = max(end, b)
            kept.append(text[end:])
            rest = b"".join(kept)
            out.append((len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["__n_bytes", "__n_removed", "__n_spans", "__kept_sha256", "__kept"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*batch.schema.names[:at], *names])


def cut(docs: DataFrame) -> DataFrame:
    """The documents with __n_bytes, __n_removed, __n_spans, __kept_sha256 and __kept, the text that stays (bytes that a cut leaves broken go from it)."""
    spans = intervals(docs).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans"})
    keys = row_key()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")  # names with dots can't go to Python by themselves
    plain = docs.select(row, keys[0].alias("__k1"), keys[1].alias("__k2"), F.coalesce("text", F.lit("")).alias("__text"))
    joined = plain.join(spans, ["__k1", "__k2"], "left").select("__row", "__spans", "__text")
    counted = T.StructType.fromDDL("__n_bytes long, __n_removed long, __n_spans long, __kept_sha256 string, __kept string")
    found = joined.mapInArrow(_cut, T.StructType([joined.schema["__row"], *counted]))
    return found.select(*(F.col(f"__row.`{c}`") for c in docs.columns), *counted.names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, their columns as they came but for the text, from which what repeats is removed, and n_chars, which follows it."""
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return cut(docs).select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = {"n_bytes": "__n_bytes", "n_removed": "__n_removed", "n_spans": "__n_spans", "kept_sha256": "__kept_sha256"}
    return cut(docs).select("doc_id", *(F.col(v).alias(k) for k, v in names.items()))


#: Every window of every text by its hash, removed runs as islands of starts: for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT row, i, hash(b[i:i + 199]) AS h FROM (SELECT row, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
s AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + 200, true) AS opens FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
k AS (SELECT row, i, sum(opens::INTEGER) OVER (PARTITION BY row ORDER BY i) AS run FROM s),
r AS (SELECT row, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY row, run),
p AS (SELECT row, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 1) AS a, a - 1 AS z FROM r UNION ALL SELECT row, max(z), 9223372036854775 FROM r GROUP BY row),
kept AS (SELECT row, unhex(string_agg(hex(CASE WHEN p.z < p.a THEN ''::BLOB ELSE d.b[p.a:least(p.z, octet_length(d.b))] END), '' ORDER BY p.a)) AS rest FROM p JOIN d USING (row) GROUP BY row),
n AS (SELECT row, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM r GROUP BY row)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(rest, b)) AS kept_sha256
FROM d LEFT JOIN n USING (row) LEFT JOIN kept USING (row)
"""
