"""Document fingerprints from prefix polynomial hashes.

A text's prefix array (PrefixHash) holds the sums of (c_i + 1) * BASE**i over its code points, modulo the prime 2**61 - 1. From it the
hash of any span is one subtraction and one product, so that spans of any two texts compare at once, and the longest
common extension of two places is found by binary search. The fingerprint is the text's hash, its length and the SKETCH
least distinct hashes (upper 32 bits) of its WINDOW-point spans, in hex. The likeness of two fingerprints is the share of
the least SKETCH hashes of both together that both have, an estimate of the Jaccard likeness of their spans (exact where
neither has more than SKETCH); it is 1 for equal texts.

The query also edits each text with the start of the next document's by doc_id. Rows are dealt by ranges of doc_id whose
bounds are ids found by percentile_approx; a range's first document goes to the range before as well (the very first to
the last), so neighbours meet in a task with one shuffle of the texts, and a task holds two of its texts at a time.

Cases: null text is empty; an empty text's only span is itself. Texts shorter than WINDOW are one span. Null doc_ids come
first. Rows that repeat a doc_id follow each other in the order of their texts. With one row the next document is itself.
Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import INVERSE, PRIME, arrow_batches, powers, prefix_hash, span_hash, table

WINDOW, SKETCH = 16, 64
RANGES = 64
LEAST = -(2**63)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_start_edited long, common_start_next long"
)


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = prefix_hash(codes)

    def spans(self, start, size: int) -> np.ndarray:
        """Hashes of the spans of `size` points at `start` (an array), wherever they stand."""
        start = np.atleast_1d(start)
        return span_hash(self.sums, start, start + size)

    def span(self, i: int, size: int) -> int:
        """Hash of one span: below PRIME, and the same wherever it stands."""
        x = int(self.sums[i + size]) - int(self.sums[i])
        return x * int(powers(INVERSE, i + 1)[i]) % PRIME

    def equal(self, i: int, other: PrefixHash, j: int, size: int) -> bool:
        return self.span(i, size) == other.span(j, size)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def sketch(h: PrefixHash) -> np.ndarray:
    """The SKETCH least distinct span hashes, in order."""
    if h.n <= WINDOW:
        return (h.spans([0], h.n) >> np.uint64(32)).astype(np.uint32)
    spans = (h.spans(np.arange(h.n - WINDOW + 1), WINDOW) >> np.uint64(32)).astype(np.uint32)
    some = 3 * SKETCH
    if len(spans) > some:
        least = np.unique(np.partition(spans, some)[:some])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(spans)[:SKETCH]


def fingerprint(h: PrefixHash, least: np.ndarray) -> str:
    return f"{h.span(0, h.n):016x}{h.n:08x}" + least.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[24:]), ">u4") for s in (a, b))
    union = np.union1d(x, y)
    if max(len(x), len(y)) >= SKETCH:
        union = union[:SKETCH]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def _ranges(docs: DataFrame, n: int) -> np.ndarray:
    """Ids that n ranges begin with: bounded by n, the smallest id first."""
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    row = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id")).agg(F.min("id").alias("first"), F.percentile_approx("id", shares, 100 * n).alias("rest")).first()
    return np.unique(np.array([] if row["first"] is None else [row["first"], *row["rest"]], np.int64))


def next_documents(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, tail, doc_id, text), dealt and sorted so that each row's next document is the row behind it; tail rows only follow."""
    firsts = _ranges(docs, ranges)

    def deal(it):
        for batch in it:
            ids = np.array([LEAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            part = np.maximum(np.searchsorted(firsts, ids, side="right") - 1, 0)
            lead = np.flatnonzero(firsts[part] == ids) if len(firsts) else np.zeros(0, np.int64)
            rows = pa.array(np.concatenate([np.arange(len(ids)), lead]))
            parts = np.concatenate([part, (part[lead] - 1) % max(1, len(firsts))])
            tail = np.repeat([0, 1], [len(ids), len(lead)])
            both = batch.take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(tail, pa.int32()), both.column(0), both.column(1)], ["part", "tail", "doc_id", "text"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "part long, tail int, doc_id long, text string")
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def _edit(it):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    held = None  # (part, doc_id, points, hash, fingerprint) of the row before

    for batch in it:
        out = []
        for part, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = points(text)
            h = PrefixHash(codes)
            print_ = fingerprint(h, sketch(h))
            if held and held[0] == part:
                _, own_id, own, own_h, own_print = held
                k = len(own) // 2
                edited = np.concatenate([own[: len(own) - k], codes[:k]])
                eh = PrefixHash(edited)
                edited_print = fingerprint(eh, sketch(eh))
                said = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")).hexdigest()
                out.append((own_id, len(own), said, own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, print_), own_h.extension(0, eh, 0), own_h.extension(0, h, 0)))
            held = None if tail else (part, doc_id, codes, h, print_)
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row of SCHEMA for each document."""
    ranges = ranges or max(RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return next_documents(docs, ranges).mapInArrow(_edit, SCHEMA)


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
