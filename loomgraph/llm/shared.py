"""Helpers that several operators share: scratch tables, Arrow batches, rolling hashes over UTF-8 bytes."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 18
#: Rows of an Arrow batch.
ARROW_ROWS = 1_000
#: Seconds between two collections that let the driver drop shuffle files.
COLLECT_EVERY = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Only where that is unset and Spark runs in one process (tests) a local folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "/tmp/checkpoints/loomgraph"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/loomgraph-{uuid.uuid4().hex}"


def arrow_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of whole texts small, where the session leaves them at Spark's 10,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def materialize(df: DataFrame, *sort: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder."""
    path = shared_dir(df.sparkSession)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first unless a whole one is there: a write ends with its _SUCCESS file, what was broken off is replaced."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
        release(spark)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote. Only for those whose every reader has run."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_collected = [0.0]


def release(spark: SparkSession) -> None:
    """Lets the driver's context cleaner delete shuffle files that no plan refers to any more: it acts on collected objects only."""
    if time.monotonic() - _collected[0] >= COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Two columns that identify a document row; rows alike in id and text share them and every verdict."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id)).alias("k2"),
    ]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string or binary Arrow column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, of one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


#: Prefix hashes are polynomials modulo this prime with a base drawn at random: two different strings of n symbols share a
#: hash with odds of n / 2**61.
PRIME = (1 << 61) - 1
BASE = int(np.random.default_rng(20240607).integers(1 << 59, PRIME))
INVERSE = pow(BASE, -1, PRIME)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Powers that a worker keeps; more are worked out where a text needs them.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, np.ndarray] = {}
_P, _61, _32, _31, _30, _29 = (np.uint64(x) for x in (PRIME, 61, 32, 31, 30, 29))
_LOW32, _LOW31, _LOW30, _LOW29 = (np.uint64((1 << k) - 1) for k in (32, 31, 30, 29))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x below 2**64."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it, in halves of 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * (a1 * b1) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo PRIME, grown by doubling."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), PRIME)))])
        if len(have) <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of (symbol + 1) * BASE**i modulo PRIME; symbols are below 2**29."""
    value, power = symbols.astype(np.uint64) + np.uint64(1), powers(BASE, len(symbols))
    high = value * (power >> _31)
    term = value * (power & _LOW31) + (high >> _30) + ((high & _LOW30) << _31)  # below 2**63
    low, high = np.cumsum(term & _LOW32), np.cumsum(term >> _32)  # of less than 2**31 terms
    out = np.zeros(len(symbols) + 1, np.uint64)
    out[1:] = _reduced((high >> _29) + ((high & _LOW29) << _32) + low)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols start..end (exclusive), the same wherever they stand."""
    x = prefix[end] + (_P - prefix[start])
    x = times(np.where(x >= _P, x - _P, x), powers(INVERSE, len(prefix))[start])
    return mix(x + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in raw) and row of each word [^\\x20\\x09-\\x0D]+ of the rows that off bounds; off[0] is 0."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = cut[cut > 0] - 1
    last[before] = solid[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(it, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Batches of (keys.., text): each step's rows i..j, its bytes, and offsets from 0. The text is the last of `columns`."""
    for batch in it:
        raw, off = column_bytes(batch.column(batch.schema.get_field_index(columns[-1])))
        for i, j in steps(off):
            yield batch, i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
    pa.default_memory_pool().release_unused()
