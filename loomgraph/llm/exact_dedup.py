"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

Key of a row: xxhash64 of its normalised text. The directory is addressed by the key's leading bits. It begins with one
bucket; an overfull bucket (more than `capacity` distinct keys) is split by its next bit, which doubles the directory where
its depth is used up. Buckets are dealt to owners in the order of their keys, so each owner task has a range of keys. The
texts are shuffled once, straight to their owners. An owner chains the rows of one key: texts are told apart by their bytes,
so keys that collide share a chain, in which each has a place. Chains (owner, bucket, key, place, digest, what stays, size)
are the index file of the owner in the shared folder; documents look theirs up by bucket, key and digest.

The directory is worked out over a histogram of 2**MAX_DEPTH cells, never over rows. Capacity grows with the table, so that
the depth is enough at any size: keys are hashes, and fill their buckets evenly.

A key that more than one in HOT_SHARE of all rows has goes through a grouping that begins map-side before it is dealt, so
that a text that a third of all rows hold reaches its owner once. There are at most HOT_SHARE such keys, and they are
broadcast. The look-up is an equi-join of slim rows, which AQE splits where a key is hot.

Cases: null text counts as empty; empty texts are equal. Of equal texts the row with the most code points in the
original, then the smallest doc_id stays (null ids last). Rows that repeat a doc_id and text share a verdict; keep_first
leaves one of them. Very long texts are compared whole. Empty table: no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, row_key, table

#: Bits of the key that the directory may use, and so 2**MAX_DEPTH cells at most: its size is bounded.
MAX_DEPTH = 14
#: Distinct keys that a bucket holds before it is split, or the keys' number / 2**(MAX_DEPTH - 2) where that is more.
CAPACITY = 20_000
#: A key with more rows than this, and than one in HOT_SHARE of all, is hot.
HOT_ROWS, HOT_SHARE = 100, 65_536
UNIT = 10**20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _key() -> Column:
    return F.xxhash64("norm")


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def directory(sizes: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(depth of the directory, [(prefix, depth, keys) of each bucket, in key order]). sizes: distinct keys by used cell."""
    before = [0]
    for c in range(1 << MAX_DEPTH):
        before.append(before[-1] + sizes.get(c, 0))
    depth, out, waiting = 0, [], [(0, 0)]
    while waiting:
        prefix, bits = waiting.pop()
        first = prefix << (MAX_DEPTH - bits)
        n = before[first + (1 << (MAX_DEPTH - bits))] - before[first]
        if n > capacity and bits < MAX_DEPTH:
            depth = max(depth, bits + 1)  # doubles the directory if all of its bits were used
            waiting += [(2 * prefix + 1, bits + 1), (2 * prefix, bits + 1)]
        else:
            out.append((prefix, bits, n))
    return depth, out


def _dealt(spark: SparkSession, keys: DataFrame, capacity: int, owners: int) -> DataFrame:
    """(cell, bucket, owner) of each cell of the key: owners have ranges of buckets with about as many keys each."""
    held = keys.distinct().groupBy(_cell(F.col("key")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2**MAX_DEPTH
    sizes = {r["cell"]: r["n"] for r in held}
    total, up_to, rows = sum(sizes.values()), 0, []
    _, buckets = directory(sizes, max(capacity, total >> (MAX_DEPTH - 2)))
    for prefix, bits, n in buckets:
        # a bucket's name: a leading one, then its prefix; prefixes of different depths never clash
        own = [(cell, 1 << bits | prefix) for cell in range(prefix << (MAX_DEPTH - bits), (prefix + 1) << (MAX_DEPTH - bits))]
        part = [0]
        for cell, _ in own:
            part.append(part[-1] + sizes.get(cell, 0))
        # a bucket that is more than one owner's share is dealt by its cells
        rows += [(cell, bucket, min(owners - 1, owners * (up_to + part[k]) // max(1, total))) for k, (cell, bucket) in enumerate(own)]
        up_to += n
    # every cell is there, in order: the directory as one literal, which needs no Python on the executors
    listed = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(" ".join(f"{bucket}:{owner}" for _, bucket, owner in rows)), " ")).alias("cell", "to"))
    return listed.select("cell", *(F.split("to", ":")[k].cast("int").alias(c) for k, c in enumerate(("bucket", "owner"))))


def index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(entries, chains): a slim row for each document, and the index files with a row for each distinct normalised text."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("norm", normalised(F.col("text")))
    entries = materialize(base.select("doc_id", row_key()[1], _key().alias("key"), F.sha2("norm", 256).alias("text_sha256")))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = F.broadcast(_dealt(spark, entries.select("key"), capacity, owners))  # 2**MAX_DEPTH rows of 12 bytes
    limit = max(HOT_ROWS, entries.count() // HOT_SHARE)
    hot = F.broadcast(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"))  # at most HOT_SHARE rows
    # Most code points first, then the smallest doc_id, as one decimal, so that the grouping keeps a fixed-width buffer:
    # rank = points * UNIT - id, where |id| <= 2**63 < UNIT / 2; a null id counts as 2**63.
    unit, last = F.lit(str(UNIT)).cast("decimal(21,0)"), F.lit(str(2**63)).cast("decimal(20,0)")
    n_points = F.length(F.coalesce(F.col("text"), F.lit("")))
    rank = n_points.cast("decimal(18,0)") * unit - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), last)
    ranked = base.select("norm", _key().alias("key"), rank.cast("decimal(38,0)").alias("rank"), F.lit(1).cast("long").alias("n"))
    chained = [F.max("rank").alias("rank"), F.sum("n").alias("n")]
    few, many = ranked.join(hot, "key", "left_anti"), ranked.join(hot, "key", "left_semi").groupBy("key", "norm").agg(*chained)
    placed = few.select("key", "norm", "rank", "n").unionByName(many).withColumn("cell", _cell(F.col("key"))).join(cells, "cell").drop("cell")
    own = placed.repartitionById(owners, F.col("owner")).groupBy("owner", "bucket", "key", "norm").agg(*chained)
    points = F.round(F.col("rank") / unit).cast("decimal(17,0)")
    keep = (points * unit - F.col("rank")).cast("decimal(20,0)")
    own = own.select("owner", "bucket", "key", F.sha2("norm", 256).alias("text_sha256"), F.when(keep != last, keep).cast("long").alias("keep_id"), F.col("n").alias("group_size"))
    place = F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("text_sha256"))
    chains = materialize(own.withColumn("place", place), "bucket", "key")
    looking = entries.withColumn("cell", _cell(F.col("key"))).join(cells, "cell").drop("cell", "owner")
    return looking, chains


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, key, place (in the key's chain), k2 (row key) for each document."""
    entries, chains = index(docs, capacity)
    return entries.join(chains.drop("owner"), ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "key", "place", "k2"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with its columns as they came."""
    verdicts = exact_dedup(docs).select("bucket", "key", "text_sha256", F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), "k2", "kept")
    # of rows that share the id that stays, those of one (id, hash); of rows that share that, too, one
    rows = materialize(verdicts.groupBy("bucket", "key", "text_sha256", "k1", "k2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    stays = rows.where("kept").groupBy("bucket", "key", "text_sha256").agg(F.min(F.struct("k1", "k2")).alias("stays"))
    own = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2"))
    judged = materialize(rows.join(stays, ["bucket", "key", "text_sha256"]).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), own.alias("stays"), "n"))
    discard(rows)
    keys, pair = row_key(), ["__k1", "__k2"]
    keyed = docs.select("*", keys[0].alias("__k1"), keys[1].alias("__k2"))
    once = keyed.join(judged.where("not stays or n > 1").select(*pair), pair, "left_anti")
    more = keyed.join(judged.where("stays and n > 1").select(*pair), pair, "left_semi").dropDuplicates(pair)
    return once.unionByName(more).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
