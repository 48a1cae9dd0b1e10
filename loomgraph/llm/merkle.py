"""Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

Rows are sorted once by (source, doc_id), so that a row's place in its source is known from counts alone; the number of a
tree's leaves fixes how many children each node has. Then digests travel upwards as events, as in a combineByKey: a task
holds partial parents, which gather child digests by place; a parent that has as many as the tree's size says is hashed,
written as a link to its children, and becomes an event for its own parent. As a task has runs of neighbouring rows, only
the parents at the ends of runs stay partial. Their children, the frontier, are shuffled to the task of their ancestor at
the next multiple of SLAB levels, and so on until the root is there; every round lifts the lowest slab whole.

Proofs follow the links back: a slab of a tree (SLAB levels below one node) is sorted from its top to its leaves, and a
child's proof is its siblings' digests before its parent's proof. A slab has 3**SLAB leaves at most, so that neither a task
nor a source of any size holds more than one slab, and a lost executor costs a slab's work again.

Cases: a null is `-` in the leaf's hash and sorts first, for the source too; an empty text is `0:`. Rows of a source that
repeat a doc_id are ordered by their leaf digest; rows alike in all columns have neighbouring leaves of their own. A source
of one row is its leaf, a table of one row its own root with an empty proof. Empty table: no rows. Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, discard, materialize, table

ARITY = 3
#: Levels of a slab: 729 leaves.
SLAB = 6
#: The tree over the sources' roots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of the upward pass: a link of a node to its children, a child that waits for siblings, a source's root, the root.
LINK, WAITING, SUBROOT, ROOT = 0, 1, 2, 3
NODES = "kind int, tree long, level int, place long, size long, digests binary"
SUFFIXES = "tree long, level int, place long, size long, proof binary, subroot binary"
PROOFS = "doc_id long, tree long, place long, size long, leaf binary, other binary, subroot binary, proof binary"


def hashed(fields: list[Column]) -> Column:
    """The digest (binary) of fields, each `-` or its UTF-8 length, `:` and itself."""
    as_text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in as_text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def levels(size: int) -> int:
    """Levels above the leaves of a tree of so many."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def slab_of(level: int) -> int:
    """The slab in which a node is a top or an inner node; leaves are at the bottom of slab 0."""
    return max(0, level - 1) // SLAB


class Tree:
    """Partial parents of a task: an event may complete one, whose digest is the next event."""

    def __init__(self, tops: int):
        self.tops, self.partial, self.out = tops, {}, []

    def event(self, tree: int, level: int, place: int, size: int, digest: bytes) -> None:
        """size: nodes of the tree at this level."""
        while True:
            if size == 1:
                if tree == TOP:
                    self.out.append((ROOT, TOP, level, 0, 1, digest))
                    return
                self.out.append((SUBROOT, TOP, 0, tree, level, digest))  # size holds the height of the source's tree
                tree, level, place, size = TOP, 0, tree, self.tops
                continue
            parent = place // ARITY
            arity = min(ARITY, size - ARITY * parent)
            held = self.partial.setdefault((tree, level, parent), (size, {}))[1]
            held[place - ARITY * parent] = digest
            if len(held) < arity:
                return
            del self.partial[tree, level, parent]
            children = [held[k] for k in range(arity)]
            level, place, size = level + 1, parent, -(-size // ARITY)
            self.out.append((LINK, tree, level, place, size, b"".join(children)))
            digest = parent_digest(children)

    def frontier(self) -> None:
        for (tree, level, parent), (size, held) in self.partial.items():
            self.out += [(WAITING, tree, level, ARITY * parent + k, size, d) for k, d in held.items()]
        self.partial = {}

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "tree", "level", "place", "size", "digests"])


def _combine(tops: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Tree(tops)
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "place", "size", "digests")), strict=True):
                state.event(*row)
            yield state.batch()
        state.frontier()
        yield state.batch()

    return run


def _slabbed(df: DataFrame, slab: Column) -> DataFrame:
    """With slab and block: the place of a node's ancestor at the slab's top."""
    wide = F.element_at(F.array(*[F.lit(ARITY**k).cast("long") for k in range(SLAB + 1)]), ((F.col("slab") + 1) * SLAB - F.col("level") + 1).cast("int"))
    return df.withColumn("slab", slab.cast("int")).withColumn("wide", wide).withColumn("block", F.expr("place div wide")).drop("wide")


def _up(places: DataFrame, tops: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of all rounds, the tables that hold them)."""
    rounds = [materialize(places.select("tree", F.lit(0).alias("level"), "place", "size", F.col("leaf").alias("digests")).mapInArrow(_combine(tops), NODES))]
    while True:
        waiting = rounds[-1].where(F.col("kind") == WAITING)
        if waiting.isEmpty():
            break
        near = _slabbed(waiting, F.floor(F.col("level") / SLAB)).repartition("tree", "slab", "block").sortWithinPartitions("tree", "level", "place")
        rounds.append(materialize(near.select("tree", "level", "place", "size", "digests").mapInArrow(_combine(tops), NODES)))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.where(F.col("kind") != WAITING), rounds


def placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """(leaves with tree, place and size, number of sources, rows of the largest source). leaves: source, doc_id, leaf, other."""
    unsorted = materialize(leaves.withColumn("row", F.monotonically_increasing_id()))
    order = ["source", "doc_id", "leaf", "row"]  # nulls first; rows alike are told apart, so that any number can be split
    ordered = materialize(unsorted.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    discard(unsorted)
    part = F.shiftright("at", 33).alias("part")  # monotonically_increasing_id: partition, then place in it
    runs = ordered.groupBy("source", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("source").orderBy("part")
    runs = runs.select("*", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("source")).alias("size"))
    runs = materialize(runs.withColumn("leads", (F.col("start") == 0).cast("int")))
    # a source's number: sources that begin in earlier partitions, and earlier in its own
    begun = runs.groupBy("part").agg(F.sum("leads").alias("k")).select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("earlier"))  # a row a partition
    nth = F.sum("leads").over(Window.partitionBy("part").orderBy("first")) - 1
    heads = runs.withColumn("nth", nth).where("leads = 1").join(begun, "part").select(F.col("source").alias("s"), (F.col("earlier") + F.col("nth")).alias("tree"))
    numbered = runs.join(heads, F.col("source").eqNullSafe(F.col("s"))).select("source", F.col("part").alias("p"), "tree", "start", "size", "first")
    numbered = materialize(numbered.withColumnRenamed("source", "s"))
    total = numbered.agg(F.count_if(F.col("start") == 0).alias("tops"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).first()
    joined = ordered.join(numbered, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p")))
    out = joined.select("doc_id", "leaf", "other", "tree", "size", (F.col("start") + F.col("at") - F.col("first")).alias("place"))
    out = materialize(out, "tree", "place")
    discard(ordered, runs, numbered)
    return out, total["tops"], total["largest"]


#: Order of a slab's rows: from its top down; at one node, its proof, then its link, then what stands at the bottom.
_STEP = "tree long, block long, down int, step int, place long, level int, size long, digests binary, subroot binary, doc_id long, other binary"


def _stepped(df: DataFrame, step: int, **more: Column) -> DataFrame:
    empty = {"digests": "binary", "subroot": "binary", "doc_id": "long", "other": "binary"}
    cols = [F.col("tree"), F.col("block"), (-F.col("level")).alias("down"), F.lit(step).alias("step"), F.col("place"), F.col("level"), F.col("size")]
    return df.select(*cols, *(more[c].alias(c) if c in more else F.lit(None).cast(t).alias(c) for c, t in empty.items()))


def _walk(slab: int, schema: str):
    """Proofs of a slab's bottom: of nodes below, of sources' roots (in the top tree), or of rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, proofs, subroot = None, {}, None
        for batch in it:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("tree", "block", "step", "place", "level", "size", "digests", "subroot", "doc_id", "other"))
            for tree, block, step, place, level, size, digests, sub, doc_id, other in zip(*columns, strict=True):
                if (tree, block) != at:
                    at, proofs = (tree, block), {}
                if step == 0:
                    proofs[level, place], subroot = digests, sub
                elif step == 1:
                    proof = proofs.pop((level, place))
                    children = [digests[k : k + 32] for k in range(0, len(digests), 32)]
                    for k in range(len(children)):
                        below = b"".join(children[:k] + children[k + 1 :]) + proof
                        if slab and level - 1 == SLAB * slab:
                            out.append((tree, level - 1, ARITY * place + k, 0, below, subroot))
                        else:
                            proofs[level - 1, ARITY * place + k] = below
                elif tree == TOP:
                    out.append((place, size, 0, 0, proofs.pop((0, place)), digests))
                else:
                    out.append((doc_id, tree, place, size, digests, other, subroot, proofs.pop((0, place))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _walked(rows: DataFrame, slab: int, schema: str) -> DataFrame:
    near = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "down", "step", "place")
    return near.mapInArrow(_walk(slab, schema), schema)


def _down(nodes: DataFrame, places: DataFrame, tops: int, largest: int) -> DataFrame:
    """PROOFS of every row, slab by slab from the root. A slab's rows meet in one task, 3**SLAB leaves at most."""
    by_level = F.floor(F.greatest(F.lit(0), F.col("level") - 1) / SLAB)
    links = _slabbed(nodes.where(F.col("kind") == LINK), by_level)
    subroots = _stepped(_slabbed(nodes.where(F.col("kind") == SUBROOT), F.lit(0)), 2, digests=F.col("digests"))
    waiting = _slabbed(nodes.where(F.col("kind") == ROOT).select("tree", "level", "place", "size", F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot")), by_level)

    def entering(slab: int, inside: Column) -> DataFrame:
        here = (F.col("slab") == slab) & inside
        return _stepped(waiting.where(here), 0, digests=F.col("proof"), subroot=F.col("subroot")).unionByName(_stepped(links.where(here), 1, digests=F.col("digests")))

    for slab in range(slab_of(levels(tops)), -1, -1):
        rows = entering(slab, F.col("tree") == TOP)
        waiting = materialize(_slabbed(_walked(rows if slab else rows.unionByName(subroots), slab, SUFFIXES), by_level))
    for slab in range(slab_of(levels(largest)), 0, -1):
        lower = waiting.where(F.col("slab") < slab)
        waiting = materialize(_slabbed(_walked(entering(slab, F.col("tree") != TOP), slab, SUFFIXES), by_level).unionByName(lower))
    own = _stepped(_slabbed(places.withColumn("level", F.lit(0)), F.lit(0)), 2, digests=F.col("leaf"), doc_id=F.col("doc_id"), other=F.col("other"))
    return _walked(entering(0, F.col("tree") != TOP).unionByName(own), 0, PROOFS)


def folded(leaf: bytes, place: int, size: int, proof: list[bytes]) -> bytes:
    """The root of a tree of `size` leaves that a leaf at `place` and its siblings give. Takes its siblings off the proof."""
    taken = 0
    while size > 1:
        own, start = place % ARITY, place - place % ARITY
        arity = min(ARITY, size - start)
        run = proof[taken : taken + arity - 1]
        leaf = parent_digest([*run[:own], leaf, *run[own:]])
        taken += arity - 1
        place, size = place // ARITY, -(-size // ARITY)
    del proof[:taken]
    return leaf


def _fold(tops: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for tree, place, size, digest, proof in zip(*(batch.column(c).to_pylist() for c in ("tree", "place", "size", "presented", "proof")), strict=True):
                siblings = [proof[k : k + 32] for k in range(0, len(proof), 32)]
                out.append((parent_digest(siblings), folded(folded(digest, place, size, siblings), tree, tops, siblings)))
            extra = list(zip(*out, strict=True)) if out else [[], []]
            columns = [*batch.columns, *(pa.array(c, pa.binary()) for c in extra)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "proof_digest", "folded"])

    return run


class Manifest:
    """proofs: doc_id, tree (the source's number), place, size, leaf, other, subroot, proof (siblings' digests, joined), root.

    verified(column) folds a digest of each row, as presented by whoever holds the row, with the row's proof.
    """

    def __init__(self, proofs: DataFrame, tops: int):
        self.proofs, self.tops = proofs, tops

    def verified(self, presented: Column) -> DataFrame:
        """proofs with proof_digest, folded (the root that the presented digest gives) and verified."""
        given = self.proofs.withColumn("presented", presented)
        schema = f"{PROOFS}, root binary, presented binary, proof_digest binary, folded binary"
        return given.mapInArrow(_fold(self.tops), schema).withColumn("verified", F.col("folded") == F.col("root"))


def manifest(leaves: DataFrame) -> Manifest:
    """Of leaves (source string, doc_id long, leaf binary, other binary); `other` is carried along."""
    arrow_batches(leaves.sparkSession)
    places, tops, largest = placed(leaves)
    nodes, _ = _up(places, tops)
    proofs = _down(nodes, places, tops, largest)
    root = nodes.where(F.col("kind") == ROOT).first()  # one row, none of an empty table
    return Manifest(proofs.withColumn("root", F.lit(bytes(root["digests"]) if root else b"")), tops)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents; other: the leaf of the text without line feeds, where the id's CRC-32 is even and the text has any."""
    fields = [F.col(c) for c in FIELDS]
    cut = hashed([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), hashed(fields).alias("leaf"), F.when(changed, cut).alias("other"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = manifest(document_leaves(table(spark, sf_dir, "documents"))).verified(F.coalesce("other", "leaf"))
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_digest": "proof_sha256", "folded": "folded_root"}
    return checked.select("doc_id", *(F.lower(F.hex(c)).alias(as_) for c, as_ in names.items()), "verified")


#: CRC-32 of a text of digits and signs, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))))"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
ORACLE = f"""
WITH RECURSIVE tops AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS size FROM documents GROUP BY source),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN sha256(head || {_FIELD.format("replace(text, chr(10), '')")}) ELSE leaf END AS given
  FROM (SELECT d.doc_id, d.text, t.tree, t.size, {" || ".join(_FIELD.format(f"d.{c}") for c in FIELDS[:-1])} AS head, sha256({" || ".join(_FIELD.format(f"d.{c}") for c in FIELDS)}) AS leaf
        FROM documents d JOIN tops t ON d.source IS NOT DISTINCT FROM t.source)),
nodes AS (SELECT tree, 0 AS level, place, size, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level + 1, place // 3, max(size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE size > 1 GROUP BY tree, level, place // 3),
subroots AS (SELECT tree, level AS height, digest FROM nodes WHERE size = 1),
upper AS (SELECT 0 AS level, tree AS place, (SELECT count(*) FROM tops) AS size, digest FROM subroots
  UNION ALL SELECT level + 1, place // 3, max(size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM upper WHERE size > 1 GROUP BY level, place // 3),
every AS (SELECT n.tree, level, place, n.size, n.digest FROM nodes n WHERE size > 1 UNION ALL SELECT -1, level, place, size, digest FROM upper WHERE size > 1),
steps AS (SELECT l.doc_id, l.tree AS own, l.place AS leaf_place, e.tree, e.level + CASE WHEN e.tree < 0 THEN s.height ELSE 0 END AS step,
    CASE WHEN e.tree < 0 THEN l.tree ELSE l.place END // (3 ** e.level)::BIGINT AS place, e.level
  FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN (SELECT DISTINCT tree, level FROM every) e ON e.tree IN (l.tree, -1)),
siblings AS (SELECT s.own, s.leaf_place, s.step, s.place AS self, e.place, e.digest FROM steps s JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.place // 3 = s.place // 3),
proofs AS (SELECT own, leaf_place, sha256(string_agg(digest, '' ORDER BY step, place)) AS proof_sha256 FROM siblings WHERE place <> self GROUP BY own, leaf_place),
runs AS (SELECT own, leaf_place, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < self), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > self), '') AS after FROM siblings GROUP BY own, leaf_place, step),
folds AS (SELECT tree AS own, place AS leaf_place, 0 AS step, given AS digest FROM leaves
  UNION ALL SELECT f.own, f.leaf_place, f.step + 1, sha256(r.before || f.digest || r.after) FROM folds f JOIN runs r ON f.own = r.own AND f.leaf_place = r.leaf_place AND f.step = r.step)
SELECT l.doc_id, l.leaf, s.digest AS subroot, u.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = u.digest AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN upper u ON u.size = 1
LEFT JOIN proofs p ON p.own = l.tree AND p.leaf_place = l.place
JOIN (SELECT own, leaf_place, max_by(digest, step) AS digest FROM folds GROUP BY own, leaf_place) f ON f.own = l.tree AND f.leaf_place = l.place
"""
