"""Sum-of-squares online packing of tokenised documents into sequences of at most 2048 tokens.

A task packs the documents of its partition one after another. Full windows are cut off a document's front; what is left
goes to the fill level that minimises the sum of squares of the numbers of partially filled windows by level, which are
tracked in a level array: opening a window at level s, moving one from level h to h + s, or closing one at level 2048 - s.
At the end of the partition the windows still open (one for most levels at most) are poured together: their pieces are cut
so that all but the last are full, and the last is cut into powers of two, which need no padding. A task keeps only its
open windows' pieces; there is no shuffle, so one hot source or copy group can't gather in a task.

sequence_id = partition * 2**33 + number in the partition.

Ids are those of the public tokenizer file, then id 1. The file's splitting never crosses white space, and pieces are
tokenised apart from each other: each distinct piece once a batch, the ids kept in a bounded cache.

Cases: null text is empty: one piece with id 1. Rows that repeat are packed as often. A document longer than a sequence
has several pieces. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import IS_SPACE, LOWER, SPACES, arrow_batches, column_bytes, steps, table, words

SEQUENCE, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: Distinct pieces whose ids a worker keeps.
CACHE = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes by kind: 0 space, 1 letter (also in two-byte Latin-1 letters), 2 digit, 3 other, 4 what the library splits itself.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[list(b"'<")] = 4
_KIND[list(SPACES)] = 0


class Pieces:
    """Ids of a tokenizer file's pieces. Runs of ASCII and Latin-1 letters, digits and marks are split here by the file's
    rule (letters | one digit | marks, after lower-casing); every other white-space-free run goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[str, list[int]] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level tokenizers
        hidden = iter(range(256, 512))
        self.letter = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}

    def of(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            if piece.isalpha() or piece.isascii() and not ODD.search(piece):
                text = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
                if piece.isascii() or LATIN.fullmatch(piece):
                    ids = [t.id for t in self.model.tokenize(text)]
            if ids is None:
                ids = self.whole.encode(piece, add_special_tokens=False).ids
            self.cache[piece] = ids
        return ids


ODD = re.compile(r"['<\x00-\x20\x7f]")
LATIN = re.compile("[a-zß-öø-ÿ]+")
_PIECES: dict[str, Pieces] = {}


def _split(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of the rows' runs, and the number of them before each row (n + 1)."""
    start, end, _ = words(raw, off)
    if not len(start):
        return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    kind, low = _KIND[raw], LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    low_byte = raw[lead + 1]
    letters = lead[(low_byte != 0x97) & (low_byte != 0xB7)]
    kind[letters] = kind[letters + 1] = 1
    upper = letters[raw[letters + 1] <= 0x9E]
    low[upper + 1] += 0x20
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    odd_run = odd[end] > odd[start]
    size = end - start
    solid = np.flatnonzero(~IS_SPACE[raw])
    in_odd = np.repeat(odd_run, size)
    k = kind[solid]
    begins = np.ones(len(solid), bool)
    begins[1:] = (k[1:] != k[:-1]) | (k[1:] == 2)
    begins[in_odd] = False
    begins[np.cumsum(size) - size] = True
    # a letter's second byte never begins a piece: its kind is that of its first
    data = np.where(in_odd, raw[solid], low[solid])
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(solid)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return pieces, np.searchsorted(solid[at], off)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's ids followed by END_ID; offsets (n + 1)."""
    pieces = _PIECES.get(path) or _PIECES.setdefault(path, Pieces(path))
    raw, off = column_bytes(texts)
    split, before = _split(raw[off[0] : off[-1]], off - off[0])
    coded = pc.dictionary_encode(split)
    distinct = [pieces.of(x) for x in coded.dictionary.to_pylist()] + [[END_ID]]
    flat = np.fromiter(chain.from_iterable(distinct), np.uint32)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    at = np.cumsum(size) - size
    # the documents' pieces with an end piece behind each document
    n = len(before) - 1
    spread = np.full(len(split) + n, len(distinct) - 1, np.int64)
    spread[np.arange(len(split)) + np.repeat(np.arange(n), np.diff(before))] = coded.indices.to_numpy()
    sizes = size[spread]
    ends = np.cumsum(sizes)
    ids = flat[np.arange(int(sizes.sum())) + np.repeat(at[spread] - ends + sizes, sizes)]
    return ids, np.concatenate([[0], ends[before[1:] + np.arange(n)]])


class Packer:
    """Pieces are [doc_id, start, length, ids, doc_tokens]; out gets rows of SCHEMA."""

    def __init__(self, first_id: int):
        self.next_id, self.out = first_id, []
        self.levels = np.zeros(SEQUENCE + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= SEQUENCE:
            self.close([(doc_id, start, ids[start : start + SEQUENCE], total)])
            start += SEQUENCE
        if s := total - start:
            self.place(s, (doc_id, start, ids[start:].copy(), total))

    def place(self, s: int, piece: tuple) -> None:
        n = self.levels
        # change of the sum of squares when a window leaves level h (0: none leaves) and enters h + s (2048: it closes)
        h = np.flatnonzero(n[: SEQUENCE - s + 1])
        change = 2 * (n[h + s] - n[h]) + 2
        change[h + s == SEQUENCE] = 1 - 2 * n[SEQUENCE - s]
        best, pieces = 2 * n[s] + 1, []
        if len(h) and change.min() <= best:
            level = int(h[np.flatnonzero(change == change.min())[-1]])
            n[level] -= 1
            pieces = self.open[level].pop()
            s += level
        pieces.append(piece)
        if s == SEQUENCE:
            self.close(pieces)
        else:
            n[s] += 1
            self.open.setdefault(s, []).append(pieces)

    def finish(self) -> None:
        rest = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        left = sum(len(p[2]) for p in rest)
        self.open, self.levels[:] = {}, 0
        room = lambda: min(SEQUENCE, 1 << (left.bit_length() - 1))
        pieces, free = [], room() if left else 0
        for doc_id, start, ids, total in rest:
            while len(ids):
                part, ids = ids[:free], ids[free:]
                pieces.append((doc_id, start, part, total))
                start, free, left = start + len(part), free - len(part), left - len(part)
                if not free:
                    self.close(pieces)
                    pieces, free = [], room() if left else 0


def _pack(it, path: str):
    packer = Packer(TaskContext.get().partitionId() << 33)

    def rows():
        *cols, ids = list(zip(*packer.out, strict=True)) or [[]] * 8
        packer.out = []
        ends = pa.array(np.concatenate([[0], np.cumsum(cols[2])]), pa.int32())
        pieces = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols), pieces], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        )

    for batch in it:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j in steps(column_bytes(texts)[1], 4 << 20):
            ids, off = token_ids(texts.slice(i, j - i), path)
            for k in range(i, j):
                packer.add(doc_ids[k], ids[off[k - i] : off[k - i + 1]])
            yield rows()
    packer.finish()
    yield rows()


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row of SCHEMA for each piece, its ids among them. path: of the tokenizer file, the same on every executor."""
    path = path or tokenizer_path()
    arrow_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda it: _pack(it, path), SCHEMA)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
