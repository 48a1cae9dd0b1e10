"""SentencePiece encoding and decoding with the n best segmentations of each whole text.

The lattice of a text has an edge for each piece that matches at a place, with the piece's log-probability, and for a
character outside the vocabulary one edge of byte pieces (the least log-probability less 10). The model file's scores are
ranks of merges, not probabilities, and a sum of ranks would prefer many short pieces; so a piece of rank r is taken to
have a probability in proportion to 1 / (r + FLATTER), by Zipf's law. Forward Viterbi gives each node the best score of a
path up to it; backward A* from the end then uses these as exact heuristics, so hypotheses leave the agenda in the order of
their full scores (ties: the one nearest to the text's start; so one of many equal paths is finished first). No node is
gone on from oftener than n times, as a later visit can't be part of one of the n best.

Texts are long but pieces are not: none has a space mark behind another character, and characters that no longer piece
holds stand alone. So a lattice is a chain of units with a node between every two. Each distinct unit's forward and
backward scores are worked out once a batch, all units of a length together in numpy; they give its best path and the
loss of its second-best. Of a text, only the units with the n - 1 smallest losses can differ from their best in the n
best texts, so only these get an A* search (kept for units that come again); their paths are merged best first.

Cases: null text is empty: one segmentation without pieces, score 0. A single unit of any length (a text without spaces)
is searched as it is. Rows that repeat give rows that repeat, an empty table none; extra columns play no part. Decoding
restores the text exactly: `decoded` tells of it.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_batches, column_bytes, prefix_hash, span_hash, steps, table

N_BEST = 4
#: Added to ranks: the commonest pieces are not as far apart as 1 / r.
FLATTER = 10
SPACE = "▁"
#: Units of more characters are searched one by one.
TOGETHER = 48
BATCH_BYTES = 1_000_000
ENCODED = "doc_id long, n_chars long, decoded boolean, ids array<array<int>>, scores array<double>"
DIGESTS = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded boolean, n_best long, scores array<double>, second_sha256 string"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, self.score, self.id, self.text = {}, {}, {}, {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.text[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p], self.id[p] = float(sp.get_score(i)), i
                self.text[i] = p.replace(SPACE, " ").encode()
        # by rank; pieces that no merge makes (scores of -1e9 or so) come last
        ranks = np.arange(len(self.score)) + FLATTER
        total = np.log((1 / ranks).sum())
        self.score = {p: float(-np.log(r) - total) for p, r in zip(sorted(self.score, key=lambda p: (-self.score[p], self.id[p])), ranks, strict=True)}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        # characters that longer pieces hold; the rest stand alone
        assert not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.joined = np.zeros(0x110000, bool)
        self.joined[[ord(c) for p in self.score if len(p) > 1 for c in p if c != SPACE]] = True
        # for numpy: 64-bit hashes of pieces by length, sorted, with scores and ids
        self.by_length = {}
        for size in range(1, self.longest + 1):
            own = [p for p in self.score if len(p) == size]
            if own:
                h = np.full(len(own), 7, np.uint64)
                for k in range(size):
                    h = self.further(h, np.array([ord(p[k]) for p in own], np.uint64))
                order = np.argsort(h)
                assert len(np.unique(h)) == len(h)
                self.by_length[size] = h[order], np.array([self.score[p] for p in own])[order], np.array([self.id[p] for p in own], np.int32)[order]
        top = max(self.text) + 1
        self.bytes = np.frombuffer(b"".join(self.text.get(i, b"") for i in range(top)), np.uint8)
        self.n_bytes = np.array([len(self.text.get(i, b"")) for i in range(top)])
        self.byte_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.found: dict[str, list] = {}

    @staticmethod
    def further(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of strings that are longer by one character."""
        h = (h ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def edges(self, unit: str, end: int):
        """(start, score) of each piece that ends at `end`."""
        get = self.score.get
        for start in range(max(0, end - self.longest), end):
            s = get(unit[start:end])
            if s is not None:
                yield start, s
        if unit[end - 1] not in self.score:
            yield end - 1, self.unknown

    def forward(self, unit: str) -> list[float]:
        best = [0.0]
        for end in range(1, len(unit) + 1):
            best.append(max(best[start] + s for start, s in self.edges(unit, end)))
        return best

    def search(self, unit: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, inner cuts), by backward A* with the forward scores as heuristics."""
        if (held := self.found.get(unit)) is not None and held[0] >= n:
            return held[1][:n]
        h, tie, out = self.forward(unit), count(), []
        agenda, visits = [(-h[len(unit)], len(unit), next(tie), 0.0, None)], [0] * (len(unit) + 1)
        while agenda and len(out) < n:
            f, at, _, g, cuts = heapq.heappop(agenda)
            visits[at] += 1
            if visits[at] > n:
                continue
            if not at:
                path, c = [], cuts
                while c is not None:
                    path.append(c[0])
                    c = c[1]
                out.append((-f, tuple(path[1:])))
                continue
            for start, s in self.edges(unit, at):
                heapq.heappush(agenda, (round(-(h[start] + s + g), 9), start, next(tie), g + s, (start, cuts)))
        if len(self.found) > 100_000:
            self.found.clear()
        self.found[unit] = n, out
        return out

    def spell(self, unit: str, cuts: tuple[int, ...]) -> list[int]:
        out = []
        for a, b in zip((0, *cuts), (*cuts, len(unit)), strict=True):
            i = self.id.get(unit[a:b])
            out += [i] if i is not None else [self.byte_id[x] for x in unit[a:b].encode("utf-8", "replace")]
        return out

    def survey(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Of each unit codes[start:end]: best score, loss of the second-best, and the best path's ids, flat with their number."""
        n, size = len(start), end - start
        score, loss, number = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # (unit of each id, ids)
        for width in np.unique(size):
            which = np.flatnonzero(size == width)
            alone = which if width > TOGETHER else which[:0]
            for b in range(0, len(which) if width <= TOGETHER else 0, 50_000):
                part = which[b : b + 50_000]
                score[part], loss[part], ids = self._together(codes[start[part][:, None] + np.arange(width)].astype(np.uint64))
                odd = (ids == -2).any(axis=1)  # characters spelt in bytes
                alone = np.concatenate([alone, part[odd]])
                ids[odd] = -1
                row, col = np.nonzero(ids >= 0)
                kept.append((part[row], ids[row, col].astype(np.int64)))
            for k in alone:
                unit = self.string(codes, start[k], end[k])
                two = self.search(unit)
                score[k], loss[k] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
                spelt = np.array(self.spell(unit, two[0][1]), np.int64)
                kept.append((np.full(len(spelt), k), spelt))
        unit, ids = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2
        ids = ids[np.argsort(unit, kind="stable")]
        return score, loss, ids, np.bincount(unit, minlength=n)

    @staticmethod
    def string(codes: np.ndarray, start: int, end: int) -> str:
        return codes[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def _together(self, codes: np.ndarray):
        n, size = codes.shape
        edge: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in range(size):
            h, rows = np.full(n, 7, np.uint64), slice(None)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = self.further(h, codes[:, end - 1])
                if end - start in self.by_length:
                    keys, scores, ids = self.by_length[end - start]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[at] == h
                    if end - start == 1:
                        edge[start, end] = np.where(hit, scores[at], self.unknown), np.where(hit, ids[at], -2)
                    elif hit.any():
                        edge[start, end] = np.where(hit, scores[at], -np.inf), ids[at]
        fore, back = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        fore[0] = back[size] = 0
        came, by = np.zeros((size + 1, n), np.int8), np.zeros((size + 1, n), np.int32)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                if (start, end) in edge:
                    s, ids = edge[start, end]
                    x = fore[start] + s
                    better = x > fore[end]
                    fore[end][better], came[end][better], by[end][better] = x[better], start, ids[better]
        for start in range(size - 1, -1, -1):
            for end in range(start + 1, min(size, start + self.longest) + 1):
                if (start, end) in edge:
                    np.maximum(back[start], edge[start, end][0] + back[end], out=back[start])
        best, rows = np.full((size + 1, n), -1, np.int8), np.arange(n)  # start of the best path's piece that ends here
        at = np.full(n, size)
        while len(rows):
            prev = came[at, rows]
            best[at, rows] = prev
            rows, at = rows[prev > 0], prev[prev > 0]
        # the best path through an edge that the best path hasn't
        second = np.full(n, -np.inf)
        for (start, end), (s, _) in edge.items():
            np.maximum(second, np.where(best[end] == start, -np.inf, fore[start] + s + back[end]), out=second)
        return fore[size], fore[size] - second, np.where(best >= 0, by, -1)[1:].T

    def merge(self, base: float, options: list, n: int) -> list[tuple[float, dict[int, int]]]:
        """The n best (score, rank of the path at each place that isn't the best). options: (place, its paths)."""
        start = (0,) * len(options)
        agenda, seen, out, tie = [(-base, 0, start)], {start}, [], count(1)
        while agenda and len(out) < n:
            f, _, ranks = heapq.heappop(agenda)
            out.append((-f, {options[k][0]: r for k, r in enumerate(ranks) if r}))
            for k, r in enumerate(ranks):
                paths = options[k][1]
                nxt = (*ranks[:k], r + 1, *ranks[k + 1 :])
                if r + 1 < len(paths) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (f + paths[r][0] - paths[r + 1][0], next(tie), nxt))
        return out

    def units(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where units start, texts beginning at off[:-1]."""
        space, joined = codes == ord(SPACE), self.joined[codes]
        begins = ~(space | joined)  # a character that stands alone
        begins[1:] |= begins[:-1].copy()  # and what follows it
        begins[1:] |= space[1:] & ~space[:-1]
        begins[off[:-1][off[:-1] < len(codes)]] = True
        return np.flatnonzero(begins)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes, and how many each has."""
        size = self.n_bytes[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(int(size.sum())) + np.repeat(self.byte_at[ids] - ends + size, size)], size

    def n_best(self, texts: list[str], n: int = N_BEST):
        """(ids of each of the n best, their scores, whether the best decodes to the text) of each text."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        start = self.units(codes, off)
        end = np.append(start[1:], len(codes))
        _, first, which = np.unique(span_hash(prefix_hash(codes), start, end), return_index=True, return_inverse=True)
        score, loss, flat, number = self.survey(codes, start[first], end[first])
        at = np.cumsum(number) - number
        sizes = number[which]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(int(sizes.sum())) + np.repeat(at[which] - ends + sizes, sizes)]
        bounds = np.searchsorted(start, off)
        raw, n_bytes = self.decode(ids)
        raw_ends = np.concatenate([[0], np.cumsum(n_bytes)])
        ends = np.concatenate([[0], ends])
        losses, scores = loss[which], score[which]
        for k, text in enumerate(texts):
            a, b = bounds[k], bounds[k + 1]
            own = ids[ends[a] : ends[b]]
            if a == b:
                yield [own], [0.0], True
                continue
            few = self._least(losses[a:b], min(n - 1, b - a))
            options = [(int(p), self.search(self.string(codes, start[a + p], end[a + p]), n)) for p in few if np.isfinite(losses[a + p])]
            best, paths, found = self.merge(float(scores[a:b].sum()), options, n), [own], dict(options)
            for _, moved in best[1:]:
                parts, done = [], ends[a]
                for p, r in sorted(moved.items()):
                    unit = self.string(codes, start[a + p], end[a + p])
                    parts += [ids[done : ends[a + p]], np.array(self.spell(unit, found[p][r][1]), np.int64)]
                    done = ends[a + p + 1]
                paths.append(np.concatenate([*parts, ids[done : ends[b]]]))
            said = raw[raw_ends[ends[a]] : raw_ends[ends[b]]].tobytes()
            yield paths, [score for score, _ in best], said[1:] == text.encode("utf-8", "replace")

    @staticmethod
    def _least(own: np.ndarray, few: int) -> np.ndarray:
        """Places of the `few` smallest, ties by place."""
        at = np.flatnonzero(own <= np.partition(own, few - 1)[few - 1])
        return at[np.argsort(own[at], kind="stable")][:few]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _nested(ids: list[list[np.ndarray]]) -> pa.Array:
    """Lists of lists of ids as an Arrow column."""
    flat = [path for paths in ids for path in paths]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    values = pa.array(np.concatenate([np.zeros(0, np.int64), *flat]), pa.int32())
    return pa.ListArray.from_arrays(ends([len(paths) for paths in ids]), pa.ListArray.from_arrays(ends([len(path) for path in flat]), values))


def encode_n_best(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """A row of ENCODED for each document: the ids of the n best segmentations (fewer where there are no more), best first, and their scores."""
    path = path or model_path()
    arrow_batches(docs.sparkSession)

    def rows(it):
        pieces = pieces_of(path)
        for batch in it:
            for i, j in steps(column_bytes(batch.column(1))[1], BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                found, scores, same = zip(*pieces.n_best(texts, n), strict=True)
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [batch.column(0).slice(i, j - i), sizes, pa.array(same), _nested(list(found)), pa.array(scores, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "decoded", "ids", "scores"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(rows, ENCODED)


def decode(encoded: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids (array<int>); null or no ids: an empty text."""
    path = path or model_path()
    arrow_batches(encoded.sparkSession)

    def rows(it):
        pieces = pieces_of(path)
        for batch in it:
            texts = [pieces.decode(np.array(ids or [], np.int64))[0].tobytes()[1:].decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("array<int>").alias("ids")).mapInArrow(rows, "doc_id long, text string")


def _digests(it):
    """Of rows of ENCODED, digests of the best and the second-best ids (little-endian unsigned 32-bit)."""
    names = ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded", "n_best", "scores", "second_sha256"]
    for batch in it:
        doc_id, n_chars, decoded, ids, scores = batch.columns
        of, ends, flat = ids.offsets.to_numpy(), ids.values.offsets.to_numpy(), ids.values.values.to_numpy().astype("<u4")
        sha = lambda k: hashlib.sha256(flat[ends[k] : ends[k + 1]].tobytes()).hexdigest()
        best, second = [sha(k) for k in of[:-1]], [sha(k + 1) if end > k + 1 else None for k, end in zip(of[:-1], of[1:], strict=True)]
        n_pieces, n_best = pa.array((ends[of[:-1] + 1] - ends[of[:-1]]).astype(np.int64)), pa.array(np.diff(of).astype(np.int64))
        yield pa.RecordBatch.from_arrays([doc_id, n_chars, n_pieces, pa.array(best, pa.string()), decoded, n_best, scores, pa.array(second, pa.string())], names)


def op3_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_n_best(table(spark, sf_dir, "documents")).mapInArrow(_digests, DIGESTS)
