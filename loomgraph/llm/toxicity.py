"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy, with thresholds calibrated by language.

A word (a run of ASCII letters and non-ASCII bytes, A-Z lower-cased) is the sum of the embeddings of its hash and of its
first 3, 4, 5 and 6 bytes' hashes. FILTERS filters of each width in WIDTHS slide over a document's words; the largest
response of each over the whole text goes through a rectifier to a logistic output. Trained on the driver by Adagrad over
a bounded sample: of the labelled documents of at most SAMPLE_CHARS characters, at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN
clean ones, the first by the hash of doc_id. A fifth of the sample (again by hash) trains nothing: on it the output is
calibrated, so that a score of LIMIT stands where the F1 measure of the toxic class is highest, and its steepness fits the
rows. Scoring runs over every whole text. Each language's threshold is set on all labelled documents outside the fitting
part, of any length, from counts of scores by language, bin and label. Where the sample is too small to hold a fifth back
(40 rows, both classes), the rows that it was fitted to calibrate too.

The score's only input is the text. `toxic` is score >= the language's threshold; languages with fewer than MIN_ROWS
calibration rows of a class have the threshold of all languages together.

Cases: null and empty texts have a score too (that of no words). A very long text is scored whole, in one step. Labels
that are null, or that stand beside no document, teach nothing (of several labels of a document the greatest, of several
texts of an id one); without labels of both classes every score is 0. Rows that repeat get equal scores. A null doc_id is
never held out. An empty table gives no rows. Extra columns stay as they are; clashing names are the caller's: results replace `score`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, arrow_batches, column_bytes, discard, materialize, mix, prefix_hash, row_key, span_hash, steps, table

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_000, 5_000, 20_000
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 18, 8, 10, (1, 2, 3), (3, 4, 5, 6)
#: Epochs over a full sample; smaller samples are gone over oftener, up to MOST_EPOCHS.
EPOCHS, MOST_EPOCHS, BATCH, RATE = 8, 60, 48, 0.15
#: Share of words whose whole-word embedding is left out in a training step, so that prefixes learn too.
DROPPED = 0.5
MIN_ROWS = 20
#: Bins of scores that thresholds lie between.
BINS = 1000
#: The contract's limit for `predicted`.
LIMIT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (whole word, then PREFIXES), BUCKETS for none; and the rows' word offsets (n + 1)."""
    letter = _LETTER[raw]
    first, last = letter.copy(), letter.copy()
    if len(raw):
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        first[cut] |= letter[cut]
        last[cut - 1] |= letter[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = prefix_hash(LOWER[raw])
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = mix(span_hash(prefix, start, end) + np.uint64(77)) % np.uint64(BUCKETS)
    for k, size in enumerate(PREFIXES, 1):
        has = end - start > size
        out[:, k] = BUCKETS
        out[has, k] = span_hash(prefix, start[has], start[has] + size) % np.uint64(BUCKETS)
    return out, np.searchsorted(start, off)


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    prior: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    fitted: list[int] = field(default_factory=list)  # doc_ids that play no part in calibration

    def pooled(self, feats: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters' largest responses by document, where they begin (word + padding), and the padded embeddings."""
        pad = max(WIDTHS)
        n = len(off) - 1
        size = np.diff(off)
        begin = off[:-1] + pad * np.arange(n)
        x = np.zeros((len(feats) + pad * (n + 1), DIM), np.float32)
        at = np.arange(len(feats)) + np.repeat(pad * np.arange(n), size)
        # a word that comes again is looked up once
        code, back = np.unique(mix(feats.astype(np.uint64) @ np.array([1, 3 << 20, 5 << 33, 7 << 41, 11 << 50], np.uint64)), return_index=True, return_inverse=True)[1:]
        vec = self.embed[feats[code]].sum(axis=1)
        x[at] = vec[back]
        best, where = [], []
        for w in WIDTHS:
            kernel = self.filters[w]
            r = np.zeros((len(x), FILTERS), np.float32)
            for k in range(w):
                r[: len(x) - k] += x[k:] @ kernel[k * DIM : (k + 1) * DIM]
            # windows that begin in the document or right behind it, so that an empty one has a window too
            best.append(np.maximum.reduceat(r, np.stack([begin, begin + size + 1], axis=1).reshape(-1), axis=0)[::2])
            where.append(r)
        return np.concatenate(best, axis=1), where, begin

    def logits(self, feats: np.ndarray, off: np.ndarray) -> np.ndarray:
        pooled, _, _ = self.pooled(feats, off)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, feats: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.logits(feats, off) * self.scale + self.prior
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _fit(texts: list[str], labels: np.ndarray) -> Model:
    rng = np.random.default_rng(7)
    width = FILTERS * len(WIDTHS)
    embed = np.zeros((BUCKETS + 1, DIM), np.float32)
    embed[:-1] = rng.normal(0, 0.02, (BUCKETS, DIM))
    m = Model(embed, {w: rng.normal(0, 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(width, np.float32), rng.normal(0.3, 0.3, width).astype(np.float32), -1.0)
    docs = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        docs.append(features(raw, np.array([0, len(raw)]))[0])
    seen = {k: np.full_like(v, 1e-4) for k, v in {"embed": m.embed, "bias": m.bias, "out": m.out, **m.filters}.items()}
    seen_shift = 1e-4
    weight = np.where(labels == 1, len(labels) / 2 / max(1, labels.sum()), len(labels) / 2 / max(1, (1 - labels).sum()))

    def step(name, param, grad, rows=None):
        if rows is None:
            seen[name] += grad * grad
            param -= RATE * grad / np.sqrt(seen[name])
        else:
            seen[name][rows] += grad * grad
            param[rows] -= RATE * grad / np.sqrt(seen[name][rows])

    for _ in range(min(MOST_EPOCHS, max(EPOCHS, EPOCHS * (SAMPLE_TOXIC + SAMPLE_CLEAN) // max(1, len(docs))))):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            feats = np.concatenate([docs[i] for i in pick])
            off = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
            feats[rng.random(len(feats)) < DROPPED, 0] = BUCKETS
            pooled, responses, begin = m.pooled(feats, off)
            hidden = np.maximum(pooled + m.bias, 0)
            z = hidden @ m.out + m.shift
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = dz[:, None] * m.out * (hidden > 0)
            ends = begin + np.diff(off) + 1
            rows_all, grads_all = [], []
            for wi, w in enumerate(WIDTHS):
                cols = slice(wi * FILTERS, (wi + 1) * FILTERS)
                g = dh[:, cols]
                arg = np.stack([begin[d] + responses[wi][begin[d] : ends[d]].argmax(axis=0) for d in range(len(pick))])
                kernel, dk = m.filters[w], np.zeros_like(m.filters[w])
                for k in range(w):
                    word = arg + k - begin[:, None]  # in its document; beyond its end: padding
                    inside = word < (off[1:] - off[:-1])[:, None]
                    idx = np.minimum(word, np.maximum((off[1:] - off[:-1])[:, None] - 1, 0)) + off[:-1][:, None]
                    if not len(feats):
                        continue
                    f = feats[np.minimum(idx, len(feats) - 1)]  # docs x filters x features
                    gi = np.where(inside, g, 0)
                    x = m.embed[f].sum(axis=2)
                    dk[k * DIM : (k + 1) * DIM] = np.einsum("dfk,df->kf", x, gi)
                    gx = gi[:, :, None] * kernel[k * DIM : (k + 1) * DIM].T[None]
                    live = gi != 0
                    rows_all.append(f[live])
                    grads_all.append(gx[live])
                step(w, kernel, dk)
            if rows_all:
                rows = np.concatenate(rows_all)
                grads = np.repeat(np.concatenate(grads_all)[:, None, :], rows.shape[1], axis=1).reshape(-1, DIM)
                rows, back = np.unique(rows.reshape(-1), return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, back, grads)
                real = rows < BUCKETS
                step("embed", m.embed, total[real], rows[real])
            step("out", m.out, hidden.T @ dz)
            step("bias", m.bias, dh.sum(axis=0))
            seen_shift += float(dz.sum()) ** 2
            m.shift -= RATE * float(dz.sum()) / seen_shift**0.5
    return m


def _score_texts(m: Model, texts: list[str], raw_logits: bool = False) -> np.ndarray:
    out = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        f, off = features(raw, np.array([0, len(raw)]))
        out.append((m.logits if raw_logits else m.scores)(f, off)[0])
    return np.array(out)


def _cut(counts: dict[tuple[int, int], float]) -> float:
    """Between which bins of scores fewest (weighted) rows, by (bin, label), are on the wrong side; the middle of the gap there."""
    bins = sorted({k for k, _ in counts}, reverse=True)
    toxic, clean = (np.array([counts.get((k, y), 0.0) for k in bins]) for y in (1, 0))
    wrong = np.concatenate([[0], np.cumsum(clean - toxic)]) + toxic.sum()
    k = int(wrong.argmin())
    high = bins[k - 1] / BINS if k else 1.0
    low = (bins[k] + 1) / BINS if k < len(bins) else 0.0
    return float(min(0.95, max(0.05, (high + low) / 2)))


def _middle(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between outputs from which on the F1 measure of the toxic class is highest."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.concatenate([[0], np.cumsum(y)])
    f1 = 2 * hits / (np.arange(len(hits)) + max(1, y.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = int(best[-1])
    return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)


def _teaching(labels: DataFrame, learn: Column | None) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    return rows if learn is None else rows.where(learn)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    """learn: which label rows may teach (a condition on doc_id). None without labels of both classes."""
    rows = _teaching(labels, learn)
    arrow_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    known = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(text.select("doc_id"), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = materialize(picked[0].unionByName(picked[1]))  # SAMPLE_TOXIC + SAMPLE_CLEAN ids at most
    got = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    discard(sample)
    y = np.array([r["toxic"] for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    texts = [r["text"] or "" for r in got]
    held = np.arange(len(y)) % 5 == 4
    if held.sum() < 40 or len(np.unique(y[held])) < 2:
        held_fit, held = np.zeros(len(y), bool), np.ones(len(y), bool)
    else:
        held_fit = held
    m = _fit([t for t, h in zip(texts, held_fit, strict=True) if not h], y[~held_fit])
    z, yh = _score_texts(m, [t for t, h in zip(texts, held, strict=True) if h], True), y[held]
    middle, share = _middle(z, yh), np.where(yh == 1, 0.5 / max(1, yh.sum()), 0.5 / max(1, (1 - yh).sum()))
    base = float(np.log(LIMIT / (1 - LIMIT)))
    loss = lambda s: float((share * np.logaddexp(0, -(2 * yh - 1) * ((z - middle) * s + base))).sum())
    m.scale = min((float(s) for s in np.geomspace(0.1, 8, 32)), key=loss)
    m.prior = base - m.scale * middle
    if held_fit.any():
        m.fitted = sorted({r["doc_id"] for r, h in zip(got, held_fit, strict=True) if not h})
    return m


def calibrate(m: Model, scored: DataFrame, labels: DataFrame, learn: Column | None = None) -> None:
    """Sets the thresholds on all labelled documents that the model wasn't fitted to, by counts of their scores. scored: doc_id, lang, score."""
    spark = scored.sparkSession
    rows = _teaching(labels, learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    slim = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    ids = F.explode(F.split(F.lit(" ".join(map(str, m.fitted)) or "-"), " "))  # bounded by the sample
    fitted = spark.range(1, numPartitions=1).select(ids.alias("id")).select(F.col("id").try_cast("long").alias("doc_id"), F.lit(True).alias("fitted"))
    slim = slim.join(rows, "doc_id").join(F.broadcast(fitted), "doc_id", "left").withColumn("fitted", F.col("fitted").isNotNull())
    counts = materialize(slim.groupBy("lang", "bin", "toxic", "fitted").agg(F.count(F.lit(1)).alias("n")))
    every = counts.groupBy("bin", "toxic", "fitted").agg(F.sum("n").alias("n")).collect()  # 4 * BINS rows at most
    # the fitting part was drawn by class: rows outside it stand for their whole class
    weight = {y: sum(r["n"] for r in every if r["toxic"] == y) / max(1, sum(r["n"] for r in every if r["toxic"] == y and not r["fitted"])) for y in (0, 1)}
    m.threshold = _cut({(r["bin"], r["toxic"]): r["n"] * weight[r["toxic"]] for r in every if not r["fitted"]})
    free = counts.where("not fitted")
    enough = free.groupBy("lang").agg(*(F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1))).where(f"least(n0, n1) >= {MIN_ROWS}")
    own: dict[str, dict[tuple[int, int], float]] = {}
    for r in free.join(enough.select("lang"), "lang").select("lang", "bin", "toxic", "n").collect():  # 2 * BINS rows a language at most
        own.setdefault(r["lang"], {})[r["bin"], r["toxic"]] = r["n"] * weight[r["toxic"]]
    m.thresholds = {lang: _cut(c) for lang, c in own.items()}
    discard(counts)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents' columns with `score` (0 to 1)."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS x DIM floats

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        raw, off = column_bytes(pa.array(texts, pa.large_string()))
        out = np.empty(len(texts))
        for i, j in steps(off):
            out[i:j] = held.value.scores(*features(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
        return pd.Series(out)

    return docs.withColumn("score", of(F.col("text")))


def threshold_of(model: Model | None, lang: Column) -> Column:
    out = F.lit(model.threshold if model else 2.0)
    for name, limit in sorted((model.thresholds if model else {}).items()):
        out = F.when(lang == name, F.lit(limit)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """The documents' columns with `score` and `toxic`. Each text is scored once: the scored rows are a table that calibration reads by its slim columns."""
    model = train(docs, labels, learn)
    scored = score(docs, model)
    if model is not None:
        scored = materialize(scored)
        calibrate(model, scored, labels, learn)
    return scored.withColumn("toxic", F.col("score") >= threshold_of(model, F.coalesce(F.col("lang"), F.lit(""))))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their columns as they came.

    Each text is scored once, into a slim table; what stays in the scratch folder are the keys of the rows that go.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    k1, k2 = row_key()
    lang = F.coalesce("lang", F.lit(""))  # rows alike in id and text may be of languages with different thresholds
    scored = materialize(score(docs.select(k1, k2, "doc_id", lang.alias("lang"), "text"), model).drop("text"))
    calibrate(model, scored, labels)
    gone = materialize(scored.where(F.col("score") >= threshold_of(model, F.col("lang"))).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("lang").alias("__lang")))
    discard(scored)
    return docs.join(gone, (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & (lang == F.col("__lang")), "left_anti")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels, fold(F.col("doc_id")) != 1))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
