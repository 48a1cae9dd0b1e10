"""Sets of word shingles as 64-bit hashes, in numpy, over whole texts."""

from __future__ import annotations

import numpy as np

from .shared import LOWER, mix, prefix_hash, span_hash, words

WORDS = 5


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets, each sorted, and their bounds (n + 1). Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.

    Fewer than WORDS words: the whole sequence is one shingle; no words: the set is empty.
    """
    start, end, row = words(raw, off)
    n = len(off) - 1
    word = span_hash(prefix_hash(LOWER[raw]), start, end)
    number = np.bincount(row, minlength=n)
    before = np.cumsum(number) - number
    width = np.minimum(number, WORDS)
    held = np.where(number > 0, number - width + 1, 0)  # shingles of each row
    bounds = np.concatenate([[0], np.cumsum(held)])
    of = np.repeat(np.arange(n), held)
    first = np.arange(bounds[-1]) - bounds[of] + before[of]
    h = mix(width[of].astype(np.uint64) + np.uint64(0x51ED2701))
    for k in range(WORDS):
        inside = k < width[of]
        at = np.minimum(first + k, max(0, len(word) - 1))
        h = np.where(inside, mix(h + word[at] * np.uint64(2 * k + 3)), h) if len(word) else h
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def digests(h: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit digest of each set; equal sets have equal digests."""
    place = (np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    terms = mix(h + (place + np.uint64(1 + (seed << 40))) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
