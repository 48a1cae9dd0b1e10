"""Suffix arrays by recursive induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Suffixes a bucket from which inducing goes bucket by bucket in numpy; smaller ones are gone through suffix by suffix.
BULK = 64


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one is not: what lies beyond the end is smallest."""
    n = len(text)
    out = np.zeros(n, bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        d = differs[at[inside]]
        out[:-1][inside] = text[d] < text[d + 1]
    return out


def _slots(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by kind, the place of each in its kind, the kinds, and how many each has."""
    order = np.argsort(kind, kind="stable").astype(np.int32)
    kinds, first, count = np.unique(kind[order], return_index=True, return_counts=True)
    return order, np.arange(len(kind)) - np.repeat(first, count), kinds, count


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from the order of the seeds (leftmost-smaller ones): larger ones from the left, smaller from the right.

    A bucket (suffixes of one first character) is gone through in waves: what it holds sends the suffixes one longer to
    their buckets, in order; what it sent to itself is the next wave.
    """
    n = len(text)
    end = np.cumsum(counts)
    start = end - counts
    out = np.full(n, -1, np.int32)
    order, rank, kinds, count = _slots(text[seeds])
    seed_from = end.copy()
    seed_from[kinds] -= count
    out[np.repeat(seed_from[kinds], count) + rank] = seeds[order]
    head = start.copy()
    out[head[text[-1]]] = n - 1
    head[text[-1]] += 1

    def send(block: np.ndarray, at: np.ndarray, smaller: bool) -> None:
        longer = block[block > 0] - 1
        longer = longer[small[longer] == smaller]
        if len(longer):
            order, rank, kinds, count = _slots(text[longer])
            base = np.repeat(at[kinds], count)
            out[base - 1 - rank if smaller else base + rank] = longer[order]
            at[kinds] += -count if smaller else count

    used = np.flatnonzero(counts)
    for c in used:
        at = start[c]
        while at < head[c]:
            block, at = out[at : head[c]], head[c]
            send(block, head, False)
        send(out[seed_from[c] : end[c]], head, False)
    tail = end.copy()
    for c in used[::-1]:
        at = end[c]
        while tail[c] < at:
            block, at = out[tail[c] : at][::-1], tail[c]
            send(block, tail, True)
        send(out[start[c] : head[c]][::-1], tail, True)
    return out


def _induce_singly(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same as _induce, suffix by suffix: for texts of many kinds, whose buckets hold few."""
    t, is_small, n = text.tolist(), small.tolist(), len(text)
    ends = np.cumsum(counts)
    head, tail, out = (ends - counts).tolist(), ends.tolist(), [-1] * n
    for i in reversed(seeds.tolist()):
        tail[t[i]] -= 1
        out[tail[t[i]]] = i
    out[head[t[-1]]] = n - 1
    head[t[-1]] += 1
    for i in out:  # grows as it is read
        if i > 0 and not is_small[i - 1]:
            c = t[i - 1]
            out[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = out[k]
        if i > 0 and is_small[i - 1]:
            c = t[i - 1]
            tail[c] -= 1
            out[tail[c]] = i - 1
    return np.array(out, np.int32)


def induced_sort(text: np.ndarray, kinds: int) -> np.ndarray:
    """The suffix array of text, whose values lie in 0..kinds - 1.

    A suffix is smaller (S) if it precedes the next one, else larger (L); leftmost-smaller positions are those S after L.
    Their substrings are sorted by inducing, then named; where names repeat, the text of names is sorted first.
    """
    text = np.asarray(text, np.int32)  # a shard has far fewer than 2**31 bytes
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(text, minlength=kinds)
    induce = _induce if n >= BULK * np.count_nonzero(counts) else _induce_singly
    order = induce(text, small, left, counts)
    if not len(left):
        return order
    place = np.full(n, -1, np.int32)
    place[left] = np.arange(len(left))
    found = order[place[order] >= 0]
    # a leftmost-smaller substring reaches to the next such position; the last one, to the end, is like no other
    size = np.append(left[1:], n + n) - left + 1
    a, b = found[:-1], found[1:]
    same = (size[place[a]] == size[place[b]]) & (b != left[-1]) & (a != left[-1])
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[k < size[place[a[live]]]]
    names = np.zeros(len(left), np.int32)
    names[place[found]] = np.concatenate([[0], np.cumsum(~same)])
    number = int(names.max()) + 1
    if number == len(left):
        ranked = np.empty(len(left), np.int32)
        ranked[names] = left
    else:
        ranked = left[induced_sort(names, number)]
    return induce(text, small, ranked, counts)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """data: small non-negative integers."""
    return induced_sort(data, int(data.max()) + 1 if len(data) else 1)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length (to `most`) that its suffix has in common with the one before it in the order.

    In order of position such lengths fall by one at most, so only irreducible ones (whose left neighbours differ from
    their predecessors' left neighbours) are compared; the rest follow.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int32), np.full(8, -1, np.int32)])
    at = np.arange(n, dtype=np.int32)
    start = (before < 0) | (at == 0) | (before == 0)
    inner = ~start
    start[inner] = data[at[inner] - 1] != data[before[inner] - 1]
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(start & (before >= 0))
    done = 0
    while len(live):  # eight characters at a time; their sum over irreducible positions is at most n log n
        step = np.arange(8)
        here, there = live + done, before[live] + done
        same = padded[here[:, None] + step] == padded[there[:, None] + step]
        k = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        k = np.minimum(k, n - np.maximum(here, there))  # what lies beyond the end matches nothing
        out[live] += k
        live = live[k == 8]
        done += 8
    lead = np.maximum.accumulate(np.where(start, at, -1))
    return np.minimum(most, np.maximum(0, out[lead] - (at - lead)))
