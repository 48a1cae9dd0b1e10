"""Main-text extraction by a linear-chain conditional random field over a page's DOM leaf blocks.

A page is cut into leaf blocks: the text between block-level tags, with the tags and class or id words of its ancestors.
A block's features are those, its own tag, and its text's length, links, marks and place; labels are main and other. The
CRF is trained on labelled pages (html_pages, TRAIN_PAGES of them from a fixed seed: no table's rows) by Adagrad on the
exact log-likelihood, by forward-backward; pages are decoded by Viterbi. Training takes place once, on the driver; its
few thousand weights go out with the tasks, and nothing is shuffled or collected.

Character references are decoded as HTML5 does; white space inside a block becomes one space; <br> counts as white space.
Comments, scripts, styles, templates and form controls' values have no blocks.

Cases: null or empty html, or a page without main blocks: text '' and n_chars 0. Unclosed tags, comments and scripts end
with the page. Plain text without tags is one block. All ancestors make features, however deep the page. Rows that repeat
give rows that repeat; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_pages import labelled_pages
from .shared import arrow_batches, table

TRAIN_PAGES, EPOCHS, RATE, DECAY = 700, 6, 0.3, 1e-4

#: Attributes of a tag: a quoted value behind "=" may hold ">"; a quote that is never closed is like any other character.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe)\b{ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRS})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _path_key(tag: str, attrs: str) -> tuple[str, ...]:
    names = []
    if "=" in attrs:
        for m in NAMED.finditer(attrs):
            names += NAME_WORD.findall((m[1] or m[2] or m[3] or "").lower())
    return (tag, *sorted(set(names)))


class _Place:
    """Where a block stands: features of all its ancestors, the innermost tag, and how many there are (html and body don't count)."""

    __slots__ = ("tag", "found", "own", "deep")

    def __init__(self, tag: str = "", found: frozenset = frozenset(), own: str = "", deep: int = 0):
        self.tag, self.found, self.own, self.deep = tag, found, own, deep

    def inside(self, key: tuple[str, ...], known: frozenset | None) -> _Place:
        plain = key[0] not in ("html", "body")
        return _Place(key[0], _grown(self.found, key, known), key[0] if plain else self.own, self.deep + plain)


@lru_cache(maxsize=50_000)
def _grown(found: frozenset, key: tuple[str, ...], known: frozenset | None) -> frozenset:
    """With the features of one more ancestor: of those known only, so that a set is no larger than a model, however deep it is."""
    tag, *words = key
    new = {f"name:{w}" for w in words} | {f"{tag}.{w}" for w in words}
    if tag not in ("html", "body"):
        new.add(f"in:{tag}")
    new = {f for f in new if f not in found and (known is None or f in known)}
    return found | new if new else found


#: Open elements that an end tag on the right doesn't reach over.
WALLS, BEHIND = ("table", "article", "body"), frozenset(("p", "li", "td", "tr"))


def blocks(page: str, known: frozenset | None = None) -> list[tuple[str, _Place, int]]:
    """(text, place, characters in links) of each leaf block, in page order. known: features to keep, all unless given."""
    out: list[tuple[str, _Place, int]] = []
    root = _Place()
    stack: list[_Place] = []
    parts: list[str] = []
    inline: list[_Place] = []
    links = [0, 0]  # open <a>, characters inside
    held = root
    opened: dict[str, list[int]] = {}  # places in the stack of open elements, by tag

    def innermost() -> _Place:
        return inline[-1] if inline else stack[-1] if stack else root

    def close(k: int):
        for place in stack[k:]:
            opened[place.tag].pop()
        del stack[k:]

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, held, min(links[1], len(text))))
        links[1] = 0

    def pop(tag: str) -> bool:
        if not opened.get(tag):
            return False
        k = opened[tag][-1]
        if tag in BEHIND and any(opened[w][-1] > k for w in WALLS if opened.get(w)):
            return False
        close(k)
        return True

    def text_at(a: int, b: int):
        nonlocal held
        if b > a:
            chunk = page[a:b]
            if "&" in chunk:
                chunk = entities.unescape(chunk)
            if not parts and chunk.strip():
                held = innermost()
            if parts or chunk.strip():
                parts.append(chunk)
                if links[0]:
                    links[1] += len(chunk)

    at = 0
    for m in TOKEN.finditer(page):
        text_at(at, m.start())
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ") if parts else None
            elif tag == "a":
                links[0] = 0 if m[2] else 1
            elif tag in ("span", "label"):
                if m[2]:
                    del inline[-1:]
                else:
                    inline.append(innermost().inside(_path_key(tag, m[4]), known))
            continue
        flush()
        inline.clear()
        if m[2]:
            if pop(tag):
                links[0] = 0
        else:
            if stack and stack[-1].tag == "p":
                close(-1)
            for open_tag in ENDS.get(tag, ()):
                if stack and stack[-1].tag == open_tag:
                    close(-1)
            if tag not in VOID:
                opened.setdefault(tag, []).append(len(stack))
                stack.append(innermost().inside(_path_key(tag, m[4]), known))
    text_at(at, len(page))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _in_order(found: frozenset) -> tuple[str, ...]:
    return tuple(sorted(found))


def features(page_blocks: list[tuple[str, _Place, int]]) -> list[tuple[str, ...]]:
    n, out = len(page_blocks), []
    for k, (text, place, linked) in enumerate(page_blocks):
        size = len(text)
        out.append(
            (
                *_in_order(place.found),
                f"own:{place.own}",
                f"deep:{min(place.deep, 5)}",
                f"len:{min(size.bit_length(), 10)}",
                f"link:{4 * linked // max(1, size)}",
                f"end:{text[-1] if text[-1] in '.!?:,' else ''}",
                f"mark:{'©' in text}",
                f"place:{4 * k // n}",
                "bias",
            )
        )
    return out


class Crf:
    """Two labels (1: main). weight: of each feature for main over other; move[a][b]: from label a to b; first: of starting in main."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self.first = 0.0
        self._known: frozenset | None = None

    def known(self) -> frozenset:
        """The features that have a weight; of others nothing depends on."""
        if self._known is None or len(self._known) != len(self.weight):
            self._known = frozenset(self.weight)
        return self._known

    def emissions(self, feats) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in fs]) for fs in feats]

    def viterbi(self, e: list[float]) -> list[int]:
        (m00, m01), (m10, m11) = self.move
        a, b, back = 0.0, self.first + e[0], []
        for x in e[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + x
        y = [1 if b > a else 0]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]

    def marginals(self, e: list[float]):
        """P(main) of each block and the expected counts of each move."""
        n, move = len(e), np.array(self.move)
        up = np.zeros((n, 2))
        up[0] = 0.0, self.first + e[0]
        for t in range(1, n):
            up[t] = np.logaddexp(up[t - 1, 0] + move[0], up[t - 1, 1] + move[1])
            up[t, 1] += e[t]
        down = np.zeros((n, 2))
        for t in range(n - 2, -1, -1):
            nxt = down[t + 1] + np.array([0.0, e[t + 1]])
            down[t] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
        z = np.logaddexp(*up[-1])
        moves = np.zeros((2, 2))
        if n > 1:
            right = down[1:] + np.stack([np.zeros(n - 1), np.array(e[1:])], axis=1)
            moves = np.exp(up[:-1, :, None] + move[None] + right[:, None, :] - z).sum(axis=0)
        return np.exp(up[:, 1] + down[:, 1] - z), moves

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]]) -> Crf:
        seen: dict[str, float] = {}
        seen_move, seen_first = np.full((2, 2), 1e-6), 1e-6
        rng = np.random.default_rng(5)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(pages)):
                feats, labels = pages[i]
                p, moves = self.marginals(self.emissions(feats))
                grad: dict[str, float] = {}
                for fs, y, q in zip(feats, labels, p, strict=True):
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + y - q
                for f, g in grad.items():
                    w = self.weight.get(f, 0.0)
                    g -= DECAY * w
                    seen[f] = seen.get(f, 1e-6) + g * g
                    self.weight[f] = w + RATE * g / seen[f] ** 0.5
                real = np.zeros((2, 2))
                np.add.at(real, (labels[:-1], labels[1:]), 1)
                g = real - moves
                seen_move += g * g
                self.move = (np.array(self.move) + RATE * g / np.sqrt(seen_move)).tolist()
                g1 = labels[0] - p[0]
                seen_first += g1 * g1
                self.first += RATE * g1 / seen_first**0.5
        return self


def label_page(page: str, texts: list[str]) -> tuple[list, list[int]]:
    """A page's blocks and their labels: main where the text is one of `texts`."""
    found, main = blocks(page), {" ".join(t.split()) for t in texts}
    return found, [int(b[0] in main) for b in found]


@lru_cache(maxsize=1)
def model() -> Crf:
    pages = []
    for page, texts in labelled_pages(TRAIN_PAGES):
        found, labels = label_page(page, texts)
        if found:
            pages.append((features(found), labels))
    return Crf().fit(pages)


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page, crf.known()) if page else []
    if not found:
        return ""
    labels = crf.viterbi(crf.emissions(features(found)))
    return "\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def html_extract(pages: DataFrame) -> DataFrame:
    arrow_batches(pages.sparkSession)
    crf = model()  # a few thousand weights

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, crf) for h in html])

    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
