"""Labelled pages that the block model of html_extract is trained on: made by rule from a seed, not taken from any table.

Each page is (html, texts of the main blocks). Layouts, tag names, class names, languages' letter shapes, lengths and the
order of the parts vary; main text may be short or hold links, and boilerplate may be long prose, so that a block's place
says more than its length.
"""

from __future__ import annotations

import random

#: Class or id words by the part that bears them. Fixed values.
NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "skip-link", "tabs"],
    "header": ["header", "site-header", "masthead", "banner", "branding", "top-bar", "logo"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "legal", "bottom", "foot-links"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "rail", "trending", "more-stories", "tags"],
    "notice": ["notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "paywall", "subscribe"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense", "sponsor", "promotion"],
    "form": ["form", "search", "newsletter", "login", "signup", "contact-form", "poll"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "reader-comments", "respond", "disqus", "feedback"],
    "share": ["share", "social", "follow", "share-buttons", "toolbar"],
    "main": ["content", "main", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "text", "article-text", "body-copy", "page-content", "main-content"],
    "wrap": ["wrapper", "container", "row", "col", "page", "inner", "layout", "grid", "site", "outer"],
}
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "p", "aside"], "ad": ["div", "aside", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}
SYLLABLES = ["an", "er", "tion", "the", "en", "ou", "ly", "st", "é", "ment", "que", "ü", "sch", "ung", "los", "ción", "ñ", "in", "ar", "ko", "ta", "mi", "re", "o", "a", "на", "ро", "文", "章"]


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _prose(r: random.Random, least: int = 1, most: int = 60) -> str:
    out, n = [], r.randint(least, most)
    while n > 0:
        k = min(n, r.randint(1, 18))
        s = [_word(r) for _ in range(k)]
        s[0] = s[0].capitalize()
        if k > 6 and r.random() < 0.5:
            s[k // 2] += ","
        out.append(" ".join(s) + r.choice(".....!?"))
        n -= k
    return " ".join(out)


def _label(r: random.Random) -> str:
    return " ".join(_word(r).capitalize() if r.random() < 0.5 else _word(r) for _ in range(r.randint(1, 4)))


def _attr(r: random.Random, part: str, always: bool = False) -> str:
    if not always and r.random() < 0.25:
        return ""
    name = r.choice(NAMES[part])
    if r.random() < 0.2:
        name += f" {r.choice(NAMES['wrap'])}"
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def _links(r: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_label(r)}</a></li>' for i in range(r.randint(2, 8))) + "</ul>"


def _part(r: random.Random, part: str) -> str:
    tag = r.choice(TAGS[part])
    plain = tag in ("div", "section", "p", "ul", "ol")
    attr = _attr(r, part, plain)
    if part in ("menu", "share"):
        body = _links(r) if tag != "ul" else _links(r)[4:-5]
    elif part in ("ad", "notice"):
        body = r.choice([_prose(r, 1, 40), f"<p>{_prose(r, 3, 40)}</p>", f'<a href="/x">{_label(r)}</a> {_prose(r, 1, 12)}', f"<span>{_label(r)}</span>"])
        if tag == "p":
            body = _prose(r, 2, 30)
    elif part == "form":
        body = f"<label>{_label(r)}</label><input type=text><select><option>{_label(r)}</option><option>{_label(r)}</option></select><button>{_label(r)}</button>" + (f"<p>{_prose(r, 2, 15)}</p>" if r.random() < 0.5 else "")
        if tag == "div":
            body = f"<form>{body}</form>"
    elif part == "comments":
        item = "li" if tag in ("ol", "ul") else "div"
        body = ("" if item == "li" else f"<h3>{_label(r)}</h3>") + "".join(f"<{item}{_attr(r, 'comments')}><b>{_label(r)}</b><p>{_prose(r, 2, 60)}</p></{item}>" for _ in range(r.randint(1, 5)))
    elif part == "side":
        body = f"<h3>{_label(r)}</h3>" + r.choice([_links(r), f"<p>{_prose(r, 3, 50)}</p>", f"<p>{_prose(r, 3, 20)}</p>" + _links(r)])
    elif part == "header":
        body = r.choice([f"<h1>{_label(r)}</h1><p>{_prose(r, 2, 10)}</p>", f'<a href="/">{_label(r)}</a>', f"<div>{_label(r)}</div>" + _links(r)])
    else:
        body = r.choice([f"&copy; {_label(r)} &middot; {_prose(r, 1, 15)}", f"<p>&copy; {r.randint(1990, 2025)} {_label(r)}</p>" + _links(r), f"<p>{_prose(r, 2, 40)}</p>"])
    return f"<{tag}{attr}>{body}</{tag}>"


def _main(r: random.Random) -> tuple[str, list[str]]:
    texts, out = [], []

    def put(tag: str, text: str, inner: str | None = None):
        if inner is None and r.random() < (0.6 if tag[0] == "h" else 0.25):  # cut short, or ending in any mark
            text = text[: r.randint(max(1, len(text) - 6), len(text))].rstrip(" .!?") + r.choice(["", "", "", "|", "&amp;", "%", "*", ",", ":", ")"])
        texts.append(text.replace("&amp;", "&"))
        out.append(f"<{tag}>{inner or text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.9 else ""))

    if r.random() < 0.85:
        put(r.choice(["h1", "h1", "h2"]), _prose(r, 1, 12))
    for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
        kind = r.random()
        if kind < 0.62:
            text = _prose(r, 1, r.choice((3, 12, 60, 120)))
            if r.random() < 0.15:
                head, _, tail = text.partition(" ")
                put("p", text, f'<a href="/y">{head}</a> {tail}' if tail else f"<b>{head}</b>")
            elif r.random() < 0.15:
                put("p", text, f"<b>{text}")
            else:
                put("p", text)
        elif kind < 0.72:
            put(r.choice(["h2", "h3", "h4"]), _prose(r, 1, 6))
        elif kind < 0.8:
            out.append(tag := r.choice(["<ul>", "<ol>"]))
            for _ in range(r.randint(1, 5)):
                put("li", _prose(r, 1, 15))
            out.append(tag.replace("<", "</"))
        elif kind < 0.85:
            put("blockquote", _prose(r, 3, 40))
        elif kind < 0.89:
            out.append("<table><tr>")
            for _ in range(r.randint(2, 6)):
                put("td", _prose(r, 1, 5))
            out.append("</tr></table>")
        elif kind < 0.92:
            put("pre", _prose(r, 2, 20))
        elif kind < 0.96:
            out.append(_part(r, "ad"))
        else:
            out.append(_part(r, r.choice(["share", "side", "notice", "form"])))
    return "".join(out), texts


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    r, pages = random.Random(seed), []
    bare_pages = random.Random(seed + 1)
    for _ in range(n):
        body, texts = _main(r)
        if r.random() < 0.12:
            body = body + _part(r, "comments")
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        bare = bare_pages.random()
        if bare < 0.04:  # a page of text alone
            pages.append((plain := _prose(bare_pages, 3, 80), [plain]))
            continue
        if bare < 0.16:  # an article right under the body
            tag = ""
        body = f"<{tag}{_attr(r, 'main', tag in ('div', 'section'))}>{body}</{tag}>" if tag else body
        for _ in range(r.choice((0, 0, 1, 2)) if tag else 0):
            wrap = r.choice(["div", "div", "main", "section"])
            side = _part(r, "side") if r.random() < 0.4 else ""
            body = f"<{wrap}{_attr(r, r.choice(('wrap', 'wrap', 'main')))}>{body}{side}</{wrap}>"
        before = "".join(_part(r, p) for p in ("header", "menu", "notice", "ad", "form", "menu") if r.random() < 0.45)
        after = "".join(_part(r, p) for p in ("comments", "side", "share", "form", "ad", "notice", "footer", "footer") if r.random() < 0.45)
        head = f"<head><meta charset=utf-8><title>{_prose(r, 1, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body>{before}<!-- {_label(r)} -->{body}{after}" + r.choice(["</body></html>", ""]), texts))
    return pages
