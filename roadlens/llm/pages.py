"""HTML extraction: a bidirectional LSTM labels each block of a page as main text or not, from all of the page's blocks.

Leaf blocks are read with hashed vectors of their tag path (tags and the words of class, id and role)
and of their words. The labeller is trained on the driver on pages laid out at random by rule, and on
a bounded sample of the given pages whose own sectioning tags say what is what.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadlens.llm.recurrent import Adam, bidirectional, bidirectional_back, init_cell, run, sigmoid

# Names of HTML.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title template noscript textarea iframe object svg math".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table td th ul ol dl article section aside main nav header footer form body html div".split())

_NAMED = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*+)")
#: The rest of a tag, up to a ``>`` that stands in no quotes.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")

PATH, WORDS, NUMBERS, HIDDEN = 256, 64, 8, 16
INPUTS = PATH + WORDS + NUMBERS


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attributes):
        out += [x.lower() for x in _NAME.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or ""))]
    return tuple(out)


# Names that tell parts beside the text, for pages whose own sectioning labels their blocks.
_OUT = frozenset("nav header footer aside form button select menu dialog label fieldset".split())
_OUT_NAMES = frozenset("ad ads advert advertisement sponsored promo cookie consent comment comments sidebar nav navigation menu footer header share social related notice newsletter subscribe".split())


class Block:
    """A run of text: ``path``, its hashed tag path; how deep it stands; characters that are links; and whether it is in an article and beside none of its parts."""

    __slots__ = ("path", "depth", "text", "linked", "within", "inside")

    def __init__(self, path: np.ndarray, depth: int, text: str, linked: int, within: bool, inside: bool):
        self.path, self.depth, self.text, self.linked, self.within, self.inside = path, depth, text, linked, within, inside


@lru_cache(1 << 16)
def _slot(token: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % size, 1 if h >> 31 else -1


class _Open:
    """The elements that are open, with the hashed sum of the distinct tags and names on the path, kept up as they open and close."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # where elements of a tag stand in the stack
        self.held: Counter[str] = Counter()
        self.sum, self.known = np.zeros(PATH, np.int16), {}
        self.articles = self.beside = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        tokens, out = (tag, *{f".{n}" for n in names}), tag in _OUT or not _OUT_NAMES.isdisjoint(names)
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, tokens, out))
        self.articles += tag in ("article", "main")
        self.beside += out
        for t in tokens:
            if not self.held[t]:
                slot, sign = _slot(t, PATH)
                self.sum[slot] += sign
            self.held[t] += 1

    def cut(self, place: int) -> None:
        """Closes all elements from ``place`` on."""
        while len(self.stack) > place:
            tag, tokens, out = self.stack.pop()
            self.at[tag].pop()
            self.articles -= tag in ("article", "main")
            self.beside -= out
            for t in tokens:
                self.held[t] -= 1
                if not self.held[t]:
                    slot, sign = _slot(t, PATH)
                    self.sum[slot] -= sign

    def last(self, tags) -> int:
        place, at = -1, self.at
        for t in tags:
            if t in at and at[t] and at[t][-1] > place:
                place = at[t][-1]
        return place

    def close(self, tags, within=()) -> None:
        """Closes the last element of ``tags``, and what it holds, unless one of ``within`` stands between."""
        place = self.last(tags)
        if place >= 0 and place > self.last(within):
            self.cut(place)

    def path(self) -> np.ndarray:
        out = self.sum.copy()
        if self.stack:
            slot, sign = _slot(f"leaf:{self.stack[-1][0]}", PATH)
            out[slot] += sign
        return self.known.setdefault(out.tobytes(), out)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: runs of text between block tags, with references decoded and white space folded. Scripts, styles and the like are left out.

    Takes time in proportion to the page, however malformed. A tag without an end is text. Where quotes
    in tags stay open, 16 times in a page, they count for nothing in the rest of it.
    """
    out: list[Block] = []
    now, parts, links = _Open(), [], []
    page, at, look, broken, endless = page or "", 0, 0, 0, set()
    closed = page.rfind(">")

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                out.append(Block(now.path(), len(now.stack), text, linked, now.articles > 0, now.articles > 0 and not now.beside))
            parts.clear()
            links.clear()

    def say(piece: str) -> None:
        if piece:
            parts.append(piece)
            if now.at["a"] and now.at["a"][-1] >= len(now.stack) - 4:
                links.append(piece)

    while True:
        start = page.find("<", look)
        if start < 0:
            break
        kind, tag, ends, attributes = page[start + 1 : start + 2], "", False, ""
        if kind in ("!", "?"):
            comment = page.startswith("<!--", start)
            end = page.find("-->", start + 4) + 3 if comment else page.find(">", start) + 1
            end = end if end > start else len(page)
            if comment and end == 2:
                end = len(page)
        else:
            m = _NAMED.match(page, start + 1)
            if not m or m.end() > closed:
                look = start + 1
                continue
            rest = _REST.match(page, m.end()) if broken < 16 else None
            if not rest:
                broken += 1
            end = rest.end() if rest else page.find(">", m.end()) + 1
            tag, ends, attributes = m[2].lower(), m[1] == "/", page[m.end() : end - 1]
        say(page[at:start])
        at = look = end
        if not tag:
            continue
        if tag in UNSEEN and not ends:
            if not attributes.rstrip().endswith("/"):
                found = None if tag in endless else _end_of(tag).search(page, at)
                if found:
                    at = look = found.end()
                else:
                    endless.add(tag)
                    at = look = len(page) if tag in ("script", "style") else at
            continue
        if tag in BREAKING:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ends:
            now.close((tag,), {"table", "body", "html"} - {tag})
        else:
            if tag in CLOSE_P:
                now.close(("p",), SCOPES)
            if tag in CLOSES:
                now.close(CLOSES[tag], SCOPES - CLOSES[tag])
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                now.push(tag, _names(attributes) if attributes else ())
    say(page[at:])
    flush()
    return out


@lru_cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def vectors(found: list[Block], first: int = 0, count: int | None = None) -> np.ndarray:
    """Inputs (blocks, INPUTS): hashed tag path, hashed words, all of them, and sizes. ``found`` stands at ``first`` of the page's ``count`` blocks."""
    x, total = np.zeros((len(found), INPUTS), np.float32), count or len(found)
    slots, signs, sizes, numbers = [], [], [], []
    for i, b in enumerate(found):
        x[i, :PATH] = b.path
        w = _WORD.findall(b.text.lower())
        for t in w:
            slot, sign = _slot(t, WORDS)
            slots.append(slot)
            signs.append(sign)
        n, count_of = len(b.text), b.text.count
        sizes.append(len(w))
        numbers.append(
            (
                len(w), b.linked / n, (count_of(".") + count_of(",") + count_of(";") + count_of(":") + count_of("!") + count_of("?")) / (1 + len(w)), b.text[-1] in ".!?…\"»”",
                (first + i) / total, (total - first - i) / total, min(b.depth, 12) / 12, "©" in b.text,
            )
        )
    if found:
        at = np.repeat(np.arange(len(found)), sizes) * WORDS + np.array(slots, dtype=np.int64)
        hashed = np.bincount(at, weights=signs, minlength=len(found) * WORDS).reshape(len(found), WORDS)
        x[:, PATH : PATH + WORDS] = hashed / (1 + np.sqrt((hashed**2).sum(axis=1, keepdims=True)))
        x[:, PATH + WORDS :] = numbers
        x[:, PATH + WORDS] = np.log1p(x[:, PATH + WORDS]) / 3
    return x


class Labeller:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.w = init_cell(rng, "lstm", INPUTS, HIDDEN, "f") | init_cell(rng, "lstm", INPUTS, HIDDEN, "r")
        self.w |= {"out": (rng.standard_normal((2 * HIDDEN, 1)) * 0.3).astype(np.float32), "direct": np.zeros((INPUTS, 1), np.float32), "bias": np.zeros(1, np.float32)}

    def _logits(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = bidirectional("lstm", self.w, x, mask, kept)
        return (states @ self.w["out"])[..., 0] + (x @ self.w["direct"])[..., 0] + self.w["bias"][0], states

    @staticmethod
    def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(r) for r in rows)
        x, mask = np.zeros((len(rows), t, rows[0].shape[1]), np.float32), np.zeros((len(rows), t), np.float32)
        for i, r in enumerate(rows):
            x[i, : len(r)], mask[i, : len(r)] = r, 1
        return x, mask

    def fit(self, rows: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 24, seed: int = 1) -> Labeller:
        rng, adam = np.random.default_rng(seed), Adam(0.01)
        pairs = [(r, y) for r, y in zip(rows, labels) if len(r)]
        pairs.sort(key=lambda p: len(p[0]))
        groups = [pairs[i : i + batch] for i in range(0, len(pairs), batch)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = self.pad([r for r, _ in groups[g]])
                y = self.pad([v[:, None] for _, v in groups[g]])[0][..., 0]
                x *= rng.random((len(x), 1, INPUTS)) > np.repeat([0.1, 0.4, 0.0], [PATH, WORDS, NUMBERS])  # no single name decides
                kept: dict = {}
                logit, states = self._logits(x, mask, kept)
                d = ((sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
                grads, _ = bidirectional_back("lstm", self.w, d[..., None] * self.w["out"][:, 0], x, mask, kept)
                flat = d.reshape(-1)
                grads |= {"out": (states.reshape(len(flat), -1).T @ flat)[:, None], "direct": (x.reshape(len(flat), -1).T @ flat)[:, None], "bias": flat.sum(keepdims=True)}
                adam.update(self.w, grads)
        return self

    def _given(self, found: list[Block], chunk: int = 4096) -> np.ndarray:
        """What the blocks add to the gates of both directions and to the logit: 4 HIDDEN, 4 HIDDEN and 1 numbers each. Inputs are made for some blocks at a time."""
        w, b = np.concatenate([self.w["fx"], self.w["rx"], self.w["direct"]], axis=1), np.concatenate([self.w["fb"], self.w["rb"], self.w["bias"]])
        return np.concatenate([np.empty((0, len(b)), np.float32), *(vectors(found[i : i + chunk], i, len(found)) @ w + b for i in range(0, len(found), chunk))])

    def content(self, pages: list[list[Block]], cells: int = 16_384) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length run together, up to ``cells`` blocks with filling; a longer page runs alone."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        given, gates = {i: self._given(pages[i]) for i in order}, 4 * HIDDEN
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= cells:
                n += 1
            own, order = order[:n], order[n:]
            x, mask = self.pad([given.pop(i) for i in own])
            f = run("lstm", x[..., :gates], self.w["fh"], mask) @ self.w["out"][:HIDDEN, 0]
            r = run("lstm", x[:, ::-1, gates : 2 * gates], self.w["rh"], mask[:, ::-1])[:, ::-1] @ self.w["out"][HIDDEN:, 0]
            for i, row in zip(own, f + r + x[..., -1]):
                out[i] = row[: len(pages[i])] > 0
        return out

    def extract(self, pages: list[str | None], count: int = 256, chars: int = 4_000_000) -> list[str]:
        out: list[str] = []
        while len(out) < len(pages):
            lo, size = len(out), 0
            own = []
            while lo + len(own) < len(pages) and len(own) < count and (not own or size < chars):
                own.append(pages[lo + len(own)])
                size += len(own[-1] or "")
            found = [blocks(p) for p in own]
            out += ["\n\n".join(b.text for b, k in zip(bs, keep) if k) for bs, keep in zip(found, self.content(found))]
        return out


# Names that pages give to their parts, and words that stand in the parts beside the text.
MAIN = "article;main;section.content;div.content;div#content;div.post;div.post-body;div.entry-content;div.article-body;div#main;div.story;td.content;div.text;section.article;main#content;div.page-content;div.markdown-body;body"
ASIDE = {
    "nav": ("nav;div.nav;ul.menu;div#menu;nav.navbar;div.breadcrumb;div.navigation;div.topbar;ul.nav;div.pagination;nav.toc;div.skip-links", "home about contact products news login sign up search menu next previous archive"),
    "header": ("header;div.header;div#header;div.masthead;div.site-header;div.banner;header.top;div.logo;div.branding;div.byline-bar", "welcome official site the daily blog your source edition today"),
    "footer": ("footer;div.footer;div#footer;footer.site-footer;div.copyright;div.legal;div.bottom;div.colophon", "© all rights reserved privacy policy terms of use imprint contact powered by"),
    "aside": ("aside;div.sidebar;div#sidebar;aside.related;div.widget;div.related-posts;div.recommended;ul.trending;div.tags;div.author-box;div.side;div.more-stories;div.teaser", "related popular recent posts most read see also trending tags follow us"),
    "ad": ("div.ad;div.ads;div.advert;div.advertisement;ins.adsbygoogle;div.sponsored;div.promo;aside.ad;div.ad-slot;div#banner-ad;section.sponsor;div.commercial", "advertisement sponsored buy now sale offer discount shop free shipping"),
    "notice": ("div.cookie;div.cookie-notice;div.notice;div#cookie-banner;div.consent;div.alert;div.gdpr;section.newsletter;div.popup;div.modal;div.subscribe;dialog;div.paywall;div.disclaimer;div.warning", "we use cookies accept this site consent subscribe newsletter browser settings"),
    "form": ("form;form.search;div.form;form#login;fieldset;form.subscribe;div.search;form.contact", "search email password submit name send your message go"),
    "comments": ("div.comments;section#comments;div#disqus;ul.comment-list;section.comments;div.comment;ol.commentlist;div.responses;div.replies;div.reviews;section.discussion;article.comment;div.user-comments", "reply comment says wrote ago like share posted by leave great thanks"),
    "share": ("div.share;div.social;ul.social-links;div.meta;div.tools;div.share-buttons;div.print", "share tweet facebook email print"),
}
_LEAVES = {"main": ("p p p p p p h2 h3 li blockquote td pre dd figcaption div"), "nav": "a a a li", "footer": "p div small li", "form": "label button option p", "comments": "p p div li", "aside": "li a h3 p p"}


def _open(spec: str) -> tuple[str, str]:
    tag, dot, name = re.match(r"(\w+)([.#]?)(.*)", spec).groups()
    return (f'<{tag} {"class" if dot == "." else "id"}="{name}">' if dot else f"<{tag}>"), ("" if tag == "body" else f"</{tag}>")


def made_page(rng: np.random.Generator, words: list[str]) -> tuple[str, list[int]]:
    """A page laid out at random and the labels of its blocks, in order."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p

    def say(n: int, own: str = "") -> str:
        own_words = own.split()
        ws = [pick(own_words) if own_words and chance(0.4) else pick(words) for _ in range(max(1, n))]
        return (" ".join(ws).capitalize() + ("." if chance(0.8) and n > 3 else "")).replace("&", "&amp;").replace("<", "&lt;")

    out: list[str] = []
    labels: list[int] = []

    def leaf(tag: str, text: str, label: int) -> None:
        if tag == "a":
            out.append(f'<li><a href="/{pick(words)[:9]}">{text}</a></li>')
        elif tag == "td":
            out.append(f"<table><tr><td>{text}</td></tr></table>")
        elif tag == "li" and label and chance(0.7):
            out.append(f"<ul><li>{text}</li></ul>")
        else:
            inner = f"<a href='/x'>{text}</a>" if label == 0 and chance(0.3) else f"<b>{text}</b>" if chance(0.1) else text
            out.append(f"<{tag}>{inner}" + ("" if tag == "p" and chance(0.4) else f"</{tag}>"))
        labels.append(label)

    def beside(kind: str) -> None:
        specs, own = ASIDE[kind]
        start, end = _open(pick(specs.split(";")))
        out.append(start)
        if chance(0.25) and not start.startswith("<ul"):
            out.append(say(int(rng.integers(2, 15)), own))
            labels.append(0)
        else:
            for _ in range(int(rng.integers(1, 6))):
                leaf(pick(_LEAVES.get(kind, "p div a span p").split()) if not chance(0.2) else "p", say(int(rng.integers(1, 40 if kind in ("comments", "ad", "notice") else 14)), own), 0)
        out.append(end)


    def article(depth: bool = True) -> None:
        start, end = _open(pick(MAIN.split(";")))
        end = end if start != "<body>" else ""
        out.append("" if start == "<body>" else start)
        wrapped = chance(0.3)
        out.append("<div>" if wrapped else "")
        if chance(0.8):
            leaf(pick(["h1", "h1", "h2"]), say(int(rng.integers(2, 12))), 1)
        for _ in range(int(rng.integers(1, 14))):
            leaf(pick(_LEAVES["main"].split()), say(int(rng.integers(1, 90))), 1)
            if depth and chance(0.1):
                beside(pick(["ad", "share", "aside", "notice", "form"]))
        if depth and chance(0.25):
            beside("comments")
        out.append("</div>" if wrapped else "")
        out.append(end)

    for kind in ("notice", "header", "nav", "ad", "form", "aside"):
        if chance(0.5):
            beside(kind)
    article()
    for kind in ("share", "comments", "aside", "ad", "nav", "form", "notice", "footer"):
        if chance(0.45):
            beside(kind)
    head = f"<!DOCTYPE html><html><head><title>{say(5)}</title><style>p{{margin:0}}</style></head><body>"
    return head + "".join(out) + "</body></html>", labels


def sectioned_labels(found: list[Block]) -> np.ndarray | None:
    """Labels by the page's own sectioning, where it has an article or main element; else None."""
    return np.array([b.inside for b in found], dtype=np.float32) if any(b.within for b in found) else None


def train_labeller(pages: list[str], made: int = 600, seed: int = 4) -> Labeller:
    rng = np.random.default_rng(seed)
    own = sorted({w for p in pages[:50] for b in blocks(p) for w in b.text.split() if w.isalpha()}) or "some plain words of any text that may stand in a page".split()
    rows, labels = [], []
    for i in range(made):
        invented = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(80)]  # words that no other page has
        page, y = made_page(rng, own if i % 3 == 0 else invented)
        found = blocks(page)
        if len(found) == len(y):  # runs of bare text may have joined
            rows.append(vectors(found))
            labels.append(np.array(y, dtype=np.float32))
    for p in pages:
        found = blocks(p)
        y = sectioned_labels(found)
        if y is not None:
            rows.append(vectors(found))
            labels.append(y)
    return Labeller().fit(rows, labels)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 150, longest: int = 50_000) -> DataFrame:
    """Per row: page_id, url, text (blocks of main text, joined by two line ends) and n_chars, its code points.

    Null and empty pages, and those without main text, give an empty text. Every block of a page of any
    length is labelled from all of its words; nothing is cut. The labeller is fitted on up to ``sample`` pages of smallest hash
    and at most ``longest`` characters, besides made ones. One pass without a shuffle; repeated rows each
    get a row and other columns are ignored.
    """
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    taken = d.where(F.length("html").between(1, longest)).orderBy(F.xxhash64("page_id", "url"), "page_id").limit(sample).select("html").collect()
    held = pages.sparkSession.sparkContext.broadcast(train_labeller([r["html"] for r in taken]))

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(held.value.extract(s.tolist()), dtype=object)

    text: Column = of("html")
    return d.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
