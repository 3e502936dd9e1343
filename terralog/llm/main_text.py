"""HTML extraction: boosted trees judge DOM nodes, a tree-wide decoding settles them.

A page becomes a tree of block elements; inline elements belong to the block around them.
Gradient-boosted trees give every block a log-odds of being main text, from its text, links
and punctuation, the density of its subtree, its attribute tokens and tags and those of
its ancestors, its depth, and its siblings.  The nodes are then settled together: a kept
node's descendants are all kept, a dropped node's all dropped, and a mixed node leaves it
to its children at a price; the labelling with the highest total is found bottom-up.  So
no dropped container holds a kept paragraph.

The model is fitted on the driver on ``TRAIN_PAGES`` pages with article or main, of less
than ``TRAIN_CHARS`` characters, those with the smallest hash of id and markup, or on all
such pages if there are fewer.  Their labels come from their markup (article and main against navigation,
footers and the like); every page is also trained in altered copies, with containers of
other names and with sidebars, notices, forms, adverts and comments put in, so that the
model leans on density and structure where tags say nothing.  Scoring reads every page
once, whole, without a shuffle.

Defined results: a null or empty page, or one without main text, has the empty text; broken
or cut-off markup is read as far as it goes; every input row gives one output row, repeated
rows included; an empty table gives an empty one; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import sampled

TRAIN_PAGES = 240
#: Longer pages are not learned from, as the driver holds all of them at once; they are scored like any other.
TRAIN_CHARS = 200_000
TREES, DEPTH, RATE, SMOOTH, BINS = 50, 3, 0.25, 5.0, 32
MIXED_COST = 1.0
PAGES_AT_ONCE = 400

#: Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr input".split()
)
#: Elements of formulas; their text belongs to the line around them.
MATH = frozenset(
    "math maction annotation annotation-xml menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover"
    " mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder"
    " munderover semantics apply bvar ci cn csymbol".split()
)
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
CLOSED_BY_BLOCK = frozenset(["p"])
#: An opening tag that ends an open one of these, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AROUND = frozenset("nav aside footer header form button select fieldset menu dialog".split())
MAIN = frozenset(["article", "main"])
CONTROLS = frozenset("input button select textarea option".split())
#: Attribute tokens of what surrounds an article, and of articles.
AROUND_TOKENS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent"
    " copyright disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation navigations"
    " newsletter none notice notification notifications pagination pager popup promo promotion recommended related replies"
    " reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags toolbar topbar"
    " widget widgets alert aside warning contentinfo complementary".split()
)
MAIN_TOKENS = frozenset("article articlebody body content entry main maincontent post story text prose".split())

#: An attribute as the HTML standard reads it: quotes count only behind "=" and where they are closed.
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
ATTRIBUTES = rf"(?:[\s/]++|[^\s>/][^\s>/=]*+(?:\s*+=\s*+(?:{VALUE}))?+)*+"
ATTRIBUTE = re.compile(rf"([^\s>/][^\s>/=]*+)(?:\s*+=\s*+({VALUE}))?+")
TOKEN = re.compile(
    rf"<(?P<raw>{RAW})(?=[\s/>]){ATTRIBUTES}>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
#: Elements that are left out whole where they are closed, and read like any others where they are not.
ASIDE = re.compile(r"<(/?)(template|noscript)(?=[\s/>])", re.I)
#: Where a drawing ends: at its closing tag, or before an element that the HTML standard (or sense) has outside of it.
DRAWN = re.compile(
    r"</svg\s*>|(?P<inner><foreignobject[\s/>])|(?=<(?:/?(?:p|div|body|article|main|section|nav|header|footer|aside)|blockquote|center|code|dd|dl|dt|em|embed"
    r"|h[1-6]|hr|img|li|menu|ol|pre|span|strong|table|ul)[\s/>])",
    re.I,
)
FOREIGN_END = re.compile(r"</foreignobject\s*>", re.I)
NAMING = frozenset("class id role itemprop".split())
PIECE = re.compile(r"[a-z]+")
HIDING = re.compile(r"display\s*:\s*none|\bhidden\b", re.I)


class Node:
    __slots__ = ("parent", "tag", "depth", "tokens", "runs", "links", "chars", "children", "controls")

    def __init__(self, parent: int, tag: str, depth: int, tokens: frozenset):
        self.parent, self.tag, self.depth, self.tokens = parent, tag, depth, tokens
        self.runs: list[int] = []
        self.links = self.chars = self.children = self.controls = 0


def marks_of(attrs: str) -> frozenset:
    """Words of the attributes that name what an element is, and 'hidden' if it is."""
    words = []
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name in NAMING:
            words += PIECE.findall(value.lower())
        elif name == "hidden" or name == "style" and HIDING.search(value):
            words.append("hidden")
    return frozenset(words)


def left_out(html: str) -> dict[int, int]:
    """Where each closed template and noscript begins, and where it ends."""
    spans: dict[int, int] = {}
    open_: dict[str, list[int]] = {"template": [], "noscript": []}
    for m in ASIDE.finditer(html):
        starts = open_[m[2].lower()]
        if not m[1]:
            starts.append(m.start())
        elif starts:
            end = html.find(">", m.end())
            spans[starts.pop()] = end + 1 if end >= 0 else len(html)
    return spans


class Page:
    """Block nodes in page order, and blocks of text: ``(node, text)`` in page order."""

    def __init__(self, html: str):
        self.nodes = [Node(-1, "#page", 0, frozenset())]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        nodes, stack = self.nodes, [0]  # open block nodes
        inline: list[str] = []  # open inline elements of interest within the block
        parts: list[str] = []
        linked = 0
        at = 0
        drawn = True  # whether a drawing may end further on
        spans = left_out(html)
        foreign = max((m.end() for m in FOREIGN_END.finditer(html)), default=-1)

        def drawing_end(at: int) -> int | None:
            """Where a drawing that began before ``at`` ends; what it holds for other languages belongs to it."""
            while m := DRAWN.search(html, at):
                if not m["inner"]:
                    return m.end()
                at = FOREIGN_END.search(html, m.end()).end() if m.end() < foreign else m.end()
            return None

        def close_run() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    node = nodes[stack[-1]]
                    node.runs.append(len(self.blocks))
                    node.chars += len(text)
                    node.links += min(linked, len(text))
                    self.blocks.append((stack[-1], text))
                linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if "a" in inline:
                linked += len(text.strip())

        def pop_to(k: int) -> None:
            close_run()
            del stack[k:]
            inline.clear()

        while m := TOKEN.search(html, at):
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    nodes[stack[-1]].controls += m["raw"].lower() == "textarea"
                continue
            tag = tag.lower()
            if tag in MATH:
                continue
            if tag in ("template", "noscript"):
                at = spans.get(m.start(), at)
                continue
            if tag == "svg":
                if drawn and not m["end"] and not m["attrs"].endswith("/"):
                    end = drawing_end(at)
                    drawn = end is not None
                    at = end if drawn else at
                continue
            if m["end"]:
                if tag in INLINE:
                    if tag == "a" and "a" in inline:
                        inline.remove("a")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        pop_to(k)
                        break
                continue
            if tag in INLINE:
                if tag == "br":
                    parts.append(" ")
                elif tag == "a":
                    inline.append("a")
                elif tag == "input":
                    nodes[stack[-1]].controls += 1
                continue
            # A block begins: it ends an open paragraph, and open elements of its kind.
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag == "p":
                    pop_to(k)
                    break
                if open_tag not in HEADINGS:
                    break
            close_run()
            if tag in ENDS:
                same, stop = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = nodes[stack[k]].tag
                    if open_tag in stop:
                        break
                    if open_tag in same:
                        pop_to(k)
                        break
            inline.clear()
            nodes[stack[-1]].children += 1
            if tag in VOID:
                continue
            attrs = m["attrs"]
            tokens = marks_of(attrs) if attrs and not attrs.isspace() else frozenset()
            node = Node(stack[-1], tag, nodes[stack[-1]].depth + 1, tokens)
            node.controls = int(tag in CONTROLS)
            nodes.append(node)
            stack.append(len(nodes) - 1)
        if at < len(html):
            tail = html[at:]
            add(tail[: tail.index("<")] if "<" in tail and re.match(r"<[a-zA-Z/!]", tail[tail.index("<") :]) else tail)
        close_run()


NAMES = (
    "depth", "chars", "links", "tree_chars", "tree_links", "tree_density", "children", "siblings", "same_siblings",
    "sibling_chars", "place", "tree_share", "stops", "parent_links", "heading", "paragraph", "item", "cell", "container",
    "around_tag", "around_tag_above", "main_tag_above", "around_token", "around_token_above", "main_token", "controls",
    "words_like", "around_nearer",
)


def node_features(page: Page) -> np.ndarray:
    """A row per node, in the order of ``NAMES``."""
    nodes = page.nodes
    n = len(nodes)
    chars = [x.chars for x in nodes]
    tree, links, size, controls = chars[:], [x.links for x in nodes], [1] * n, [x.controls for x in nodes]
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        tree[p] += tree[k]
        links[p] += links[k]
        size[p] += size[k]
        controls[p] += controls[k]
    kids: list[dict] = [{} for _ in range(n)]
    kid_chars, kid_count = [0] * n, [0] * n
    for k in range(1, n):
        x = nodes[k]
        kids[x.parent][x.tag] = kids[x.parent].get(x.tag, 0) + 1
        kid_chars[x.parent] += chars[k]
        kid_count[x.parent] += 1
    total = max(1, tree[0])
    out = np.zeros((n, len(NAMES)))
    around_above, main_above, token_above, main_token_above, nearer = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    before = 0
    for k in range(n):
        x = nodes[k]
        p = x.parent
        around, main = x.tag in AROUND, x.tag in MAIN
        token, main_token = bool(x.tokens & AROUND_TOKENS), bool(x.tokens & MAIN_TOKENS)
        if p >= 0:
            around_above[k] = around_above[p] + (nodes[p].tag in AROUND)
            main_above[k] = main_above[p]
            token_above[k] = token_above[p] + bool(nodes[p].tokens & AROUND_TOKENS)
            main_token_above[k] = main_token_above[p]
            nearer[k] = nearer[p]
        # Which kind of mark is the nearest: 1 main, -1 around.
        if around or token:
            nearer[k] = -1
        elif main or main_token:
            nearer[k] = 1
        main_above[k] += main
        main_token_above[k] += main_token
        count = kid_count[p] if p >= 0 else 1
        text = page.blocks[x.runs[0]][1] if x.runs else ""
        stops = sum(text.count(c) for c in ".,;!?")
        out[k] = (
            x.depth, log1p(chars[k]), x.links / max(1, chars[k]), log1p(tree[k]), links[k] / max(1, tree[k]),
            tree[k] / size[k], log1p(x.children), log1p(count), kids[p][x.tag] / count if p >= 0 else 1,
            log1p((kid_chars[p] - chars[k]) / max(1, count - 1)) if p >= 0 else 0, before / total, tree[k] / total,
            stops / (len(text) + 10), links[p] / max(1, tree[p]) if p >= 0 else 0,
            x.tag in HEADINGS, x.tag == "p", x.tag in ("li", "dt", "dd", "option"), x.tag in ("td", "th"),
            x.tag in ("div", "section", "main", "article", "ul", "ol", "table", "body"),
            around, around_above[k], main_above[k], token, token_above[k], main_token_above[k], log1p(controls[k]),
            text.count(" ") / (len(text) + 1), nearer[k],
        )
        before += chars[k]
    return out


class Trees(NamedTuple):
    """Trees of equal depth, level by level: feature and cut of each inner node, value of each leaf."""

    start: float
    features: np.ndarray  # trees x (2 ** depth - 1)
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth


def log_odds(model: Trees, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model.start), np.arange(len(x))
    for feature, cut, leaf in zip(model.features, model.cuts, model.leaves, strict=True):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        out += leaf[at - (2**DEPTH - 1)]
    return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting on binned features with Newton leaves."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    share = float(np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, cuts, values = np.zeros((TREES, inner), int), np.zeros((TREES, inner)), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, -1.0)
            for j in range(width):
                cell = (at - first) * BINS + bins[:, j]
                gs = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(1)
                hs = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SMOOTH) + (ga - gs) ** 2 / (ha - hs + SMOOTH) - ga**2 / (ha + SMOOTH)
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                better = top > best
                best[better] = top[better]
                features[t, first : first + many][better] = j
                cuts[t, first : first + many][better] = edges[j][k][better]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[t][at]] > cuts[t][at])
        leaf = at - inner
        values[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SMOOTH)
        total += values[t][leaf]
    return Trees(start, features, cuts, values)


def settled(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each node's own text is kept, without contradiction along the tree."""
    nodes = page.nodes
    n = len(nodes)
    weight = [1 + log1p(x.chars) / 2 if x.chars else 1.0 for x in nodes]
    own = [float(o) * w for o, w in zip(odds, weight, strict=True)]
    keep, drop = own[:], [-x for x in own]
    keep[0] = drop[0] = 0.0
    mixed = [(abs(x) if node.chars else 0.0) - MIXED_COST for x, node in zip(own, nodes, strict=True)]
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[k].parent
        keep[p] += keep[k]
        drop[p] += drop[k]
        mixed[p] += max(keep[k], drop[k], mixed[k])
    state, out = [""] * n, [False] * n
    for k in range(n):
        above = state[nodes[k].parent] if k else "mixed"
        if above != "mixed":
            state[k] = above
        else:
            _, state[k] = max((drop[k], "drop"), (keep[k], "keep"), (mixed[k], "mixed"))
        out[k] = state[k] == "keep" or (state[k] == "mixed" and own[k] > 0)
    return out


def main_text(page: Page, odds: np.ndarray) -> str:
    kept = settled(page, odds)
    return "\n\n".join(text for node, text in page.blocks if kept[node])


# -- training --------------------------------------------------------------------

#: Containers that article and main are renamed to in altered copies.
RENAMED = (("<div>", "</div>"), ('<div class="content">', "</div>"), ('<section id="main">', "</section>"), ("<main>", "</main>"))
#: What surrounds articles elsewhere; {a} to {c} are texts of other pages.
BEFORE = (
    '<header class="site-header"><a href="/">{a}</a><p>{b}</p></header>',
    '<div class="cookie-notice" role="alert"><p>{b}</p><button>OK</button></div>',
    '<div id="sidebar"><h3>{a}</h3><ul><li><a href="/x">{b}</a></li><li><a href="/y">{c}</a></li></ul></div>',
    '<div class="menu"><a href="/1">{a}</a> <a href="/2">{b}</a></div>',
    '<form action="/s"><label>{a}</label><input name="q"><button>{a}</button></form>',
    "<div><a href='/1'>{a}</a> | <a href='/2'>{b}</a> | <a href='/3'>{c}</a></div>",
)
AFTER = (
    '<aside><h3>{a}</h3><p>{b}</p></aside>',
    '<div class="comments"><h3>{a}</h3><div class="comment"><p>{b}</p></div><div class="comment"><p>{c}</p></div></div>',
    '<section id="comments"><ul><li><b>{a}</b><p>{b}</p></li><li><p>{c}</p></li></ul></section>',
    '<div class="ad">{b}</div>',
    '<div class="related"><ul><li><a href="/r">{a}</a></li><li><a href="/q">{b}</a></li></ul></div>',
    '<form class="newsletter"><p>{b}</p><input type="email"><button>{a}</button></form>',
    '<footer><p>{b}</p><a href="/i">{a}</a></footer>',
)
INSIDE = ('<div class="advert">{b}</div>', '<aside class="promo"><p>{b}</p></aside>', '<div class="share"><a href="/s">{a}</a></div>', "")
#: Pages to learn from where the table has none with marked articles.
STAND_IN = (
    "<body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Rain over the hills</h1>"
    "<p>It rained for three days, and the river rose above its banks near the old bridge.</p><p>On the fourth day, the sun came"
    " out again.</p></article><footer>Imprint and contact</footer></body>",
    "<body><nav><a href='/'>Start</a></nav><article><h1>A new library</h1><p>The town has opened a library, with rooms for"
    " reading, and a garden.</p><ul><li>It has ten thousand books.</li><li>It is open every day.</li></ul><p>Entry is free,"
    " as it always was.</p></article><footer>All rights reserved</footer></body>",
)


def labels(page: Page) -> np.ndarray:
    """1 main, 0 around, -1 mixed or empty, by the nearest mark above each block of text."""
    n = len(page.nodes)
    mark = [0] * n
    main, every = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        x = page.nodes[k]
        above = mark[x.parent]
        around = (x.tag in AROUND and not (x.tag == "header" and above == 1)) or bool(x.tokens & AROUND_TOKENS)
        mark[k] = -1 if around or above == -1 else 1 if x.tag in MAIN or x.tokens & {"keepthis"} else above
        every[k] = x.chars
        main[k] = x.chars * (mark[k] == 1)
    for k in range(n - 1, 0, -1):
        every[page.nodes[k].parent] += every[k]
        main[page.nodes[k].parent] += main[k]
    share = main / np.maximum(every, 1)
    out = np.where(share >= 0.95, 1, np.where(share <= 0.05, 0, -1))
    out[(every == 0) | (np.arange(n) == 0)] = -1
    return out


def altered(html: str, others: list[str], rng: np.random.Generator) -> str:
    """The page with other surroundings and another name for its article, which stays marked."""

    def some(forms: tuple[str, ...], most: int) -> str:
        chosen = rng.choice(len(forms), size=int(rng.integers(0, most + 1)), replace=False)
        a, b, c = (others[int(i)] for i in rng.integers(len(others), size=3))
        short = " ".join(a.split()[:3])
        return "".join(forms[int(i)].format(a=short, b=b, c=c) for i in chosen)

    start, end = RENAMED[int(rng.integers(len(RENAMED)))]
    marked = start[:-1] + ' data-k itemprop="keepthis">'
    html = re.sub(r"<(article|main)\b[^>]*>", lambda _: some(BEFORE, 3) + marked, html)
    html = re.sub(r"</(article|main)\s*>", lambda _: end + some(AFTER, 4), html)
    places = [m.end() for m in re.finditer(r"</p>", html)]
    if places and rng.random() < 0.5:
        k = places[int(rng.integers(len(places)))]
        html = html[:k] + some(INSIDE, 1) + html[k:]
    return html


def training_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> list[str]:
    """The ``most`` marked pages with the smallest hashes of id and markup, or all there are; equal rows count once."""
    plain = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col, html_col).alias("key"))
    marked = plain.filter(F.col("html").rlike("(?i)<(article|main)\\b") & (F.length("html") < TRAIN_CHARS))
    among = marked.count()
    while True:
        found = sampled(marked.dropDuplicates(["key"]), "key", most, among).collect()
        if len(found) == most or among <= 4 * most:
            return [r.html for r in found]
        among //= 4  # many equal rows: a larger share of the hashes


def learned(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> Trees:
    """Fit on at most ``most`` pages."""
    return fitted(training_pages(pages, id_col, html_col, most))


def fitted(pages: list[str]) -> Trees:
    pages = [*pages, *STAND_IN]
    rng = np.random.default_rng(17)
    plain = [Page(h) for h in pages]
    others = [text[:300] for p in plain for _, text in p.blocks[:40] if len(text) > 20]
    others = [others[int(i)].replace("<", " ").replace("{", " ") for i in rng.integers(len(others), size=400)]
    xs, ys, ws = [], [], []
    hidden = [NAMES.index(c) for c in NAMES if "tag" in c or "token" in c or c == "around_nearer"]
    mark = frozenset(["keepthis"])
    for html, page in zip(pages, plain, strict=True):
        for copy in (page, *(Page(altered(html, others, rng)) for _ in range(3))):
            y = labels(copy)
            for node in copy.nodes:
                node.tokens -= mark
            x = node_features(copy)
            if rng.random() < 0.25:
                x[:, hidden] = 0  # tags and tokens say nothing here
            use = y >= 0
            chars = np.array([node.chars for node in copy.nodes])
            xs.append(x[use])
            ys.append(y[use])
            ws.append((1 + np.log1p(chars) / 2)[use] / max(1, use.sum()) * 20)
    return boosted(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def texts_of(htmls: list[str], model: Trees) -> list[str]:
    out = []
    for k in range(0, len(htmls), PAGES_AT_ONCE):
        pages = [Page(h) for h in htmls[k : k + PAGES_AT_ONCE]]
        parts = [node_features(p) for p in pages]
        odds = log_odds(model, np.concatenate(parts))
        ends = np.cumsum([len(x) for x in parts])
        out += [main_text(p, odds[e - len(x) : e]) for p, x, e in zip(pages, parts, ends, strict=True)]
    return out


def extracted(pages: DataFrame, model: Trees, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    plain = pages.select("page_id", "url", F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    return plain.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
