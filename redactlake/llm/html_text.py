"""Main text of web pages: boosted trees over DOM nodes, then one consistent labelling of the tree.

A page is parsed leniently (tags left open are closed as browsers do). Every block element gets
features: text and link mass of its subtree and their density, depth, place among its siblings, tag
and attribute tokens of itself and of what it stands in. Boosted trees give each block a probability
of being main text.

Decoding then picks the likeliest labelling in which a block is *around* (it may hold anything),
*main* (its blocks are main or not) or *other* (so is all below it), by one pass up and one down the
tree; so no block can be main inside one that is not.

The trees learn from a bounded sample of the given pages, labelled by their own semantic elements,
and from the same texts in made-up page layouts that name their parts in other ways.

Null, empty and text-free pages give an empty text. Row order, repeats and other columns stay; a
column already called ``text`` is replaced.
"""

from __future__ import annotations

import copy
import random
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import textkit as K
from .sampling import MAX_SAMPLE_CHARS, unit_hash

SAMPLE_PAGES = 150
LAYOUTS_PER_PAGE = 5

#: Elements of HTML by how a browser treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title iframe svg annotation annotation-xml object select option datalist button textarea audio video canvas".split())
#: What may stand in the head; all else ends it.
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes script style template".split())
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address header footer nav aside form fieldset legend details summary dialog menu hgroup hr center".split()
)
#: An open element of the value's kinds ends where the key begins.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "body": {"head"},
}
#: ... but not beyond one of these.
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
ENDS_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "legend", "summary", "figcaption"}

TAGS = "html body main article section div p h1 h2 h3 ul ol li dl table td blockquote pre figure header footer nav aside form".split()
OTHER_TOKENS = set(
    "ad ads adv advert advertisement banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header"
    " masthead topbar footer bottom sidebar side rail widget cookie cookies consent gdpr notice alert popup modal overlay subscribe"
    " newsletter signup login form search share sharing social follow comment comments commentlist reply replies respond discussion"
    " disqus related recommended more pagination pager copyright legal toolbar tags meta author".split()
)
MAIN_TOKENS = set("article content main post entry story body text page blog prose maincontent articlebody postcontent".split())
HASHED = 64
#: What it costs a block to be one more main in none, and to be other inside a main one without a name that tells. Being short is no reason for either, so
#: the blocks of an article are taken together.
ENTERING, LEAVING = 6.0, 2.5
#: A paragraph or the like without any name, and not mostly links, goes with what it stands in; in the body, with itself.
PLAIN_LEAVING = 12.0
#: Elements that say by themselves that they stand beside the article; to be main outside a main block costs them more.
APART_ENTERING = 13.0
APART = frozenset("nav header footer aside form".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody figcaption".split())
SHAPES = 22


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    label: str | None = None
    text: int = 0  # characters of its own
    link: int = 0
    children: list[int] = field(default_factory=list)


def _tokens(values: dict) -> list[str]:
    words = " ".join(str(values.get(k) or "") for k in ("class", "id", "role", "itemprop"))
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", words)]


class Page(HTMLParser):
    """Block elements in page order, and runs of text with the block they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, [])]
        self.open: list[tuple[str, int]] = [("html", 0)]  # (tag, block it is or stands in)
        self.runs: list[list] = []  # [block, pieces]
        self.broken = True
        self.hidden = 0
        self.links = 0
        self.body = 0  # its node, if there is one yet

    def _close(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.broken |= tag in BLOCKS
        del self.open[at:]

    def _close_open(self, tags: set[str], limits: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._close(i)
                return
            if self.open[i][0] in limits:
                return

    def _in_body(self) -> None:
        """For what cannot stand in the head: it ends the head, and stands in a body, written or not."""
        if self.open[-1][0] == "head":
            self._close(len(self.open) - 1)
        if self.hidden or self.open[-1][1]:
            return
        if not self.body:
            self.body = self._node("body", 0, {})
        self.open.append(("body", self.body))
        self.broken = True

    def _node(self, tag: str, inside: int, values: dict) -> int:
        parent = self.nodes[inside]
        self.nodes.append(Node(tag, inside, parent.depth + 1, _tokens(values), values.get("data-y")))
        parent.children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "head" and self.body):
            return
        if tag == "body" and self.body:
            self.nodes[self.body].tokens += _tokens(dict(attrs))
            return
        if tag not in IN_HEAD and tag != "body":
            self._in_body()
        if tag in ENDS_P:
            self._close_open({"p"}, BLOCKS - {"p"})
        if tag in ENDS:
            while True:
                before = len(self.open)
                self._close_open(ENDS[tag], LIMITS.get(tag, {"table"}))
                if len(self.open) == before:
                    break
        inside = self.open[-1][1]
        if tag in BLOCKS:
            self.broken = True
            inside = self._node(tag, inside, dict(attrs))
            if tag == "body" and not self.hidden:
                self.body = inside
        if tag == "br":
            self._put(" ")
        if tag in VOID:
            return
        self.open.append((tag, inside))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Nothing else may close these, and what follows is not in them.
        if (tag in HIDDEN or tag == "math") and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "body" and ("body", self.body) in self.open:
            # What follows still stands in the body.
            self._close(self.open.index(("body", self.body)) + 1)
            self.broken = True
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def _put(self, data: str) -> None:
        block = self.open[-1][1]
        if self.broken or not self.runs or self.runs[-1][0] != block:
            self.runs.append([block, []])
            self.broken = False
        self.runs[-1][1].append(data)

    def handle_data(self, data):
        if data.strip():
            self._in_body()
        if self.hidden:
            return
        self._put(data)
        size = len(data.strip())
        node = self.nodes[self.open[-1][1]]
        node.text += size
        node.link += size if self.links else 0

    def blocks(self) -> list[tuple[int, str]]:
        """(block, text) in page order, white space folded, empty ones left out."""
        texts = [(b, " ".join("".join(pieces).split())) for b, pieces in self.runs]
        return [x for x in texts if x[1]]


def parse(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    return page


# --- features ----------------------------------------------------------------------


def features(page: Page) -> np.ndarray:
    """One row per block element."""
    nodes = page.nodes
    n = len(nodes)
    own, text, link = ([float(getattr(x, a)) for x in nodes] for a in ("text", "text", "link"))
    below, paragraphs = [1.0] * n, [float(x.tag == "p") for x in nodes]
    forms = [float(x.tag == "form") for x in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (text, link, below, paragraphs, forms):
            a[p] += a[i]
    place, longest, alike = [0] * n, [0.0] * n, [0.0] * n
    for x in nodes:
        tags = Counter(nodes[c].tag for c in x.children)
        most = max((text[c] for c in x.children), default=0.0)
        for k, c in enumerate(x.children):
            place[c], longest[c], alike[c] = k, most, float(tags[nodes[c].tag])
    total, widest = max(text[0], 1.0), max(own)
    titled = [float(x.tag in ("h1", "h2")) for x in nodes]
    for i in range(n - 1, 0, -1):
        titled[nodes[i].parent] += titled[i]
    apart, named = [0.0] * n, [0.0] * n
    above: list[frozenset] = [frozenset()] * n
    out = np.zeros((n, SHAPES + len(TAGS) + 2 * HASHED))
    rows = []
    for i, x in enumerate(nodes):
        if i:
            up = x.parent
            # What it stands in: elements that say by themselves what they are, and the tokens of all of them.
            apart[i] = max(apart[up], float(nodes[up].tag in APART))
            named[i] = max(named[up], float(nodes[up].tag in ("article", "main")))
            above[i] = above[up] | {sum(t.encode()) % HASHED for t in nodes[up].tokens}
            siblings = len(nodes[up].children)
        else:
            up, siblings = 0, 1
        own_text, in_up = max(text[i], 1.0), max(text[up], 1.0)
        rows.append(
            (own[i], text[i], text[i] / total, link[i] / own_text, below[i], text[i] / below[i], paragraphs[i], forms[i] / below[i],
             x.depth, siblings, place[i] / siblings, text[i] / in_up, text[i] / max(longest[i], 1.0), alike[i] / siblings,
             text[up] / total, link[up] / in_up, paragraphs[up], text[up] / below[up], own[i] / max(widest, 1.0), titled[up], apart[i], named[i])
        )
        if x.tag in _TAG_AT:
            out[i, _TAG_AT[x.tag]] = 1
        for t in x.tokens:
            out[i, SHAPES + len(TAGS) + sum(t.encode()) % HASHED] = 1
        for t in above[i]:
            out[i, SHAPES + len(TAGS) + HASHED + t] = 1
    out[:, :SHAPES] = rows
    out[:, :2] = np.log1p(out[:, :2])
    return out


_TAG_AT = {t: SHAPES + i for i, t in enumerate(TAGS)}


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Whether each block is main, under the best labelling without contradictions."""
    nodes = page.nodes
    n = len(nodes)
    main, other = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
    # Best sums with and below each block, for it being around, main or other. Text right under
    # an "around" block counts as other.
    around = [o - 0.7 if x.text else -0.05 for x, o in zip(nodes, other, strict=True)]
    plain = [x.tag in PLAIN and not x.tokens and 2 * x.link <= x.text for x in nodes]
    leaving = [PLAIN_LEAVING if p else 0.0 if x.tokens or x.tag in APART else LEAVING for p, x in zip(plain, nodes, strict=True)]
    entering = [0.0 if p and nodes[x.parent].tag in ("body", "html") else ENTERING for p, x in zip(plain, nodes, strict=True)]
    apart = [False] * n
    for i, x in enumerate(nodes):
        if x.tag in APART or (i and apart[x.parent]):
            apart[i], entering[i] = True, APART_ENTERING
    # One main part of a page is free: ``spared[i]`` is what that saves below block i, by which child.
    spared = [(0.0, -1)] * n
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        paid = max(around[i], other[i], main[i] - entering[i])
        around[up] += paid
        spared[up] = max(spared[up], (max(around[i] + spared[i][0], main[i]) - paid, i))
        main[up] += max(main[i], other[i] - leaving[i])
        other[up] += other[i]
    kept = [False] * n
    kinds = [0] * n  # 0 around, 1 main, 2 other; the root is around
    frees = [False] * n
    frees[0] = True
    for i in range(1, n):
        up = nodes[i].parent
        above = kinds[up]
        kind = 2
        if above == 1:
            kind = 1 if main[i] >= other[i] - leaving[i] else 2
        elif above == 0:
            frees[i] = frees[up] and spared[up][1] == i
            enters, saves = (0.0, spared[i][0]) if frees[i] else (entering[i], 0.0)
            kind = max((main[i] - enters, 1), (around[i] + saves, 0), (other[i], 2), key=lambda k: k[0])[1]
        kinds[i], kept[i] = kind, kind == 1
    return kept


# --- training ---------------------------------------------------------------------------


def weak_labels(page: Page) -> np.ndarray | None:
    """Labels from the page's own elements: main inside ``article`` or ``main``; none if it has neither."""
    nodes = page.nodes
    inside = np.zeros(len(nodes), bool)
    cut = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        up = x.parent
        if x.label is not None:
            inside[i], cut[i] = x.label == "1", x.label == "0"
        elif up >= 0:
            cut[i] = cut[up] or x.tag in ("nav", "footer", "aside", "form") or any(t in OTHER_TOKENS for t in x.tokens)
            inside[i] = (inside[up] or x.tag in ("article", "main")) and not cut[i]
    return inside if inside.any() else None


def withheld(page: Page, tag: str) -> Page:
    """The page with its main elements called ``tag``, and without the names that give main text away."""
    out = copy.copy(page)
    out.nodes = [
        replace(x, tag=tag if x.tag in ("article", "main") else x.tag, tokens=[t for t in x.tokens if t not in MAIN_TOKENS])
        for x in page.nodes
    ]
    return out


def layout(rng: random.Random, blocks: list[str], noise: list[str]) -> str:
    """A made-up page with these main blocks; ``data-y`` tells main (1) and other (0)."""
    say = lambda: escape(rng.choice(noise)) if noise else "x"
    short = lambda: " ".join(say().split()[: rng.randint(1, 4)])
    links = lambda: "<ul>" + "".join(f"<li><a href='#'>{short()}</a></li>" for _ in range(rng.randint(3, 8))) + "</ul>"

    def other(kind: str) -> str:
        tag, names = {
            "menu": (rng.choice(["nav", "div", "div"]), ["menu", "nav", "navbar", "main-menu", "breadcrumbs"]),
            "head": (rng.choice(["header", "div"]), ["header", "masthead", "site-header", "topbar"]),
            "foot": (rng.choice(["footer", "div"]), ["footer", "site-footer", "copyright", "legal"]),
            "side": (rng.choice(["aside", "div", "section"]), ["sidebar", "widget", "related", "rail", "side"]),
            "note": (rng.choice(["div", "section", "aside"]), ["cookie-notice", "consent", "notice", "alert", "popup"]),
            "ad": (rng.choice(["div", "section", "aside"]), ["ad", "advert", "promo", "sponsored", "banner"]),
            "form": ("form", ["search", "newsletter", "subscribe", "login"]),
            "talk": (rng.choice(["section", "div", "ol"]), ["comments", "comment-list", "discussion", "replies"]),
        }[kind]
        named = f' class="{rng.choice(names)}"' if tag in ("div", "section", "ol") or rng.random() < 0.6 else ""
        inner = {
            "menu": links,
            "head": lambda: f"<h1>{short()}</h1>" + (links() if rng.random() < 0.5 else ""),
            "foot": lambda: f"<p>{say()}</p>" if rng.random() < 0.5 else say(),
            "side": lambda: f"<h3>{short()}</h3>" + rng.choice([links, lambda: f"<p>{say()}</p>"])(),
            "note": lambda: f"<p>{say()}</p>",
            "ad": lambda: rng.choice([say, lambda: f"<p>{say()}</p>", lambda: f"<a href='#'>{say()}</a>"])(),
            "form": lambda: f"<label>{short()}</label><input><p>{say()}</p>",
            "talk": lambda: "".join(
                f"<div class=\"{rng.choice(['comment', 'reply', 'comment-body'])}\"><p>{say()}</p></div>" for _ in range(rng.randint(1, 5))
            ),
        }[kind]()
        return f'<{tag}{named} data-y="0">{inner}</{tag}>'

    body = []
    for i, b in enumerate(blocks):
        tag = rng.choice(["h1", "h2"]) if i == 0 else rng.choice(["p"] * 8 + ["h2", "blockquote", "li"])
        piece = f"<{tag}>{escape(b)}</{tag}>"
        body.append(f"<ul>{piece}</ul>" if tag == "li" else piece)
        if rng.random() < 0.06:
            body.append(other(rng.choice(["ad", "side", "note", "form"])))
    if rng.random() < 0.3:
        body.append(other("talk"))
    plain = [("div", ""), ("section", ""), ("div", f' class="c{rng.randrange(99)}"'), ("div", f' id="b{rng.randrange(99)}"')]
    tag, named = rng.choice(plain) if rng.random() < 0.6 else rng.choice(
        [("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'),
         ("div", ' class="entry"'), ("section", ' class="story"'), ("div", ' class="article-body"'), ("div", ' class="post-content"')]
    )
    core = f'<{tag}{named} data-y="1">{"".join(body)}</{tag}>'
    if rng.random() < 0.4:
        core = f"<div>{core}{other('side') if rng.random() < 0.5 else ''}</div>"
    before = [other(k) for k in ("note", "head", "menu", "ad", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("talk", "side", "ad", "form", "foot") if rng.random() < 0.5]
    return f"<html><head><title>{short()}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def train_on(pages: list[str], layouts: int = LAYOUTS_PER_PAGE, seed: int = 5) -> gbt.Trees:
    """Fit on pages in memory and on made-up layouts of their texts."""
    rng = random.Random(seed)
    x, y = [], []

    def add(page: Page, *more: Page) -> None:
        labels = weak_labels(page)
        if labels is not None:
            for p in (page, *more):
                x.append(features(p))
                y.append(labels.astype(float))

    texts, noise = [], []
    for html in pages:
        page = parse(html)
        # Structure has to do where no name helps, so names are withheld from two copies of three.
        add(page, withheld(page, "div"), withheld(page, "section"))
        labels = weak_labels(page)
        blocks = page.blocks()
        main = [t for b, t in blocks if labels is not None and labels[b]]
        if main:
            texts.append(main)
        noise += [t for b, t in blocks if labels is None or not labels[b]]
        noise += [" ".join(t.split()[:20]) for t in main[-2:]]
    texts = texts or [["A title", "Some words of text that could stand on a page.", "And some more of them, to fill it."]]
    noise = noise or ["Some other words."]
    for main in texts:
        for _ in range(layouts):
            add(parse(layout(rng, main, noise)))
    return gbt.fit(np.concatenate(x), np.concatenate(y), trees=50, depth=4)


def train(pages: DataFrame, key: str, html: str, sample: int = SAMPLE_PAGES) -> gbt.Trees:
    """Learn from about ``sample`` pages of at most 20,000 characters each, chosen by hash of the key."""
    usable = pages.select(key, html).filter((F.length(html) > 0) & (F.length(html) <= MAX_SAMPLE_CHARS))
    n = max(1, usable.count())
    chosen = usable.filter(unit_hash(F.col(key)) < sample / n).orderBy(F.xxhash64(key), html).toArrow()
    return train_on(chosen.column(1).to_pylist())


def extract_texts(pages: list[str], trees: gbt.Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    rows = [features(p) for p in parsed]
    probability = trees.probabilities(np.concatenate(rows))
    out, at = [], 0
    for page, r in zip(parsed, rows, strict=True):
        main = decode(page, probability[at : at + len(r)])
        at += len(r)
        out.append("\n".join(t for b, t in page.blocks() if main[b]))
    return out


def extract(pages: DataFrame, trees: gbt.Trees, html: str = "html") -> DataFrame:
    """Add ``text``, the main text; ``html`` goes."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    pages = K.without(pages, *([] if html.lower() == "text" else ["text"]))
    rest = K.without(pages, html)

    def work(batch, texts):
        column = batch.column(batch.schema.get_field_index(html)).fill_null("").to_pylist()
        yield K.added(batch.drop_columns([html]), text=pa.array(extract_texts(column, shared.value), pa.string()))

    return pages.mapInArrow(K.map_slices(html, work), K.schema_with(rest, "text string"))
