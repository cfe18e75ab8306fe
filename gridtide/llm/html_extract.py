"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Each page becomes a tree of its block elements and of inline elements that carry a class, id or role.
A node is described by its subtree's density (text, links, tags, paragraphs, sentences), its tag, the
tokens of its attributes, depth, place and siblings. Boosted trees give each node the probability that
it holds main text. Decoding takes the labels of highest joint probability under one rule: no node is
kept below a dropped one. It is exact, one pass up and one down the tree.

There are no labelled pages, so the trees are fitted on seeds: within a bounded sample of pages
(``SAMPLE_PAGES``, ``SAMPLE_NODES`` of each), elements that say what they are (an article, a menu, a
footer) label the nodes in and around them. Every seed is used again without tag and attribute
features, so that density alone decides where a page says nothing, and main text once more as if it
stood in a menu, notice, advert or the like, as no main text.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one space. Scripts, styles, heads and form controls never count as text; hidden
and embedded elements (math, object, svg, noscript and the like) are judged like any other. Null and
empty pages, and pages without main text, give an empty text. One row per input row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridtide.functions.columns import field
from gridtide.llm import boosting, labelled
from gridtide.llm.batches import map_texts

SAMPLE_PAGES, SAMPLE_NODES = 600, 60

# Element names by their role in a page.
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Scripts, styles, what stands in the head, and the controls of forms hold no text of a page.
NO_TEXT = "button datalist embed frameset head iframe input noframes option script select style template textarea title".split()
ENDS_P = set(BLOCKS) - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Attribute tokens that tell what an element is for.
MAIN_TOKENS = set("article articlebody story entry content post posttext body main text blog blogpost richtext mainbody".split())
SIDE_TOKENS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments "
    "disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form footer foot "
    "copyright header masthead topbar menu nav navbar navigation navbox pager pagination sidebar side aside widget related recommended share "
    "sharing social toolbar tags meta legal disclaimer skip reply replies responses feedback trending popular teaser".split()
)
SIDE_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
MAIN_TAGS = {"article", "main"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK, _VOID, _NO_TEXT = set(BLOCKS), set(VOID), set(NO_TEXT)
FEATURES = 27
# Columns of the node's own and its ancestors' tags and tokens.
NAMED = slice(0, 9)
MAIN_OWN, SIDE_TAG, SIDE_TOKEN, ABOVE_SIDE, TEXT_TAG, PARAGRAPHS = [0, 2], 1, 3, 5, 8, 18


class _Open:
    """An open element."""

    __slots__ = ("at", "blocks", "linked", "node", "shown", "tag", "there")

    def __init__(self, tag: str, at: int, blocks: int, node: int, shown: bool, linked: bool) -> None:
        # ``at`` grows with the depth; ``blocks`` counts the open blocks up to and with this one.
        self.tag, self.at, self.blocks = tag, at, blocks
        self.node, self.shown, self.linked = node, shown, linked
        self.there = True


class Page(HTMLParser):
    """Tree of a page in document order: parents come before children.

    Every tag costs the same however many elements are open: the open elements of each name are a
    stack of their own.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.main, self.side = ["#root"], [-1], [0], [0]
        self.links = [0]
        self.inner = [0]
        self.runs: list[tuple[int, int, bool, str]] = []
        self.block = 0
        root = _Open("#root", 0, 0, 0, True, False)
        self.open: list[_Open] = [root]
        self.named: defaultdict[str, list[_Open]] = defaultdict(list, {"#root": [root]})
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.named["p"]:
            self._close(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        above = self.open[-1]
        node = above.node
        self.inner[node] += 1
        if tag in _BLOCK or tag == "br":
            self.block += 1
        if tag in _VOID:
            return
        named = dict(attrs)
        words = " ".join(filter(None, (named.get(k) for k in ("class", "id", "itemprop", "data-component"))))
        role = (named.get("role") or "").lower()
        if tag in _BLOCK or words or role:
            tokens = {t.lower() for t in _TOKEN.findall(words)}
            node = self._node(tag, node)
            self.main[node] = len(tokens & MAIN_TOKENS) + (role in ("main", "article"))
            self.side[node] = len(tokens & SIDE_TOKENS) + (role in SIDE_ROLES)
        shown, linked = above.shown and tag not in _NO_TEXT, above.linked or tag == "a"
        new = _Open(tag, above.at + 1, above.blocks + (tag in _BLOCK), node, shown, linked)
        self.open.append(new)
        self.named[tag].append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK or tag == "br":
            self.block += 1
        if not self.named[tag]:
            return
        element = self.named[tag][-1]
        if tag not in _BLOCK and self.open[-1].blocks > element.blocks:
            # An inline end tag does not close blocks: then only the element itself ends.
            self.named[tag].pop()
            element.there = False
        else:
            self._end(element)

    def handle_data(self, data):
        top = self.open[-1]
        if top.shown:
            self.runs.append((top.node, self.block, top.linked, data))

    def _end(self, element: _Open) -> None:
        """The element ends, and all that is open above it."""
        while True:
            top = self.open.pop()
            if top.there:
                self.named[top.tag].pop()
            if top is element:
                break
        while not self.open[-1].there:
            self.open.pop()

    def _close(self, names, stop):
        """The innermost open element of these names ends, unless one of ``stop`` is open inside it."""
        found = max((self.named[name][-1] for name in names if self.named[name]), key=lambda e: e.at, default=None)
        if found is None or any(self.named[name][-1].at > found.at for name in stop if self.named[name]):
            return
        self._end(found)
        self.block += 1

    def _node(self, tag, parent):
        self.tag.append(tag)
        self.parent.append(parent)
        for values in (self.main, self.side, self.links, self.inner):
            values.append(0)
        return len(self.tag) - 1


def describe(page: Page) -> np.ndarray:
    """Features of every node."""
    count = len(page.tag)
    parent = np.array(page.parent)
    text, linked, words, stops, runs, first = (np.zeros(count) for _ in range(6))
    seen = 0
    for node, _, in_link, data in page.runs:
        size = len(data.strip())
        if not size:
            continue
        if not runs[node]:
            first[node] = seen
        seen += size
        runs[node] += 1
        text[node] += size
        words[node] += data.count(" ") + 1
        stops[node] += data.count(". ") + data.count(", ") + data.endswith((".", "!", "?"))
        if in_link:
            linked[node] += size
    own = text.copy()
    tag = page.tag
    depth, tags = np.zeros(count), np.ones(count) + np.array(page.inner)
    paragraphs = np.array([t == "p" for t in tag], dtype=float)
    side = np.array([s > 0 or t in SIDE_TAGS for s, t in zip(page.side, tag)], dtype=float)
    main = np.array([m > 0 or t in MAIN_TAGS for m, t in zip(page.main, tag)], dtype=float)
    above_side, above_main, below_main, below_side = np.zeros(count), np.zeros(count), main.copy(), side.copy()
    children, order = np.zeros(count), np.zeros(count)
    up = parent.tolist()
    for node in range(1, count):
        p = up[node]
        depth[node] = depth[p] + 1
        above_side[node] = max(above_side[p], side[p])
        above_main[node] = max(above_main[p], main[p])
        order[node] = children[p]
        children[p] += 1
    begin = np.where(runs > 0, first, np.inf)
    for node in range(count - 1, 0, -1):
        p = up[node]
        for values in (text, linked, words, stops, tags, paragraphs, runs):
            values[p] += values[node]
        begin[p] = min(begin[p], begin[node])
        below_main[p] = max(below_main[p], below_main[node])
        below_side[p] = max(below_side[p], below_side[node])
    whole = max(1.0, text[0])
    begin = np.where(np.isfinite(begin), begin, whole)
    siblings = children[parent]
    around = text[parent]
    kinds = [
        [t in MAIN_TAGS for t in tag],
        [t in SIDE_TAGS for t in tag],
        page.main,
        page.side,
        above_main,
        above_side,
        below_main,
        below_side,
        [t in ("p", "blockquote", "pre", "h1", "h2", "h3") for t in tag],
    ]
    shape = [
        depth,
        np.log1p(text),
        np.log1p(own),
        text / whole,
        linked / np.maximum(1, text),
        text / tags,
        words / tags,
        stops / np.maximum(1, words),
        np.log1p(stops),
        paragraphs,
        text / np.maximum(1, runs),
        begin / whole,
        siblings,
        order / np.maximum(1, siblings),
        text / np.maximum(1, around),
        [t in ("ul", "ol", "li", "menu", "dl") for t in tag],
        [t in ("h1", "h2", "h3", "h4") for t in tag],
        np.log1p(tags),
    ]
    return np.array([*kinds, *shape], dtype=np.float64).T


def seeds(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose own or surrounding elements say what they are, and 1 where they hold main text."""
    count = len(page.tag)
    state = [0] * count
    marked = any(t in MAIN_TAGS for t in page.tag) or any(page.main)
    size = [0] * count
    for node, _, linked, data in page.runs:
        size[node] += 0 if linked else len(data.strip())
    for node in range(1, count):
        up = state[page.parent[node]]
        if up == -1 or page.tag[node] in SIDE_TAGS or page.side[node] > page.main[node]:
            state[node] = -1
        elif up == 1 or page.tag[node] in MAIN_TAGS or page.main[node] > 0 or (not marked and size[node] >= 140):
            state[node] = 1
    label = [s if own else 0 for s, own in zip(state, size)]
    for node in range(count - 1, 0, -1):
        label[node] = label[node] or (state[node] if state[node] < 0 else 0)
        up = page.parent[node]
        if label[node] == 1 or label[up] == 0:
            label[up] = label[node]
    known = np.flatnonzero(label)
    return known, (np.array(label)[known] > 0).astype(np.int64)


def decode(parent: list[int], chance: np.ndarray) -> np.ndarray:
    """Most probable labels in which no kept node has a dropped ancestor; the root is kept."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(chance).tolist(), np.log1p(-chance).tolist()
    for node in range(len(parent) - 1, 0, -1):
        up = parent[node]
        keep[up] += max(keep[node], drop[node])
        drop[up] += drop[node]
    kept = [True] * len(parent)
    for node in range(1, len(parent)):
        kept[node] = kept[parent[node]] and keep[node] > drop[node]
    return np.array(kept)


def render(page: Page, kept: np.ndarray) -> str:
    blocks: list[str] = []
    held: list[str] = []
    last = -1
    for node, block, _, data in page.runs:
        if not kept[node]:
            continue
        if block != last:
            blocks.append("".join(held))
            held, last = [], block
        held.append(data)
    blocks.append("".join(held))
    return " ".join(" ".join(block.split()) for block in blocks if not block.isspace() and block)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html", **options) -> boosting.Trees:
    """Trees from the seeds of a bounded sample of distinct pages, chosen by hash.

    Raises if there are pages but none was chosen, which a sample of this size does not meet by chance.
    """
    html = pages.select(field(html_col).alias("html")).filter("html IS NOT NULL")
    count = html.select(F.xxhash64("html")).distinct().count()
    html = html.filter(labelled.share(F.xxhash64("html"), sample_pages, count)).distinct()

    def start():
        def work(keys, texts):
            labels, rows = [], []
            for text in texts:
                page = Page(text)
                known, label = seeds(page)
                if len(known) > SAMPLE_NODES:
                    take = np.linspace(0, len(known) - 1, SAMPLE_NODES).astype(int)
                    known, label = known[take], label[take]
                labels += label.tolist()
                rows += describe(page)[known].tolist()
            yield labels, rows

        return work

    found = map_texts(html, start, "label bigint, x array<double>", binary=False).toPandas()
    labelled.require_some(len(found), html, count)
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, FEATURES)
    y = found["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    return boosting.fit(*varied(x, y), **{"trees": 40, "depth": 5, **options})


def varied(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds, the seeds as elements of no telling name, the seeds without tags and attributes, and
    main text put into side elements.

    The last ones count as no main text: an advert inside an article may be as dense as the article.
    """
    bare = x.copy()
    bare[:, NAMED] = 0
    nameless = x.copy()
    nameless[:, PARAGRAPHS] = np.maximum(0, x[:, PARAGRAPHS] - x[:, TEXT_TAG])
    nameless[:, TEXT_TAG] = 0
    rows, labels = [x, nameless, bare], [y, y, y]
    for column in (SIDE_TAG, SIDE_TOKEN, ABOVE_SIDE):
        for source in (x, bare):
            moved = source[y > 0].copy()
            moved[:, MAIN_OWN] = 0
            moved[:, column] = 1
            rows.append(moved)
            labels.append(np.zeros(len(moved)))
    return np.vstack(rows), np.concatenate(labels)


def extract(
    pages: DataFrame, model: boosting.Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url and text of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def start():
        def work(keys, texts):
            trees = [Page(text or "") for text in texts]
            rows = [describe(page) for page in trees]
            chance = shared.value.scores(np.vstack(rows)) if rows else np.empty(0)
            out, low = [], 0
            for page, features in zip(trees, rows):
                out.append(render(page, decode(page.parent, chance[low : low + len(features)])))
                low += len(features)
            yield keys[0], keys[1], out

        return work

    rows = pages.select(field(id_col).alias("page_id"), field(url_col).alias("url"), field(html_col).alias("html"))
    return map_texts(rows, start, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string", binary=False)
