"""Main text of web pages, by gradient-boosted trees over the nodes of the document.

A page becomes a tree of block elements with the runs of text in them. Each node has features of its subtree (text
length and its share of the page, density, links, punctuation), its attribute names and those above it, its depth, and
its siblings and those of its parents. The trees give the log-odds that a node holds main text. Decoding takes a
node only below taken ancestors: bottom up, a node is worth its log-odds and what its children are worth where that is
positive, and nodes worth more than nothing are taken top down. So no kept text stands in a rejected part, and no kept
part is without text. The article is the lowest node that holds nearly all that was taken. In it, every block and every
bare run of text is kept unless it stands below a part that is named as something else; in an article that
no name marks as one, the trees decide on blocks too.

A name speaks against a node only if it stands for a part: names of a state (``has-comments``, ``share-enabled``),
names on the body, and those of a wrapper that holds the article and most of the page say nothing, and neither does
a header within an article.

The trees learn from up to ``SAMPLE_PAGES`` distinct pages, those with the smallest hashes, that name their parts (an article
element, a role or a class of ``CONTENT``); copies of them with these names hidden, and with links, lists and bare
text added to the article and other lines to the page, teach the trees to do without. If no page names its parts, each
teaches by its densest part instead; if there is none at all, blocks that are neither named otherwise nor mostly links are kept.

Defined results: a null or empty page, or one without main text, gives an empty text; an empty table an empty result. Blocks
keep the order of the page, white space within a block is one space, character references are decoded. Comments, scripts,
styles and form controls are never text. Markup that is not closed ends with its parent. Repeated rows each get a row, ties need
no rule, other columns are ignored, and a very long page is read whole (but teaches nothing beyond SAMPLE_BYTES).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.boosting import BoostedTrees

SAMPLE_PAGES, SAMPLE_BYTES = 200, 1 << 20
BLOCKS = frozenset(
    "html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary hr dialog".split())
#: Never text, up to their end tag. A head needs no rule of its own: what may stand in it is silent or void, and
#: anything else ends it, with or without an end tag.
SILENT = "script|style|noscript|template|title|svg|iframe|object|select|textarea|button|canvas|audio|video"
#: Of these, the ones that run to the end of the page if they have no end tag; of others only the tag is left out.
UNENDED = frozenset("script style title iframe textarea".split())
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in SILENT.split("|")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes open elements of the value.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CONTENT = frozenset("article main content post entry story body text maintext articlebody blogpost".split())
BOILERPLATE = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside ad ads advert advertisement sponsor sponsored promo banner "
    "cookie cookies consent notice notices newsletter subscribe signup login form search comment comments reply disqus share social "
    "related recommended breadcrumb breadcrumbs pagination popup modal widget toolbar copyright legal complementary contentinfo".split())
FEW = 40
#: Comments may outgrow an article: holding most of a page doesn't clear them.
REMARKS = frozenset("comment comments reply replies disqus respond".split())
#: A name with one of these tells how a page is, not what a part is.
STATES = frozenset("has is with without no not enabled disabled active open closed show hide hidden on off allow".split())
HEADLINES = frozenset("h1 h2".split())
#: Elements that name a part by themselves.
PARTS = frozenset("nav footer aside header dialog".split())
#: Blocks that say nothing by themselves about being a part of the page.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption hr".split())
LEGAL = re.compile(r"©|\(c\) ?\d|copyright|all rights reserved|tous droits|alle rechte|derechos reservados", re.I)
TAG = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{SILENT})(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"[^\s\"']+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?,;:]")
KINDS = {k: n for n, group in enumerate((
    "text", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "article main", "section div body html",
    "table thead tbody tfoot tr td th caption", "header footer nav aside form fieldset dialog")) for k in group.split()}
NAMED = (2, 3, 4, 5)
KIND_ABOVE = -2


class Node:
    __slots__ = ("tag", "parent", "children", "text", "good", "bad", "remark", "depth", "links", "chars", "marks", "tags", "start")

    def __init__(self, tag: str, parent, text: str = "", attrs: str = "", start: int = 0):
        self.tag, self.parent, self.children, self.text, self.start = tag, parent, [], text, start
        self.good, self.bad, self.remark = int(tag in ("article", "main")), int(tag in BOILERPLATE), False
        if attrs and ("=" in attrs):
            for name in (n for a in ATTRIBUTE.findall(attrs) for n in NAME.findall(a)):
                words = {w.lower() for w in WORD.findall(name)}
                if words & STATES:
                    continue
                if words & BOILERPLATE:
                    self.bad += 1
                    self.remark |= bool(words & REMARKS)
                elif words & CONTENT:
                    self.good += 1
        self.depth = parent.depth + 1 if parent else 0
        self.links = self.chars = self.marks = self.tags = 0
        if parent:
            parent.children.append(self)


def _sum_up(nodes: list[Node]) -> list[Node]:
    """Totals of every element from the runs of text below it, and names that say nothing cleared."""
    holds: dict[Node, bool] = {}
    for node in nodes:
        if node.tag != "text":
            node.chars = node.links = node.marks = node.tags = 0
    for node in reversed(nodes):
        if up := node.parent:
            up.chars += node.chars
            up.links += node.links
            up.marks += node.marks
            up.tags += node.tags + 1
            if holds.get(node) or node.tag == "h1" or node.good and not node.bad:
                holds[up] = True
    total, within = nodes[0].chars, {}
    for node in nodes:
        up = node.parent
        within[node] = bool(up) and (within[up] or bool(up.good and not up.bad))
        if not node.bad or node.remark:
            continue
        article = holds.get(node, False)
        if (node.tag in ("html", "body") or article and 2 * node.chars >= total
                or node.tag not in PARTS and 10 * node.chars >= 7 * total and node.links < 0.3 * node.chars
                or node.tag == "header" and within[node] and any(c.tag in HEADLINES for c in _below(node))):
            node.bad = 0
    return nodes


def _below(node: Node) -> Iterator[Node]:
    todo = list(node.children)
    while todo:
        below = todo.pop()
        yield below
        todo += below.children


def parse(page: str | None) -> list[Node]:
    """All nodes in page order, the root first; runs of text are nodes with the tag "text"."""
    root = Node("html", None)
    nodes, here, parts, linked, in_link, at, tags = [root], root, [], 0, False, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, linked, tags
        text = " ".join("".join(parts).split())
        if text:
            node = Node("text", here, text, start=at)
            node.chars, node.links, node.tags = len(text), min(linked, len(text)), tags
            node.marks = len(SENTENCE.findall(text))
            nodes.append(node)
        parts, linked, tags = [], 0, 0

    def put(raw: str) -> None:
        nonlocal linked
        piece = html.unescape(raw) if "&" in raw else raw
        parts.append(piece)
        if in_link:
            linked += len(piece)

    unended: set[str] = set()
    while m := TAG.search(page, at):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
                raw = m["raw"].lower()
                # Only foreign elements can be closed by their own tag.
                if raw in unended or raw == "svg" and m[0].endswith("/>"):
                    continue
                if end := ENDS[raw].search(page, at):
                    at = end.end()
                elif raw in UNENDED:
                    at = len(page)
                else:
                    unended.add(raw)
            continue
        tag = tag.lower()
        tags += 1
        if tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here, in_link = up.parent, False
            continue
        if tag in ("html", "body") and here is not root:
            continue
        shut = CLOSES.get(tag, {"p"})
        while here.tag in shut:
            here = here.parent
        if tag == "html" or tag in VOID:
            continue
        here = Node(tag, here, attrs=m["attrs"] or "", start=at)
        nodes.append(here)
    if at < len(page):
        put(page[at:])
    flush()
    return _sum_up(nodes)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node. Columns NAMED hold what the attributes and tags name."""
    rows, seen, beside = [], {}, {None: (0.0, 0.0, 0.0, 0.0)}
    length, total = max(1, nodes[-1].start), max(1, nodes[0].chars)
    for node in nodes:
        last = 0.0
        for child in node.children:
            # Before the child: how much plain text its sibling has; the one after it is filled in below.
            beside[child] = (
                (node.links - child.links) / max(1, node.chars - child.chars), np.log1p(node.chars - child.chars), last, 0.0)
            last = np.log1p(child.chars - child.links)
        last = 0.0
        for child in reversed(node.children):
            beside[child] = (*beside[child][:3], last)
            last = np.log1p(child.chars - child.links)
    beside.setdefault(nodes[0], beside[None])
    for node in nodes:
        up = node.parent
        above = up.parent if up else None
        good, bad = seen.get(up, (0, 0))
        seen[node] = good + node.good, bad + node.bad
        siblings = up.children if up else [node]
        chars = max(1, node.chars)
        rows.append((
            node.depth, KINDS.get(node.tag, 9), node.good, node.bad, good, bad, np.log1p(node.chars),
            node.links / chars, node.marks / chars, node.chars / (node.tags + 1), min(len(node.children), 6),
            min(len(siblings), 6), (up.links / max(1, up.chars)) if up else 0.0,
            (up.chars / (up.tags + 1)) if up else 0.0, node.start / length, node.chars / total, (up.chars / total) if up else 1.0,
            (above.chars / total) if above else 1.0, *beside[node], *beside[up], *beside[above],
            KINDS.get(up.tag, 9) if up else 9,
            float(bool(LEGAL.search(node.text))) if node.tag == "text" else
            float(node.chars < 300 and any(LEGAL.search(c.text) for c in node.children)),
        ))
    return np.array(rows, np.float64)


def _labels(nodes: list[Node], inside: dict[Node, bool]) -> np.ndarray:
    """1 for every run of text inside and not below a part named otherwise, and for all that holds one."""
    barred, labels, number = {}, np.zeros(len(nodes)), {n: k for k, n in enumerate(nodes)}
    for node in nodes:
        barred[node] = barred.get(node.parent, False) or node.bad > 0
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.tag == "text" and inside[node] and not barred[node]:
            labels[k] = 1
        if labels[k] and node.parent:
            labels[number[node.parent]] = 1
    return labels


def _taught(nodes: list[Node]) -> np.ndarray | None:
    """Whether each node holds main text, for a page that names its parts; None for others."""
    inside = {}
    for node in nodes:
        named = node.good > 0 and not node.bad and node.tag not in ("html", "body")
        inside[node] = inside.get(node.parent, False) or named
    return _labels(nodes, inside) if any(inside[n] and n.chars for n in nodes) else None


def _densest(nodes: list[Node]) -> np.ndarray | None:
    """The same, guessed for a page without names: the part whose own paragraphs hold most text outside links."""
    plain = {n: sum(c.chars - c.links for c in n.children if c.tag in PLAIN) for n in nodes if not n.bad}
    if not plain or not max(plain.values()):
        return None
    part, inside = max(plain, key=plain.get), {}
    for node in nodes:
        inside[node] = inside.get(node.parent, False) or node is part
    return _labels(nodes, inside)


def _run(parent: Node, text: str, linked: bool) -> Node:
    node = Node("text", parent, text, start=parent.start)
    node.chars, node.tags, node.marks = len(text), int(linked), len(SENTENCE.findall(text))
    node.links = len(text) if linked else 0
    return node


def _enriched(nodes: list[Node], drawn: np.random.Generator) -> list[Node]:
    """The page with what articles and pages may hold besides: links, lists and bare text; notices below."""
    root = nodes[0]
    words = [w for n in nodes if n.tag == "text" for w in n.text.split()[:40]] or ["word"]
    some = lambda low, high: " ".join(drawn.choice(words, drawn.integers(low, high)))
    parts = [n for n in nodes if n.good and not n.bad and n.tag not in ("html", "body") and n.chars]
    article = max(parts, key=lambda n: n.chars) if parts else None

    def put(parent: Node, tag: str, text: str, linked: bool, at: int | None = None) -> None:
        block = Node(tag, parent, start=parent.start)
        _run(block, text, linked)
        if at is not None:
            parent.children.insert(at, parent.children.pop())

    if article:
        for _ in range(3):
            put(article, "p", some(1, 9), True, int(drawn.integers(0, len(article.children) + 1)))
        items = Node(str(drawn.choice(["ul", "ol"])), article, start=article.start)
        article.children.insert(int(drawn.integers(0, len(article.children))), article.children.pop())
        for k in range(int(drawn.integers(1, 5))):
            put(items, "li", some(1, 7), k % 3 < 2)
        put(article, "p", some(1, 4), False)
        for tag, at in (("h1", 0), ("h2", int(drawn.integers(1, len(article.children)))), ("h3", int(drawn.integers(1, len(article.children))))):
            put(article, tag, " ".join(w.strip(".,;:!?") for w in some(1, 8).split()) or "word", False, at)
        _run(article, some(2, 20), False)
        # Parts named as something else: prose as in comments, a line as in adverts, links as in lists of related pages.
        for tag, blocks, low, high in (("section", 3, 8, 70), ("div", 1, 3, 14), ("div", 4, 1, 5)):
            part = Node(tag, article, start=article.start)
            part.bad = 1
            article.children.insert(int(drawn.integers(1, len(article.children) + 1)), article.children.pop())
            for _ in range(blocks):
                put(part, "p" if high > 5 else "li", some(low, high), high <= 5)
    home = article.parent if article else root
    year = str(1990 + int(drawn.integers(0, 45)))
    for text in (f"© {year} {some(1, 4)}", f"Copyright {year} {some(1, 4)}. All rights reserved."):
        put(home, str(drawn.choice(["p", "div"])), text, False)
    for _ in range(2):
        menu = Node(str(drawn.choice(["ul", "div"])), home, start=0)
        home.children.insert(0, home.children.pop())
        for _ in range(int(drawn.integers(3, 8))):
            put(menu, "li", some(1, 3), True)
    return _in_order(root)


def _in_order(root: Node) -> list[Node]:
    ordered, todo = [], [root]
    while todo:
        node = todo.pop()
        node.depth = node.parent.depth + 1 if node.parent else 0
        ordered.append(node)
        todo += reversed(node.children)
    for k, node in enumerate(ordered):
        node.start = k
    return _sum_up(ordered)


def _flattened(nodes: list[Node], labels: np.ndarray) -> tuple[list[Node], np.ndarray]:
    """The page without the elements that wrap its article: the blocks stand beside menus and notices."""
    known = dict(zip(nodes, labels.tolist(), strict=True))
    for node in nodes[1:]:
        if known[node] and node.tag not in PLAIN and node.tag not in ("text", "html", "body"):
            at = node.parent.children.index(node)
            node.parent.children[at : at + 1] = node.children
            for child in node.children:
                child.parent = node.parent
    ordered = _in_order(nodes[0])
    return ordered, np.array([known[n] for n in ordered])


def _views(nodes: list[Node], labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of a page as it is named, without the names of content, without any, and with parts named as others."""
    x = features(nodes)
    plain, nameless = x.copy(), x.copy()
    kinds = np.where(np.isin(x[:, 1], (KINDS["article"], KINDS["nav"])), KINDS["div"], x[:, 1])
    plain[:, [2, 4]], plain[:, 1] = 0, np.where(x[:, 1] == KINDS["article"], KINDS["div"], x[:, 1])
    nameless[:, NAMED], nameless[:, 1] = 0, kinds
    above = np.where(np.isin(x[:, KIND_ABOVE], (KINDS["article"], KINDS["nav"])), KINDS["div"], x[:, KIND_ABOVE])
    plain[:, KIND_ABOVE] = np.where(x[:, KIND_ABOVE] == KINDS["article"], KINDS["div"], x[:, KIND_ABOVE])
    nameless[:, KIND_ABOVE] = above
    yield x, labels
    yield plain, labels
    # Without names nothing tells comments from the article: those parts teach nothing here.
    tell = x[:, 3] + x[:, 5] == 0
    yield nameless[tell], labels[tell]
    # Some parts of the main text named as something else, as adverts and comments in an article are.
    named, off = x.copy(), labels.copy()
    number = {n: k for k, n in enumerate(nodes)}
    for k, node in enumerate(nodes):
        if node.tag == "text" and labels[k] and k % 5 == 0 and node.parent and node.parent.tag in PLAIN:
            up = number[node.parent]
            named[up, 5 if k % 2 else 3] += 1
            named[k, 5] += 1
            off[[k, up]] = 0
    yield named, off


def train(pages: list[str]) -> BoostedTrees | None:
    """Trees from pages that name their parts, or else from the densest parts; None if there is no text to learn from."""
    pages = [page for page in pages if parse(page)[0].chars]
    for teach in (_taught, _densest):
        rows, labels = [], []
        for number, page in enumerate(pages):
            drawn = np.random.default_rng(number)
            # Few pages teach by more copies each.
            for enriched in (False, *[True] * max(1, FEW // len(pages))):
                nodes = _enriched(parse(page), drawn) if enriched else parse(page)
                if (taught := teach(nodes)) is not None:
                    views = list(_views(nodes, taught))
                    if enriched:
                        views = [views[0], views[2], list(_views(*_flattened(nodes, taught)))[2]]
                    for x, y in views:
                        rows.append(x), labels.append(y)
        if rows:
            return BoostedTrees().fit(np.concatenate(rows), np.concatenate(labels))
    return None


def margins_of(trees: BoostedTrees | None, x: np.ndarray) -> np.ndarray:
    if trees is not None:
        return trees.margin(x)
    return np.where((x[:, 3] + x[:, 5] == 0) & (x[:, 7] < 0.5), 1.0, -1.0)


def decode(nodes: list[Node], margins: np.ndarray) -> list[str]:
    """Texts of the runs that are taken, in page order."""
    worth = {}
    for node, margin in zip(reversed(nodes), reversed(margins.tolist()), strict=True):
        below = sum(max(0.0, worth[c]) for c in node.children)
        worth[node] = margin + below if node.tag == "text" or below > 0 else -1.0
    root = nodes[0]
    taken = {root: worth[root] > 0}
    for node in nodes[1:]:
        taken[node] = taken[node.parent] and worth[node] > 0
    article = _article(nodes, taken)
    inside = {root: root is article}
    for node in nodes[1:]:
        up = node.parent
        inside[node] = inside[up] or node is article
        if not inside[up] or taken[node] or not taken[up]:
            continue
        # Whole articles: what their own markup gives no reason to leave out stays.
        if node.tag == "text":
            taken[node] = not LEGAL.search(node.text) or bool(article.good)
        else:
            taken[node] = bool(article.good) and not node.bad and (node.tag in PLAIN or node.tag == "header")
    return [node.text for node in nodes if node.tag == "text" and taken[node]]


def _article(nodes: list[Node], taken: dict[Node, bool]) -> Node | None:
    """The lowest node that holds four fifths of the taken text, None if nothing is taken."""
    held: dict[Node, int] = {}
    for node in reversed(nodes):
        held[node] = held.get(node, 0) + (node.chars if node.tag == "text" and taken[node] else 0)
        if node.parent:
            held[node.parent] = held.get(node.parent, 0) + held[node]
    here = nodes[0] if held[nodes[0]] else None
    while here:
        # A single paragraph is no article: its parent is.
        lower = [c for c in here.children if 5 * held[c] >= 4 * held[nodes[0]] and c.tag != "text" and c.tag not in PLAIN]
        if not lower:
            return here
        here = lower[0]
    return None


def fit(pages: DataFrame, html_col: str = "html"):
    """The trees, as a broadcast variable. The same pages teach whatever the order and number of their rows."""
    page = F.col(f"`{html_col}`")
    hashed = pages.where(page.isNotNull() & (F.octet_length(page) <= SAMPLE_BYTES)).select(F.xxhash64(page).alias("h"), page.alias("page"))
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    found = hashed.where(F.col("h").isin(lowest)).groupBy("h").agg(F.min("page").alias("page")).collect() if lowest else []
    return pages.sparkSession.sparkContext.broadcast(train([r["page"] for r in sorted(found)]))


def extract(pages: DataFrame, trees, columns: list[str], html_col: str = "html") -> DataFrame:
    """The given columns of every page, its main text and the number of its code points."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, parsed, tables = [], [], []
            for page in frame.column(len(columns)).to_pylist():
                parsed.append(parse(page))
                tables.append(features(parsed[-1]))
            margins = margins_of(trees.value, np.concatenate(tables)) if tables else np.zeros(0)
            at = 0
            for nodes in parsed:
                texts.append("\n".join(decode(nodes, margins[at : at + len(nodes)])))
                at += len(nodes)
            yield pa.RecordBatch.from_arrays(
                [*frame.columns[: len(columns)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*columns, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*columns, html_col).mapInArrow(task, f"{kinds}, text string, n_chars long")
