r"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A page becomes a tree of block elements. Each gets features: tag, tokens of class, id and role, depth, text and link density
of its subtree, and how it compares with its siblings and the page. Boosted trees, trained here on generated pages of many
layouts whose main text is known (`training_pages`, a fixed number), give the probability that a node holds main text.
Decoding picks the labelling of the whole tree with the greatest total log likelihood among those in which nothing below a
rejected node is taken. Narrow plan: no shuffle; a page's HTML is read whole.

Text of taken nodes: character references decoded, white space inside a block turned into one space and trimmed; blocks are
joined in page order by one \n.

Defined cases: null, empty or blank HTML gives an empty text; a run of text in the body itself is a node like any other; where
no node is taken the text is empty; the text of formulas (math) counts, but for their annotations; fallback content of
object, canvas, audio and video doesn't; time is linear in the page, whatever is unclosed or stray, and features are held
for 2^14 nodes at once, so a very long page needs a few hundred bytes for each of its blocks; of equal likelihoods the
labelling that rejects is taken; broken markup is repaired as far as unclosed, stray and nested tags go; page ids may be null or repeat; empty tables
give empty results; other columns are kept in `row`.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|[^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of the HTML standard: elements without content, of raw text, never shown as text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
HIDDEN = frozenset("noscript template object svg annotation annotation-xml select button canvas audio video".split())  # with tags inside
ANY_HIDDEN = re.compile("<(?:" + "|".join(sorted(HIDDEN)) + r")\b", re.I)
#: Nodes whose features are held at once.
CHUNK = 1 << 14
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head".split())
ENDS_P = BLOCK - frozenset("body html head caption legend li dd dt td th tr tbody thead tfoot summary figcaption".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}

# Attribute tokens that name a page's parts.
PARTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip topbar tabs",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "header masthead banner logo branding hero top",
    "side": "sidebar aside rail widget widgets related recommended trending popular secondary complementary more",
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion promoted adsense adslot dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning disclaimer paywall subscribe newsletter signup toast",
    "comment": "comment comments disqus reply replies respond discussion reviews feedback commentlist thread",
    "form": "form login search contact register input field",
    "share": "share sharing social follow tags tag meta byline author",
    "main": "article content main post entry story body text page blog news prose richtext",
}
PART_OF = {w: p for p, ws in PARTS.items() for w in ws.split()}
PART_NAMES = tuple(PARTS)
TAG_GROUPS = {"text": "text", "nav": "nav menu", "foot": "footer", "head": "header", "aside": "aside", "main": "article main", "form": "form fieldset", "list": "ul ol dl", "item": "li dt dd", "p": "p blockquote pre", "h": "h1 h2 h3 h4 h5 h6", "table": "table tbody thead tr caption", "cell": "td th", "figure": "figure figcaption", "more": "details summary"}
TAG_OF = {t: g for g, ts in TAG_GROUPS.items() for t in ts.split()}
TAG_NAMES = tuple(TAG_GROUPS)
FEATURES = (*(f"tag_{t}" for t in TAG_NAMES), *(f"own_{p}" for p in PART_NAMES), *(f"above_{p}" for p in PART_NAMES), *"above_tag depth chars link_density words_per_block commas paragraphs nodes share_of_parent share_of_page place siblings like_siblings blocks".split())


#: Log-likelihood that a rejected node must gain over a taken one where its parent is taken.
SWITCH = 1.5


_NONE: frozenset = frozenset()


class Node:
    __slots__ = ("tag", "parent", "parts", "children", "items", "chars", "links", "blocks", "marks", "paragraphs", "nodes", "depth", "above", "boxed", "place", "taken", "left")

    def __init__(self, tag: str, parent: Node | None, parts: frozenset):
        self.tag, self.parent, self.parts = tag, parent, parts
        self.children: list[Node] | tuple = ()  # most nodes have none
        self.items: list[str | Node] = []  # blocks of own text, and children, in page order
        self.chars = self.links = self.blocks = self.marks = self.paragraphs = self.nodes = 0
        self.depth = parent.depth + 1 if parent else 0
        # what lies above: named parts, and whether a menu, footer or the like; the place among its siblings
        self.above: frozenset = _NONE
        self.boxed = self.place = 0
        self.taken = self.left = 0.0  # log-likelihoods, see decode()

    def add(self, child: Node) -> None:
        child.place = len(self.children)
        if self.children:
            self.children.append(child)
        else:
            self.children = [child]
        self.items.append(child)


def _parts(attributes: str) -> frozenset:
    if "=" not in attributes:
        return _NONE
    return frozenset(PART_OF[w] for m in ATTRIBUTE.finditer(attributes) for w in (x.lower() for x in WORD.findall(m[1] or m[2] or m[3] or "")) if w in PART_OF)


def _hidden(page: str) -> dict[int, int]:
    """Start and end of the elements in HIDDEN that have an end tag of their own, before the block around them ends."""
    out: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    names: Counter[str] = Counter()  # of the open ones, so that a stray end tag costs nothing
    skip_to = 0
    for m in TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        if m[2]:
            name = m[2].lower()
            if m[3].rstrip().endswith("/"):
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, m.end())
                skip_to = stop.end() if stop else len(page)
            elif name in HIDDEN or name in BLOCK:
                opened.append((name, m.start()))
                names[name] += 1
        elif m[1] and ((name := m[1].lower()) in HIDDEN or name in BLOCK) and names[name]:
            while True:
                last, start = opened.pop()
                names[last] -= 1
                if last == name:
                    break
            if name in HIDDEN:
                out[start] = m.end()
    return out


def parse(page: str) -> Node:
    """The tree of block elements below a body."""
    root = Node("body", None, frozenset())
    now, stack = root, []  # stack: open elements (name, node that was current before it)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name, and of all blocks
    blocks: list[int] = []
    run: list[str] = []
    linked = run_links = 0

    def flush() -> None:
        nonlocal run, run_links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                now.items.append(text)
                now.chars += len(text)
                now.links += min(run_links, len(text))
                now.blocks += 1
                now.marks += text.count(",") + text.count(".")
                if now is root:  # a node like any other
                    now.chars = now.links = now.blocks = now.marks = 0
                    own = Node("text", now, frozenset())
                    own.items.append(now.items.pop())
                    own.chars, own.links, own.blocks, own.marks = len(text), min(run_links, len(text)), 1, text.count(",") + text.count(".")
                    now.add(own)
            run, run_links = [], 0

    def close(upto: int) -> None:
        nonlocal now, linked
        if blocks and blocks[-1] >= upto:
            flush()
        for name, before in reversed(stack[upto:]):
            now = before
            linked -= name == "a"
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
        del stack[upto:]

    hidden = _hidden(page) if ANY_HIDDEN.search(page) else {}
    at, skip_to = 0, 0
    for m in TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if linked:
                run_links += len(piece.strip())
        at = m.end()
        end, name = m[1], m[2]
        if end:
            end = end.lower()
            if end == "p" and not places["p"] or end == "br":
                flush() if end == "p" else run.append(" ")
                continue
            if places[end] and (end in BLOCK or not blocks or places[end][-1] > blocks[-1]):  # an inline end tag does not close a block
                close(places[end][-1])
            if end in BLOCK:
                flush()
        elif name:
            name = name.lower()
            if name in RAW:
                if not m[3].rstrip().endswith("/"):
                    stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                    at = skip_to = stop.end() if stop else len(page)
                continue
            if name in HIDDEN:  # without an end tag of its own, what follows is judged like the rest
                if m.start() in hidden:
                    at = skip_to = hidden[m.start()]
                continue
            if name == "br":
                run.append(" ")
                continue
            if name in BLOCK:
                if name == "head":  # nothing of a head is shown; its end may be missing
                    stop = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                    if stop:
                        at = skip_to = stop.end()
                    continue
                if name in ("html", "body"):
                    continue
                if name in ENDS_P:
                    if blocks and stack[blocks[-1]][0] == "p":
                        close(blocks[-1])
                elif name in CLOSES:
                    mine, walls = CLOSES[name]
                    wall = max((places[w][-1] for w in walls if places[w]), default=-1)
                    ends = [places[x][i] for x in mine.split() if (i := bisect_right(places[x], wall)) < len(places[x])]
                    if ends:
                        close(min(ends))
                flush()
                if name == "hr":
                    continue
            if name in VOID:
                continue
            if name in BLOCK:
                child = Node(name, now, _parts(m[3]))
                now.add(child)
                blocks.append(len(stack))
                places[name].append(len(stack))
                stack.append((name, now))
                now = child
            else:
                places[name].append(len(stack))
                stack.append((name, now))
                linked += name == "a"
    if at < len(page):
        run.append(page[at:])
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes but the root, parents before children; sums over subtrees are set on the way."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.children)
    for n in reversed(out):
        n.paragraphs += n.tag == "p"
        n.nodes += 1
        if (p := n.parent) is not None:
            for name in ("chars", "links", "blocks", "marks", "paragraphs", "nodes"):
                setattr(p, name, getattr(p, name) + getattr(n, name))
    return out[1:]


def features(root: Node, nodes: list[Node]) -> Iterator[np.ndarray]:
    """Features of the nodes, CHUNK of them at a time, parents before children."""
    base = len(TAG_NAMES) + 2 * len(PART_NAMES)
    total = max(root.chars, 1)
    tags: dict[int, Counter] = {}
    for at in range(0, len(nodes), CHUNK):
        x = np.zeros((min(CHUNK, len(nodes) - at), len(FEATURES)))
        for row, n in zip(x, nodes[at : at + CHUNK], strict=True):
            p = n.parent
            parts_above, tag_above = p.above, p.boxed
            n.above = parts_above | n.parts if n.parts else parts_above
            n.boxed = max(tag_above, n.tag in ("nav", "footer", "aside", "header", "form"))
            if n.tag in TAG_OF:
                row[TAG_NAMES.index(TAG_OF[n.tag])] = 1
            for k in n.parts:
                row[len(TAG_NAMES) + PART_NAMES.index(k)] = 1
            for k in parts_above:
                row[len(TAG_NAMES) + len(PART_NAMES) + PART_NAMES.index(k)] = 1
            siblings = p.children
            if id(p) not in tags:
                tags[id(p)] = Counter(c.tag for c in siblings)
            row[base:] = (tag_above, n.depth, math.log1p(n.chars), n.links / max(n.chars, 1), n.chars / max(n.blocks, 1), n.marks / (n.chars / 50 + 1), math.log1p(n.paragraphs), math.log1p(n.nodes), n.chars / max(p.chars, 1), n.chars / total, n.place / max(len(siblings) - 1, 1), math.log1p(len(siblings)), tags[id(p)][n.tag] / len(siblings), math.log1p(n.blocks))
            if n.place == len(siblings) - 1:  # the last one that asks
                del tags[id(p)]
        yield x


class BoostedTrees:
    """Logistic boosting of trees of fixed depth on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 70, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.depth, self.trees = depth, []
        b = self._bin(x)
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        f = np.full(len(y), self.start)
        width = bins + 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at, tree = np.zeros(len(y), np.int64), []
            for level in range(depth):
                size = 1 << level
                best, gain = np.zeros((size, 2), np.int64), np.full(size, -1.0)
                for j in range(b.shape[1]):
                    key = at * width + b[:, j]
                    gs, hs = (np.bincount(key, v, size * width).reshape(size, width) for v in (g, h))
                    gl, hl = np.cumsum(gs, 1), np.cumsum(hs, 1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    score = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    k = score.argmax(1)
                    s = score[np.arange(size), k]
                    better = s > gain + 1e-12
                    best[better], gain[better] = np.column_stack([np.full(size, j), k])[better], s[better]
                tree.append(best)
                at = 2 * at + (b[np.arange(len(y)), best[at, 0]] > best[at, 1])
            leaf = np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge) * rate
            self.trees.append((tree, leaf))
            f += leaf[at]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        if not len(x):
            return f
        b, rows = self._bin(x), np.arange(len(x))
        for tree, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for best in tree:
                at = 2 * at + (b[rows, best[at, 0]] > best[at, 1])
            f += leaf[at]
        return f


def decode(root: Node, nodes: list[Node], odds: np.ndarray) -> str:
    """The text of the likeliest labelling without a taken node below a rejected one."""
    for n, o in zip(reversed(nodes), reversed(odds), strict=True):
        o = max(-30.0, min(30.0, float(o)))
        n.taken = -math.log1p(math.exp(-o)) + sum(max(c.taken, c.left - SWITCH) for c in n.children)
        n.left = -math.log1p(math.exp(o)) + sum(c.left for c in n.children)
    chosen = lambda n: n.taken > n.left - (SWITCH if n.parent is not root else 0)
    out, todo = [], [c for c in reversed(root.children) if chosen(c)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif chosen(item):
            todo += reversed(item.items)
    return "\n".join(out)


def training_pages(n: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of generated pages. Main words begin with m, all others don't, so labels follow from the text."""
    r = random.Random(seed)
    word = lambda first: first + "".join(r.choice("aeioubcdlnrst") for _ in range(r.randint(1, 8)))
    some = lambda k, first="x": " ".join(word(first) + r.choice(["", "", "", "", "", ",", "."]) for _ in range(k))
    out = []
    for _ in range(n):
        plain = r.random() < 0.35  # no telling tags
        tag = lambda t, p=plain: "div" if p or r.random() < 0.3 else t

        def name(*options, often=0.8):
            return f' {r.choice(["class", "class", "id"])}="{r.choice(options)}"' if r.random() < often else ""

        def links(k):
            return "<ul>" + "".join(f'<li><a href="/{i}">{some(r.randint(1, 3))}</a></li>' for i in range(k)) + "</ul>"

        def box(t, attr, body):
            return f"<{t}{attr}>{body}</{t}>"

        def figures(first):
            """A table, figure, disclosure, list of terms, preformatted text or linked line."""
            kind, words = r.random(), lambda most: some(r.randint(1, most), first)
            if kind < 0.35:
                cols, head = r.randint(1, 4), r.random() < 0.6
                rows = ["".join(f"<{'th' if head and not i else 'td'}>{words(6)}</{'th' if head and not i else 'td'}>" for _ in range(cols)) for i in range(r.randint(1, 6))]
                rows = "".join(f"<tr>{x}</tr>" for x in rows)
                return f"<table>{f'<caption>{words(5)}</caption>' if r.random() < 0.3 else ''}{f'<tbody>{rows}</tbody>' if r.random() < 0.5 else rows}</table>"
            if kind < 0.6:
                return f'<figure><img src="/i.png" alt="x">{f"<figcaption>{words(15)}</figcaption>" if r.random() < 0.8 else ""}</figure>'
            if kind < 0.8:
                inside = words(40) if r.random() < 0.3 else "".join(f"<p>{words(40)}</p>" for _ in range(r.randint(1, 2)))
                return f"<details{r.choice(['', ' open'])}><summary>{words(6)}</summary>{inside}</details>"
            if kind < 0.88:
                return "<dl>" + "".join(f"<dt>{words(3)}</dt><dd>{words(15)}</dd>" for _ in range(r.randint(1, 3))) + "</dl>"
            return f"<pre>{words(30)}</pre>" if kind < 0.95 else f'<p><a href="#">{words(8)}</a></p>'

        paragraphs = []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind, k = r.random(), r.choice([2, 5, 20, 40, 80, 150])
            if kind < 0.6:
                paragraphs.append(f"<p>{some(k, 'm')}</p>")
            elif kind < 0.67:
                paragraphs.append(f"<p><b>{some(r.randint(2, 9), 'm')}<br>")
            elif kind < 0.73:
                paragraphs.append(f"<h2>{some(r.randint(1, 6), 'm')}</h2>")
            elif kind < 0.79:
                paragraphs.append("<ul>" + "".join(f"<li>{some(r.randint(2, 15), 'm')}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.82:
                paragraphs.append(f"<blockquote>{some(20, 'm')}</blockquote>")
            elif kind < 0.85:
                paragraphs.append(f'<p>{some(15, "m")} <a href="#">{some(2, "m")}</a> {some(9, "m")}</p>')
            else:
                paragraphs.append(figures("m"))
        extra = lambda chance, s: s if r.random() < chance else ""
        ad = box("div", name("ad", "ads", "advert", "sponsored", "promo", often=0.95), some(r.choice([3, 8, 20])) if r.random() < 0.8 else figures("x"))
        share = box("div", name("share", "social", often=0.9), links(3))
        inner = f"<h1>{some(r.randint(2, 12), 'm')}</h1>" * (r.random() < 0.8) + "".join(p + extra(0.05, ad) for p in paragraphs) + extra(0.15, share)
        comments = box(tag("section"), name("comments", "comment-list", "discussion", "replies", often=0.95), f"<h3>{some(2)}</h3>" + "".join(box("div", name("comment", "reply", often=0.9), f"<p>{some(r.randint(4, 50))}</p>") for _ in range(r.randint(1, 6))))
        form = f"<form>{some(3)}<input type=text><button>{some(1)}</button><p>{some(r.randint(2, 12))}</p></form>"
        article = box(tag("article"), name("article", "content", "post", "entry-content", "story", often=0.5), inner + extra(0.15, comments) + extra(0.1, form))
        if r.random() < 0.4:
            article = box(tag("main"), name("main", "content", "page", often=0.6), article + extra(0.3, comments))
        nav = box(tag("nav"), name("nav", "menu", "navbar", often=0.9 if plain else 0.4), links(r.randint(2, 9)))
        header = box(tag("header"), name("header", "masthead", "banner", often=0.9 if plain else 0.4), some(r.randint(1, 8)) + extra(0.4, nav))
        side = box(tag("aside"), name("sidebar", "widget", "related", often=0.9 if plain else 0.5), f"<h3>{some(2)}</h3>" + r.choice([links(4), f"<p>{some(r.randint(5, 60))}</p>"]) + extra(0.25, figures("x")))
        notice = box("div", name("cookie-notice", "notice", "alert", "newsletter", "popup", often=0.97), f"<p>{some(r.randint(4, 40))}</p>")
        footer = box(tag("footer"), name("footer", "site-footer", "copyright", often=0.95 if plain else 0.3), r.choice([f"&copy; {some(4)} &middot; {some(r.randint(3, 20))}", f"<p>{some(r.randint(3, 30))}</p>", links(4)]))
        top = [extra(0.6, header), extra(0.7, nav), extra(0.3, notice), extra(0.6, ad)]
        bottom = [extra(0.4, side), extra(0.3, comments), extra(0.2, form), extra(0.2, ad), extra(0.15, notice)]
        r.shuffle(top)
        r.shuffle(bottom)
        if r.random() < 0.2:
            top.append(bottom.pop())
        body = "".join(top) + article + "".join(bottom) + extra(0.9, footer)
        if r.random() < 0.3:
            body = box("div", name("wrapper", "container", "page"), body)
        page = f"<html><head><title>{some(4)}</title></head><body>{body}</body></html>"
        out.append((page, " ".join(re.findall(r"\bm[a-z]+", page.split("<body>")[1]))))
    return out


def loose_pages(n: int = 300, seed: int = 12) -> list[tuple[str, str]]:
    """Like training_pages; main text and some of the rest lie in the body itself."""
    r = random.Random(seed)
    word = lambda first: first + "".join(r.choice("aeioubcdlnrst") for _ in range(r.randint(1, 8)))
    some = lambda k, first="x": " ".join(word(first) + r.choice(["", "", "", "", "", ",", "."]) for _ in range(k))
    line = lambda: " | ".join(f'<a href="/{i}">{some(r.randint(1, 3))}</a>' for i in range(r.randint(2, 7)))
    out = []
    for _ in range(n):
        parts = [f"<h1>{some(r.randint(1, 9), 'm')}</h1>" * (r.random() < 0.8)]
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            kind = r.random()
            if kind < 0.6:
                parts.append("<br>".join(some(r.choice([2, 4, 12, 30, 80]), "m") for _ in range(r.randint(1, 3))) + r.choice(["<hr>", "<br><br>", ""]))
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{some(r.randint(1, 12), 'm')}</li>" for _ in range(3)) + "</ul>")
            else:
                parts.append(r.choice([f"<p>{some(20, 'm')}</p>", f"<h2>{some(r.randint(1, 5), 'm')}</h2>"]))
        top = [f"<nav>{line()}</nav>", f"<header>{some(r.randint(1, 6))}</header>", line() + "<hr>", f'<div class="menu"><ul><li>{line()}</li></ul></div>'][r.randrange(4)] * (r.random() < 0.7)
        bottom = [f"<footer>&copy; {some(r.randint(2, 9))}</footer>", f'<div class="footer"><p>{some(6)}</p></div>', "<hr>" + line(), f"<hr>&copy; {some(r.randint(1, 5))}", f'<div class="comments"><p>{some(12)}</p></div>'][r.randrange(5)] * (r.random() < 0.7)
        body = f"{top}{''.join(parts)}{bottom}"
        out.append((f"<html><head><title>{some(4)}</title></head><body>{body}</body></html>", " ".join(re.findall(r"\bm[a-z]+", re.sub(r"<[^>]*>", " ", body)))))
    return out


def menu_pages(n: int = 60, seed: int = 13) -> list[tuple[str, str]]:
    """Pages without main text: menus of links in the body itself, with a word or two beside them."""
    r = random.Random(seed)
    word = lambda: "x" + "".join(r.choice("aeioubcdlnrst") for _ in range(r.randint(1, 8)))
    some = lambda k: " ".join(word() for _ in range(k))
    out = []
    for _ in range(n):
        links = [f'<a href="/{i}">{some(r.randint(1, 3))}</a>' for i in range(r.randint(1, 12))]
        body = r.choice([" | ", " ", "<br>", " &middot; ", "<hr>"]).join(links)
        body = r.choice([body, f"{some(1)}: {body}", f"<p>{body}</p>", f"<div>{body}</div>", f"{body}<hr>&copy; {some(2)}", "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"])
        out.append((f"<html><head><title>{some(4)}</title></head><body>{body}</body></html>", ""))
    return out


@cache
def model() -> BoostedTrees:
    """A node's label: whether its subtree has main text."""
    xs, ys = [], []

    def has_main(n: Node) -> bool:
        return any(has_main(i) if isinstance(i, Node) else i.startswith("m") for i in n.items)

    for page, _ in (*training_pages(), *loose_pages(), *menu_pages()):
        root = parse(page)
        nodes = nodes_of(root)
        xs += features(root, nodes)
        ys += [has_main(n) for n in nodes]
    return BoostedTrees(np.concatenate(xs), np.array(ys, float))


def extract(pages: list[str], trees: BoostedTrees) -> list[str]:
    """Main texts of pages; small pages share a call of the trees."""
    out: list[str] = [""] * len(pages)
    held: list[tuple[int, Node, list[Node]]] = []
    for i, page in enumerate(pages):
        if page and not page.isspace():
            root = parse(page)
            held.append((i, root, nodes_of(root)))
        if held and (i == len(pages) - 1 or sum(len(n) for _, _, n in held) >= CHUNK):
            odds = _odds(held, trees)
            for (k, root, nodes), own in zip(held, odds, strict=True):
                out[k] = decode(root, nodes, own)
            held = []
    return out


def _odds(held: list[tuple[int, Node, list[Node]]], trees: BoostedTrees) -> list[np.ndarray]:
    sizes, parts, small = [len(n) for _, _, n in held], [], []
    for _, root, nodes in held:
        for x in features(root, nodes):
            small.append(x)
            if sum(map(len, small)) >= CHUNK:
                parts.append(trees.log_odds(np.concatenate(small)))
                small = []
    if small:
        parts.append(trees.log_odds(np.concatenate(small)))
    odds = np.concatenate([np.zeros(0), *parts])
    return np.split(odds, np.cumsum(sizes)[:-1])


def html_extract(pages: DataFrame) -> DataFrame:
    """pages (html, ...) -> `row` (the input columns as a struct) and text."""
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "h", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(extract(text_of(b, "h").to_pylist(), trees), pa.string())], ["row", "text"])

    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col("html").alias("h"))
    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, text string")


def digest(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", "html")
    out = html_extract(rows)
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("bigint").alias("n_chars"))
