"""Main-text extraction: gradient-boosted trees over DOM nodes, then hierarchical decoding.

Each page's markup becomes a tree of block elements, of inline elements with a class or an id, and of text that stands
directly beside blocks; every node gets features of its tag, its attribute tokens, its subtree (text, tags, links,
paragraphs), its depth, its siblings and its ancestors. Boosted trees (Spark ML) give each node the probability that it
holds main text. Decoding picks the most probable set of nodes that is closed upwards: a node can only be kept if its
parent is, so an ancestor's and a descendant's choice never contradict each other.

The trees are trained on pages that a generator composes from random layouts with known roles (TRAINING_PAGES).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table

TRAINING_PAGES = 1200
TREES, TREE_DEPTH = 30, 5

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_MARKED = re.compile(r"(?<![a-zA-Z_:-])(?:class|id)\s*+=", re.I)
_HUGE = re.compile(r"&#0*+[0-9]{8,};?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist textarea button".split())
_RAW = frozenset("script style title textarea iframe noscript".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar tabs pagination pager",
    "head": "header masthead banner logo brand",
    "foot": "footer colophon copyright legal",
    "side": "sidebar aside widget rail related recommended trending popular promo teaser more",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored dfp taboola outbrain",
    "note": "cookie cookies consent notice notification alert popup modal overlay gdpr subscribe newsletter signup paywall",
    "talk": "comment comments reply replies respond discussion disqus thread",
    "form": "form search login register input",
    "share": "share sharing social follow tweet like",
    "main": "article content post entry story body main text page",
}
_GROUP_OF = {w: k for k, words in enumerate(_GROUPS.values()) for w in words.split()}
_TAGS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section"), ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",),
         ("form", "fieldset"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption"),
         ("#text",), ("a",), tuple(sorted(_INLINE - {"a"})))
#: Where text beside blocks becomes a node of its own.
_CONTAINERS = frozenset("body div section main article center form aside header footer nav td".split())
_TAG_OF = {t: k for k, tags in enumerate(_TAGS) for t in tags}


@dataclass
class Node:
    tag: str
    attributes: str
    parent: int
    depth: int
    place: int  #: among its siblings
    children: list[int] = field(default_factory=list)
    chars: int = 0  #: of text in the subtree
    link_chars: int = 0
    tags: int = 0
    stops: int = 0  #: sentence ends in the subtree
    paragraphs: int = 0
    roles: set = field(default_factory=set)  #: of training text


def _markup(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, name, attributes) of each tag; name begins with '/' for end tags and is empty for comments and
    declarations. Every character is looked at a bounded number of times: a tag ends at the next '>' outside quotes, a
    quote that is never closed is a plain character, and markup that never ends takes the rest of the page."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    part = re.compile(r"[^>\"']*+")
    while (begin := page.find("<", at)) >= 0:
        m = _NAME.match(page, begin + 1)
        if not m:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            elif page[begin + 1 : begin + 2] in ("!", "?", "/") and begin + 1 < n:
                end = page.find(">", begin + 1)
                at = end + 1 if end >= 0 else n
            else:  # a plain '<'
                at = begin + 1
                continue
            yield begin, at, "", ""
            continue
        k = m.end()
        while True:
            k = part.match(page, k).end()
            if k == n or page[k] == ">":
                break
            k = page.find(page[k], k + 1) + 1 if k < last[page[k]] else k + 1
        at = min(n, k + 1)
        yield begin, at, m[0].lower(), page[m.end() : k]


def _plain(text: str) -> str:
    """Character references decoded, white space turned into single spaces."""
    if "&" in text:
        text = html.unescape(_HUGE.sub("\ufffd", text))
    return " ".join(text.split())


def parse(page: str) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """The tree and, in page order, the blocks: (node, raw text) of each piece of a block. Unclosed and stray tags are
    mended as browsers do for the common cases; nothing inside scripts, styles, comments or form fields is text. Takes
    time in proportion to the page, whatever it holds."""
    nodes = [Node("body", "", -1, 0, 0)]
    blocks: list[list[tuple[int, str]]] = []
    open_: list[tuple[str, int]] = [("body", 0)]  # elements and the node they write to
    bases = [0]  # where in open_ the blocks are
    places: dict[str, list[int]] = {"body": [0]}  # of each name in open_
    run: list[tuple[int, str]] = []
    fresh: list[int] = []  # inline nodes of the run that hang from its block
    parents: set[int] = set()  # blocks that hold blocks
    never: set[str] = set()  # elements without text that are not closed any more
    at = skip = 0

    def add(tag: str, attributes: str, up: int) -> int:
        nodes.append(Node(tag, attributes, up, nodes[up].depth + 1, len(nodes[up].children)))
        nodes[up].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def flush(by_block: bool = False) -> None:
        owner = open_[bases[-1]][1]
        if any(t.strip() for _, t in run):
            if owner == 0 or nodes[owner].tag in _CONTAINERS and (by_block or owner in parents):
                if fresh:
                    del nodes[owner].children[-len(fresh) :]
                text = add("#text", "", owner)
                for k, i in enumerate(fresh):
                    nodes[i].parent, nodes[i].depth, nodes[i].place = text, nodes[text].depth + 1, k
                nodes[text].children.extend(fresh)
                run[:] = [(text if i == owner else i, t) for i, t in run]
            for i, t in run:
                t = _plain(t)
                nodes[i].chars += len(t)
                nodes[i].stops += sum(map(t.count, ".!?"))
            blocks.append(run.copy())
        run.clear()
        fresh.clear()

    def close(to: int) -> None:
        for tag, _ in open_[to:]:
            places[tag].pop()
        del open_[to:]
        while bases[-1] >= to:
            bases.pop()

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(open_))
        open_.append((tag, node))

    for begin, end, name, attributes in _markup(page):
        if begin < skip:
            continue
        if begin > at:
            text, node = page[at:begin], open_[-1][1]
            run.append((node, text))
            if places.get("a"):
                nodes[node].link_chars += len(text.strip())
        at = end
        if not name:
            continue
        if name[0] == "/":
            tag = name[1:]
            where = places.get(tag)
            if tag in _INLINE:
                if where and where[-1] > bases[-1]:
                    close(where[-1])
            else:
                flush()
                if where and where[-1]:
                    close(where[-1])
            continue
        tag = name
        nodes[open_[-1][1]].tags += 1
        if tag == "br":
            run.append((open_[-1][1], " "))
        elif tag in _RAW or tag in _UNSEEN:
            if not attributes.endswith("/") and tag not in never:
                over = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                if not over:
                    never.add(tag)
                at = skip = over.end() if over else (len(page) if tag in _RAW else at)
            run.append((open_[-1][1], " "))
        elif tag in ("html", "body"):
            nodes[0].attributes += attributes
        elif tag in _VOID:
            flush() if tag == "hr" else None
        elif tag in _INLINE:
            if tag == "a" and places.get("a") and places["a"][-1] > bases[-1]:
                close(places["a"][-1])
            node = open_[-1][1]
            if _MARKED.search(attributes):
                up, node = node, add(tag, attributes, node)
                if up == open_[bases[-1]][1]:
                    fresh.append(node)
            if not attributes.endswith("/"):
                push(tag, node)
        else:
            flush(True)
            block = open_[bases[-1]][0]
            if tag in _CLOSES_P and block == "p":
                close(bases[-1])
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and places.get(tag):
                if not any(places.get(t) and places[t][-1] > places[tag][-1] for t in ("ul", "ol", "table", "dl")):
                    close(places[tag][-1])
            up = open_[-1][1]
            parents.add(open_[bases[-1]][1])
            node = add(tag, attributes, up)
            if not attributes.endswith("/"):
                bases.append(len(open_))
                push(tag, node)
    if at < len(page):
        run.append((open_[-1][1], page[at:]))
    flush()
    return nodes, blocks


def _top_down(nodes: list[Node]) -> list[int]:
    """Every node after its parent."""
    order = [0]
    for i in order:
        order.extend(nodes[i].children)
    return order


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node; subtree sums are filled in from the leaves up."""
    order = _top_down(nodes)
    for i in reversed(order[1:]):
        node, up = nodes[i], nodes[nodes[i].parent]
        node.paragraphs += node.tag == "p"
        up.chars += node.chars
        up.link_chars += node.link_chars
        up.tags += node.tags
        up.stops += node.stops
        up.paragraphs += node.paragraphs
    page = max(1, nodes[0].chars)
    out = np.zeros((len(nodes), 2 * len(_GROUPS) + 2 * (len(_TAGS) + 1) + 14))
    g, t = len(_GROUPS), len(_TAGS) + 1
    for i in order:
        node, row = nodes[i], out[i]
        for m in _ATTRIBUTE.finditer(node.attributes):
            if m[1].lower() in ("class", "id", "role", "itemprop"):
                for word in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()):
                    if word in _GROUP_OF:
                        row[_GROUP_OF[word]] = 1
        row[2 * g + _TAG_OF.get(node.tag, t - 1)] = 1
        if i:  # what its ancestors carry
            up = out[node.parent]
            row[g : 2 * g] = np.maximum(up[:g], up[g : 2 * g])
            row[2 * g + t : 2 * g + 2 * t] = np.maximum(up[2 * g : 2 * g + t], up[2 * g + t : 2 * g + 2 * t])
        siblings = len(nodes[node.parent].children) if i else 1
        row[2 * g + 2 * t :] = (
            node.depth, siblings, node.place / siblings, math.log1p(node.chars), node.chars / page, node.chars / (node.tags + 1),
            node.link_chars / max(1, node.chars), node.stops / max(1, node.chars) * 100, math.log1p(node.stops), math.log1p(node.paragraphs), len(node.children),
            math.log1p(node.tags), nodes[node.parent].link_chars / max(1, nodes[node.parent].chars), math.log1p(nodes[node.parent].paragraphs))
    return out


# Training pages: layouts of nested blocks whose roles are known.
_CONTAINER_NAMES = {
    "nav": (["nav", "div", "ul"], ["menu", "main-nav", "navbar", "breadcrumb", "top-menu", ""]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "banner", ""]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "colophon", ""]),
    "side": (["aside", "div", "section"], ["sidebar", "widget", "related", "right-rail", "trending", ""]),
    "ad": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "sponsored", "ad-slot", "promo"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "consent", "notice", "newsletter-signup", "alert", "paywall"]),
    "form": (["form"], ["search-form", "login", "subscribe", ""]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "discussion", "replies", "respond", "comments-area"]),
    "share": (["div", "ul"], ["share", "social", "share-buttons"]),
}
#: Words that name blocks on pages of other makers, none of them telling.
_OTHER_NAMES = "c{n} b-{n} row col-{n} texte inhalt cuerpo testo corpo tekst region wrap inner box cell js-{n} css-{n} u{n} zone grid unit x{n}y seite bloc".split()
_MAIN = (["article", "main", "div", "section"], ["article", "post-content", "entry", "story-body", "content", ""])


def training_page(rng: random.Random) -> str:
    """A random page; the words of main text begin with 'm', all others with 'x'.

    On some pages the blocks of the main text have telling names, on others none or names that tell nothing; boilerplate loses
    its name only where its element or its links tell what it is."""
    style = rng.choices(["own", "none", "other"], [0.4, 0.3, 0.3])[0]

    def named(label: str) -> str:
        """The name of a block of the main text."""
        if style == "own":
            return label
        return "" if style == "none" else rng.choice(_OTHER_NAMES).format(n=rng.randint(1, 99))

    def words(role: str, n: int) -> str:
        out = [("m" if role == "main" else "x") + "".join(rng.choices("abeilnorst", k=rng.randint(1, 9))) for _ in range(max(1, n))]
        for k in range(len(out)):
            if rng.random() < 0.1:
                out[k] += rng.choice([".", ",", "."])
        return " ".join(out) + rng.choice([".", ".", ""])

    def tag(name: str, label: str, inside: str) -> str:
        attribute = f' {rng.choice(["class", "class", "id"])}="{label}"' if label else ""
        return f"<{name}{attribute}>{inside}" + ("" if name in ("p", "li") and not label and rng.random() < 0.3 else f"</{name}>")

    def links(role: str, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(role, rng.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"

    def boilerplate(role: str) -> str:
        tags, labels = _CONTAINER_NAMES[role]
        name, label = rng.choice(tags), rng.choice(labels)
        if not label and name in ("div", "section", "ul"):
            label = rng.choice([x for x in labels if x])
        if name == "ul":
            return tag(name, label, "".join(f"<li><a href='#'>{words('x', 2)}</a></li>" for _ in range(rng.randint(3, 8))))
        text = rng.random() < 0.5
        telling = name in ("nav", "header", "footer", "aside", "form") or role in ("nav", "share") or role in ("header", "side", "footer") and text
        if telling and style != "own" and rng.random() < 0.5:
            label = named("")
        if role in ("nav", "share") or role in ("header", "side", "footer") and text:
            inside = links("x", rng.randint(2, 9))
        elif role == "form":
            inside = f"<label>{words('x', 2)}</label><input type='text'><div>{words('x', 4)}</div>"
        elif role == "comments":
            inside = "".join(tag(rng.choice(["div", "li"]), rng.choice(["comment", "comment-body", "reply"]), tag("p", "", words("x", rng.randint(5, 50)))) for _ in range(rng.randint(1, 6)))
        else:
            long = words("x", rng.randint(3, 40))
            inside = long if text or name == "p" else "".join(tag("p", "", words("x", rng.randint(4, 30))) for _ in range(rng.randint(1, 3)))
        if role in ("header", "side", "comments", "form", "footer") and name not in ("ol", "p") and rng.random() < 0.4:
            inside = tag(rng.choice(["h1", "h1", "h2"] if role == "header" else ["h2", "h3", "h4"]), "", words("x", rng.randint(1, 5))) + inside
        return tag(name, label, inside)

    def paragraph() -> str:
        body = words("main", rng.choice([1, 3, 10, 40, 120]))
        kind = rng.random()
        if kind < 0.75:
            if rng.random() < 0.15:
                body = f"<b>{body}" + rng.choice(["</b>", "<br>"])
            elif rng.random() < 0.2:
                body += f' <a {rng.choice(["", "class=link "])}href="/x">{words("main", 3)}</a>'
            elif rng.random() < 0.15:
                body += " " + tag(rng.choice(["span", "em", "small"]), rng.choice(["term", "hl", "date", "name", "lead"]), words("main", rng.randint(1, 6))) + " " + words("main", 5)
            elif rng.random() < 0.2:
                label = rng.choice(["advert", "ad-label", "sponsored", "notice", "share", "promo", "newsletter", "comment-count", "social"])
                body += " " + tag(rng.choice(["span", "small", "a"]), label, words("x", rng.randint(1, 8))) + " " + (words("main", 6) if rng.random() < 0.7 else "")
            return tag("p", "", body)
        if kind < 0.85:
            return tag(rng.choice(["h2", "h3"]), "", words("main", 4))
        if kind < 0.92:
            return tag("blockquote", "", tag("p", "", body))
        return "<ul>" + "".join(tag("li", "", words("main", rng.randint(2, 20))) for _ in range(rng.randint(2, 5))) + "</ul>"

    inner = tag("h1", "", words("main", rng.randint(2, 10))) if rng.random() < 0.8 else ""
    loose = rng.random() < 0.12  # main text without paragraphs, between breaks
    for _ in range(rng.choice([1, 2, 5, 10, 20])):
        inner += words("main", rng.choice([10, 40, 80])) + rng.choice(["<br>", "<br><br>", ""]) if loose and rng.random() < 0.7 else paragraph()
        if rng.random() < 0.06:
            inner += boilerplate(rng.choice(["ad", "share", "side", "notice"]))
        elif rng.random() < 0.08:  # a part of the text in a block of its own
            inner += tag(rng.choice(["div", "section"]), named(rng.choice(["", "text", "section-body"])), "".join(paragraph() for _ in range(rng.randint(1, 3))))
    if rng.random() < 0.2:  # comments or a notice inside the block of the text
        inner += boilerplate(rng.choice(["comments", "comments", "notice", "share"]))
    name, label = rng.choice(_MAIN[0]), rng.choice(_MAIN[1])
    if style != "own" and rng.random() < 0.7:
        name = "div"
    main = tag(name, named(label or ("post" if name in ("div", "section") and rng.random() < 0.7 else "")), inner)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
        beside = boilerplate(rng.choice(["comments", "side", "share"])) if rng.random() < 0.25 else ""
        main = tag("div", named(rng.choice(["wrapper", "container", "main", ""])), main + beside)
    before = [boilerplate(r) for r in ("header", "nav", "ad", "notice", "form", "side") if rng.random() < 0.5]
    after = [boilerplate(r) for r in ("comments", "side", "share", "ad", "form", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    if rng.random() < 0.25:  # stray text and links straight in the body
        before.insert(rng.choice([0, len(before)]), rng.choice([f"<a href='#c'>{words('x', 3)}</a>", words("x", 2), f"<a class='skip' href='#'>{words('x', 3)}</a> {words('x', 2)}"]))
    if rng.random() < 0.2:
        after.insert(rng.choice([0, len(after)]), rng.choice([words("x", rng.randint(1, 8)), f"<a href='/t'>{words('x', 3)}</a> | <a href='/u'>{words('x', 2)}</a>"]))
    if rng.random() < 0.08:  # nothing but text, or text among few blocks
        bare = rng.choice(["<br>", "\n", " "]).join(words("main", rng.choice([20, 60, 150])) for _ in range(rng.randint(1, 5)))
        return bare if rng.random() < 0.5 else f"<html><body>{''.join(before[:2])}{bare}{''.join(after[-2:])}</body></html>"
    if rng.random() < 0.06:  # no article at all
        before, main, after = before[:2], "", [boilerplate(rng.choice(["footer", "header", "nav", "side"]))]
    page = "".join(before) + main + "".join(after)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"


def training_rows(pages: int = TRAINING_PAGES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: 1 for a node whose subtree holds main text."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, blocks = parse(training_page(rng))
        main = np.zeros(len(nodes))
        for node, text in (piece for block in blocks for piece in block):
            while text.lstrip()[:1] == "m" and node >= 0 and not main[node]:
                main[node] = 1
                node = nodes[node].parent
        xs.append(features(nodes)[1:])
        ys.append(main[1:])
    return np.concatenate(xs), np.concatenate(ys)


def train(spark: SparkSession) -> list[tuple[float, list[tuple]]]:
    """Boosted trees as (weight, nodes); a node is (feature, threshold, left, right) or a leaf (-1, value, 0, 0)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    x, y = training_rows()
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], ["features", "label"]).coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=3, maxBins=32).fit(rows)

    def flatten(node, into: list[tuple]) -> int:
        here = len(into)
        into.append(())
        if node.subtreeDepth() == 0:
            into[here] = (-1, node.prediction(), 0, 0)
        else:
            split = node.split()
            into[here] = (split.featureIndex(), split.threshold(), flatten(node.leftChild(), into), flatten(node.rightChild(), into))
        return here

    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        flatten(tree._call_java("rootNode"), nodes := [])
        out.append((weight, nodes))
    return out


_trained: dict[str, list] = {}


def model_of(spark: SparkSession) -> list:
    """The trees; trained once for each application, since the training pages are always the same."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        _trained[key] = train(spark)
    return _trained[key]


class Forest:
    def __init__(self, trees: list[tuple[float, list[tuple]]]):
        self.trees = [(w, *(np.array(c) for c in zip(*nodes, strict=True))) for w, nodes in trees]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, value, left, right in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                f = feature[at]
                inner = f >= 0
                down = np.where(x[rows, np.maximum(f, 0)] <= value[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += weight * value[at]
        return 2 * total


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most probable set of kept nodes that is closed upwards; the root is always kept."""
    gain = odds.copy()  # of keeping a node and the best of its subtree, over dropping all of it
    order = _top_down(nodes)
    for i in reversed(order[1:]):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i] if nodes[i].parent else 0
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in order[1:]:
        keep[i] = keep[nodes[i].parent] and gain[i] > 0
    return keep


def _text(blocks: list[list[tuple[int, str]]], keep: np.ndarray) -> str:
    """The text of kept nodes, blocks joined by two newlines."""
    return "\n\n".join(t for block in blocks if (t := _plain("".join(x if keep[n] else " " for n, x in block))))


def rescue(nodes: list[Node], odds: np.ndarray, x: np.ndarray, own: set[int]) -> np.ndarray:
    """For a page of which no text was kept: the most probable upward-closed set with text among those that the trees would
    rather drop, unless the text is in an element or under a name of boilerplate, or is mostly links.

    own: nodes with text of their own. x: features of the nodes.
    """
    g, t = len(_GROUPS), len(_TAGS) + 1
    boiler = [_TAG_OF[tag] for tag in ("nav", "header", "footer", "aside", "form")]
    names = [k for k, group in enumerate(_GROUPS) if group != "main"]
    bad = x[:, names].any(axis=1) | x[:, 2 * g :][:, boiler].any(axis=1) | x[:, [g + k for k in names]].any(axis=1) | x[:, 2 * g + t :][:, boiler].any(axis=1)
    order = _top_down(nodes)
    gain, least, way = odds.copy(), np.full(len(nodes), -np.inf), {}
    gain[0] = 0
    for i in reversed(order):
        node = nodes[i]
        gain[i] += sum(gain[c] for c in node.children if gain[c] > 0)
        if not bad[i]:
            if i in own and node.link_chars * 2 <= node.chars:
                least[i] = gain[i]
            for c in node.children:  # what it takes to reach text below
                if (value := gain[i] + least[c] - max(0.0, gain[c])) > least[i]:
                    least[i], way[i] = value, c
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    at = 0
    while np.isfinite(least[0]) and at in way:
        at = way[at]
        keep[at] = True
    for i in order[1:]:
        keep[i] |= keep[nodes[i].parent] and gain[i] > 0 and not bad[i]
    return keep


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages: kept blocks in page order, joined by two newlines.

    Null or empty html, and pages without main text, give an empty text. Text straight in the body, beside blocks or
    without any, is a node like others. Repeated rows are extracted each; other columns are ignored; an empty table gives
    no rows.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(model_of(spark))

    def main_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(model.value)
        for batch in batches:
            texts = []
            for first in range(0, len(batch), 200):  # nodes of so many pages are scored at once
                parsed = [parse(p or "") for p in batch["html"].iloc[first : first + 200]]
                described = [features(nodes) for nodes, _ in parsed]
                odds = forest.log_odds(np.concatenate(described))
                at = 0
                for (nodes, blocks), x in zip(parsed, described, strict=True):
                    own = odds[at : at + len(nodes)]
                    at += len(nodes)
                    text = _text(blocks, decode(nodes, own))
                    if not text and nodes[0].chars:
                        text = _text(blocks, rescue(nodes, own, x, {n for block in blocks for n, t in block if t.strip()}))
                    texts.append(text)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(main_texts, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
ORACLE_SQL: dict[str, str] = {}
