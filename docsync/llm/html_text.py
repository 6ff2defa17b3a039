"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text in them; each is main text or not. A node has
weights for its features (tag, words in its class, length, links, ...) and each parent-child
pair a table of four potentials. Sum-product messages, once up and once down the tree, give
exact marginals; the text runs with a marginal of one half or more are the main text. Weights
and potentials are fitted to labelled pages by gradient ascent on the likelihood, with the
same messages.

Messages of a batch of pages are passed level by level in arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.html_pages import labelled_pages

STEPS, RATE, PENALTY = 200, 0.1, 1e-3
BATCH_NODES = 20_000

DROPPED = frozenset("script style noscript template head title svg iframe object select option textarea button".split())
# All else ends a head whose end tag is left out.
IN_HEAD = frozenset("html head title base link meta script style noscript noframes template".split())
# A second one ends the first.
NOT_NESTED = frozenset("button select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that start a block; all others are inside the text of one.
GROUPS = {
    "main": "article main", "box": "section div center details summary fieldset", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu", "item": "li dt dd", "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside dialog",
    "form": "form label legend", "figure": "figure figcaption caption", "table": "table thead tbody tfoot tr", "cell": "td th",
    "quote": "blockquote pre", "root": "html body",
}
GROUP_OF = {tag: group for group, tags in GROUPS.items() for tag in tags.split()}
# An opening tag of the first kind closes an open one of the second, up to the third.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Groups of words in class, id and role.
WORDS = {
    "c_nav": r"nav|menu|breadcrumb|pagination|pager|toolbar|tabs?\b", "c_edge": r"header|footer|masthead|copyright|legal|colophon",
    "c_side": r"side|widget|rail", "c_ad": r"\bads?\b|advert|promo|sponsor|banner|commercial", "c_comment": r"comment|reply|replies|disqus|discussion",
    "c_notice": r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|gdpr", "c_share": r"share|social|follow",
    "c_related": r"related|recommend|more-|trending|popular|tags?\b", "c_form": r"login|search|form|signup",
    "c_main": r"content|article|post|entry|story|main|body|text",
}
WORD_PATTERNS = {name: re.compile(pattern) for name, pattern in WORDS.items()}
AWAY = frozenset("nav header footer aside form c_nav c_edge c_side c_ad c_comment c_notice c_share c_related c_form".split())

NAMES = [
    "bias", *GROUPS, *WORDS, "element", "run", "under away", "under main", "short", "some", "long", "very long",
    "few links", "links", "all links", "sentence", "in heading", "in item", "in p", "in box",
]
NUMBER = {name: i for i, name in enumerate(NAMES)}


@dataclass
class Tree:
    """Nodes in page order: a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


class Builder(HTMLParser):
    """Builds the tree; text of unclosed and misnested elements goes where browsers put it, nearly."""

    def __init__(self, known: dict):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.tree = Tree()
        # Open elements: tag, node (of the nearest block), node's groups, under away, under main, labelled.
        self.open = [("", -1, "box", False, False, False)]
        # Open dropped elements: tag, number of blocks open inside before it, its event.
        self.drop: list[tuple[str, int, int]] = []
        # Since the first of them: open blocks, all that was read, and events that begin unclosed elements.
        self.inside: list[str] = []
        self.events: list[tuple[str, str, list]] = []
        self.unclosed: set[int] = set()
        self.replaying = self.skip = False
        self.run: list[str] = []
        self.linked = self.links = 0
        self.node("", ("box", ()), False, False, False)
        self.open[0] = ("", 0, "box", False, False, False)

    def node(self, tag, kind, away, main, label):
        group, words = kind
        names = ["bias", "element", group, *words] + ["under away"] * away + ["under main"] * main
        self.add([NUMBER[n] for n in names], None, label)

    def add(self, features, text, label):
        t = self.tree
        parent = self.open[-1][1]
        t.parent.append(parent)
        t.depth.append(t.depth[parent] + 1 if parent >= 0 else 0)
        t.features.append(features)
        t.text.append(text)
        t.label.append(int(label))

    def kind(self, tag, attrs):
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        key = (tag, words)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = (
                GROUP_OF.get(tag), tuple(n for n, p in WORD_PATTERNS.items() if words and p.search(words)),
            )
        return self.known[key]

    def flush(self):
        """The text collected since the last block edge becomes a run."""
        text = " ".join("".join(self.run).split())
        linked = self.linked
        self.run, self.linked = [], 0
        if not text:
            return
        _, _, group, away, main, label = self.open[-1]
        share = linked / len(text)
        size = "short" if len(text) < 25 else "some" if len(text) < 100 else "long" if len(text) < 400 else "very long"
        names = ["bias", "run", size, "all links" if share > 0.6 else "links" if share > 0.25 else "few links"]
        names += ["under away"] * away + ["under main"] * main + ["sentence"] * (text[-1] in ".!?\"'”»")
        names += [f"in {group}"] * (f"in {group}" in NUMBER)
        self.add([NUMBER[n] for n in names], text, label)

    def close_down_to(self, at):
        self.flush()
        del self.open[at:]

    def end_drop(self):
        self.drop, self.inside, self.events, self.unclosed = [], [], [], set()

    def end_unclosed(self, at):
        """End the dropped elements from ``at`` on, which miss their end tags.

        Each takes what follows up to the next edge of a block; the rest is read again.
        """
        self.unclosed.update(event for _, _, event in self.drop[at:])
        if at:
            del self.inside[self.drop[at][1] :], self.drop[at:]
            return
        events, unclosed = self.events, self.unclosed
        self.end_drop()
        if self.replaying:
            return
        self.replaying = True
        for number, (handle, what, attrs) in enumerate(events):
            if number in unclosed and not self.drop:
                self.skip = True
            elif handle == "start":
                self.handle_starttag(what, attrs)
            elif handle == "end":
                self.handle_endtag(what)
            else:
                self.handle_data(what)
        self.end_drop()
        self.replaying = self.skip = False

    def last_drop(self, tag):
        return next((at for at in range(len(self.drop) - 1, -1, -1) if self.drop[at][0] == tag), None)

    def handle_starttag(self, tag, attrs):
        if self.drop and (self.drop[-1][0] == "head" and tag not in IN_HEAD or self.drop[0][0] == "head" and tag == "body"):
            self.end_drop()
        if self.drop and tag in NOT_NESTED and (at := self.last_drop(tag)) is not None:
            self.end_unclosed(at)
        if self.drop or tag in DROPPED:
            if tag in DROPPED:
                self.drop.append((tag, len(self.inside), len(self.events)))
            elif tag in GROUP_OF:
                self.inside.append(tag)
            self.events.append(("start", tag, attrs))
            return
        if self.skip and tag not in GROUP_OF:
            return
        self.skip = False
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img", "input"):
                self.run.append(" ")
            return
        kind = self.kind(tag, attrs)
        if kind[0] is None:
            self.links += tag == "a"
            return
        self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            own = self.open[at][0]
            if own == "p":
                self.close_down_to(at)
            if tag in IMPLIED_END:
                if own in IMPLIED_END[tag][1]:
                    break
                if own in IMPLIED_END[tag][0]:
                    self.close_down_to(at)
            elif own != "p":
                break
        self.links = 0
        _, _, _, away, main, label = self.open[-1]
        label = label or any(k == "data-main" for k, _ in attrs)
        self.node(tag, kind, away, main, label)
        away = away or kind[0] in AWAY or any(w in AWAY for w in kind[1])
        main = main or kind[0] == "main" or "c_main" in kind[1]
        self.open.append((tag, len(self.tree.parent) - 1, kind[0], away, main, label))

    def handle_endtag(self, tag):
        if self.drop and not self.end_of_enclosing(tag):
            return
        if self.skip and tag not in GROUP_OF:
            return
        if tag == "a":
            self.links = max(self.links - 1, 0)
            return
        if tag not in GROUP_OF:
            return
        self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.skip = False
                self.close_down_to(at)
                return

    def end_of_enclosing(self, tag):
        """An end tag inside a dropped element; true if it closes a block around it."""
        at = self.last_drop(tag)
        if at == 0:
            self.end_drop()
            return False
        self.events.append(("end", tag, []))
        if at is not None:
            del self.inside[self.drop[at][1] :], self.drop[at:]
        elif tag in GROUP_OF and tag in self.inside:
            block = len(self.inside) - 1 - self.inside[::-1].index(tag)
            within = next((i for i, d in enumerate(self.drop) if d[1] > block), None)
            if within is not None:
                self.end_unclosed(within)
            del self.inside[block:]
        elif tag in GROUP_OF and any(o[0] == tag for o in self.open[1:]):
            self.events.pop()
            self.end_unclosed(0)
            return True
        return False

    def handle_data(self, data):
        if self.drop and self.drop[-1][0] == "head" and data.strip():
            self.end_drop()
        if self.drop:
            self.events.append(("data", data, []))
        elif not self.skip:
            self.run.append(data)
            if self.links:
                self.linked += len(data)


def build(html: str, known: dict | None = None) -> Tree:
    """The tree of a page.

    A dropped element whose end tag is missing takes what follows up to the next edge of a block;
    it counts as missing when a block around the element or the page ends first. A head ends
    before the first tag or text that may not be in one.
    """
    builder = Builder({} if known is None else known)
    builder.feed(html)
    builder.close()
    if builder.drop:
        builder.end_unclosed(0)
    builder.flush()
    return builder.tree


@dataclass
class Forest:
    """Trees side by side, as arrays; ``levels`` lists the nodes of each depth."""

    parent: np.ndarray
    is_run: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]


def join_trees(trees: list[Tree]) -> Forest:
    base = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.array(t.parent) + (np.array(t.parent) >= 0) * b for t, b in zip(trees, base, strict=False)])
    depth = np.concatenate([t.depth for t in trees])
    size = np.array([len(f) for t in trees for f in t.features])
    order = np.argsort(depth, kind="stable")
    return Forest(
        parent, np.array([x is not None for t in trees for x in t.text]), np.repeat(np.arange(len(parent)), size),
        np.array([x for t in trees for f in t.features for x in f]),
        np.split(order, np.cumsum(np.bincount(depth))[:-1]),
    )


@dataclass
class Weights:
    """Per feature, and per kind of child (element, run) a table by parent's and child's state."""

    node: np.ndarray
    pair: np.ndarray


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sum_product(forest: Forest, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of main text per node, and of (parent, child) states per node with a parent."""
    n = len(forest.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(forest.row, w.node[forest.feature], n)
    table = w.pair[forest.is_run.astype(int)]
    to_parent = np.zeros((n, 2))
    for nodes in reversed(forest.levels[1:]):
        to_parent[nodes] = log_sum(table[nodes] + up[nodes][:, None, :], axis=2)
        for state in (0, 1):
            np.add.at(up[:, state], forest.parent[nodes], to_parent[nodes, state])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for nodes in forest.levels[1:]:
        above = belief[forest.parent[nodes]] - to_parent[nodes]
        joint[nodes] = above[:, :, None] + table[nodes] + up[nodes][:, None, :]
        belief[nodes] = log_sum(joint[nodes], axis=1)
    marginal = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40)))
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return marginal, joint / joint.sum(axis=(1, 2), keepdims=True)


def train(pages: list[str] | None = None) -> Weights:
    """Fit to labelled pages, by default those of :mod:`docsync.llm.html_pages`."""
    trees = [build(p) for p in (pages or labelled_pages())]
    forest = join_trees(trees)
    label = np.array([x for t in trees for x in t.label])
    child = np.flatnonzero(forest.parent >= 0)
    kind = forest.is_run[child].astype(int)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind, label[forest.parent[child]], label[child]), 1)
    features = len(NAMES)
    theta, m, v = np.zeros(features + 8), np.zeros(features + 8), np.zeros(features + 8)
    for step in range(1, STEPS + 1):
        w = Weights(theta[:features], theta[features:].reshape(2, 2, 2))
        marginal, joint = sum_product(forest, w)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind, joint[child])
        g = np.concatenate((
            np.bincount(forest.feature, (label - marginal)[forest.row], features), (seen - expected).reshape(-1)
        )) / len(label) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Weights(theta[:features], theta[features:].reshape(2, 2, 2))


def main_texts(pages: list[str], w: Weights, known: dict) -> list[list[str]]:
    """The main text blocks of each page."""
    trees = [build(p, known) for p in pages]
    marginal, _ = sum_product(join_trees(trees), w)
    out, at = [], 0
    for tree in trees:
        own = marginal[at : at + len(tree.text)]
        out.append([t for t, m in zip(tree.text, own, strict=True) if t is not None and m >= 0.5])
        at += len(tree.text)
    return out


def extract(pages: DataFrame, w: Weights | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages(page_id, url, html)``.

    Blocks are joined by one line feed in page order; white space inside a block is one space.
    A null or empty html, or one without main text, gives the empty string. Other columns are
    ignored.
    """
    weights = w or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts: list[str] = []
            group, size = [], 0
            for value in batch.column(2):
                group.append(value.as_py() or "")
                size += group[-1].count("<") + 1
                if size > BATCH_NODES:
                    texts += ["\n".join(blocks) for blocks in main_texts(group, weights, known)]
                    group, size = [], 0
            if group:
                texts += ["\n".join(blocks) for blocks in main_texts(group, weights, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
