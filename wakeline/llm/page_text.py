"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements; each run of text directly inside a block is a leaf. Every node has
a hidden label, content or not. Node potentials come from the tag, the names in class, id and role, the
number of words, paragraphs and linked words, and the block's share of the page's prose; parent-child
potentials tie a node to its parent by the child's kind. Sum-product messages, once up and once down, give
each node's exact marginal; leaves whose content marginal is over 0.5 are the text, in page order.

The weights are trained on labelled pages by gradient steps on their likelihood: the gradient is what the
labels have of each feature less what the marginals expect. The labelled set is small and fixed
(labelled_pages.py; `train` takes any other list). Each page is learned a second time without its names, so
that names alone decide nothing. Pages are scored where they lie, without a shuffle.

Parsing takes time in proportion to the page, however deep its elements are nested.

Text of script, style and other elements that show none is no leaf. Character references are decoded, white
space becomes one space, blocks are joined by two line feeds. Null and empty html: empty text. Rows are
independent: repeated rows repeat their result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from math import exp, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import table
from wakeline.llm.labelled_pages import PAGES

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-keep)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg math canvas audio video select button textarea".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li legend main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "tr ul caption label".split()
)
#: Start tag -> open elements that it ends, and the elements that this does not reach beyond.
ENDS = {t: ({"p"}, {"table", "td", "th"}) for t in BLOCK - {"label", "option", "head", "body", "html"}}
ENDS["li"] = ({"li", "p"}, {"ul", "ol", "menu", "table"})
ENDS["dt"] = ENDS["dd"] = ({"dt", "dd", "p"}, {"dl", "table"})
ENDS["tr"] = ({"tr", "td", "th", "p"}, {"table"})
ENDS["td"] = ENDS["th"] = ({"td", "th", "p"}, {"table", "tr"})
ENDS["option"] = ({"option"}, {"select"})
ENDS["body"] = ({"head"}, set())
KINDS = ("leaf", "paragraph", "section")
SENTENCE_ENDS = frozenset(".!?…。！？؟।”\"»")
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd pre blockquote ul ol dl table tbody figcaption figure label caption".split())


class Node:
    __slots__ = ("tag", "names", "inside", "parent", "label", "words", "linked", "text", "kind", "paragraphs", "share")

    def __init__(self, tag: str, names: str, parent: int, label: int, kind: int) -> None:
        self.tag, self.names, self.parent, self.label, self.kind = tag, names, parent, label, kind
        self.words, self.linked, self.text, self.inside = 0, 0, "", ""
        self.paragraphs, self.share = 0, 0.0


def parse(source: str) -> list[Node]:
    """Nodes of a page in page order, parents first; leaves have text."""
    nodes = [Node("#page", "", -1, 0, 2)]
    # open elements: tag, number of its block node, whether hidden, inside a link
    stack: list[tuple[str, int, bool, bool]] = [("#page", 0, False, False)]
    places: dict[str, list[int]] = defaultdict(list)  # depths of the open elements by tag
    parts: list[str] = []
    linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        tag, _, hidden, link = stack[-1]
        if piece and not hidden:
            parts.append(piece)
            if link:
                linked += len(piece.split())

    def flush() -> None:
        nonlocal linked
        block = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if block:
            at = stack[-1][1]
            leaf = Node("#text", nodes[at].tag, at, nodes[at].label, 0)
            leaf.text, leaf.words, leaf.linked = block, block.count(" ") + 1, linked
            leaf.paragraphs = int(nodes[at].tag == "p")
            nodes.append(leaf)
        parts.clear()
        linked = 0

    def end(depth: int) -> None:
        if any(t in BLOCK for t, *_ in stack[depth:]):
            flush()
        for t, *_ in stack[depth:]:
            places[t].pop()
        del stack[depth:]

    at, n = 0, len(source)
    while at < n:
        found = TAG.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing = tag.lower(), found[1] or found[4]
        if closing:
            if places[tag]:
                end(places[tag][-1])
            continue
        if tag in ("br", "hr") or tag in BLOCK:
            parts.append(" ")
        if tag in ENDS:
            gone, limit = ENDS[tag]
            border = max((places[t][-1] for t in limit if places[t]), default=0)
            beyond = [d[bisect_right(d, border)] for t in gone if (d := places[t]) and d[-1] > border]
            if beyond:
                end(min(beyond))
        if tag in VOID:
            continue
        _, block, hidden, link = stack[-1]
        if tag in BLOCK:
            flush()
            attributes = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(found[3] or found[6] or "")}
            keep = attributes.pop("data-keep", None)
            label = nodes[block].label if keep is None else int(keep == "1")
            nodes.append(Node(tag, " ".join(attributes.values()), block, label, 1 if tag in PARAGRAPHS else 2))
            nodes[-1].inside = nodes[block].tag + "+" * bool(nodes[block].names)
            block = len(nodes) - 1
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(source, at)
            at = close.start() if close else n
        places[tag].append(len(stack))
        stack.append((tag, block, hidden or tag in HIDDEN, link or tag == "a"))
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.words += node.words
        up.linked += node.linked
        up.paragraphs += node.paragraphs
    prose = max(1, nodes[0].words - nodes[0].linked)
    for node in nodes:
        node.share = (node.words - node.linked) / prose
    return nodes


@lru_cache(20_000)
def named_features(tag: str, names: str) -> tuple[str, ...]:
    return (f"tag {tag}", *(f"name {w}" for w in sorted(set(NAME.findall(names)))))


def features(node: Node) -> tuple[str, ...]:
    share = node.linked / node.words if node.words else 0
    link = "none" if not share else "few" if share < 0.3 else "half" if share < 0.7 else "most"
    if node.kind == 0:
        size = min(6, node.words.bit_length())
        closed = node.text[-1] in SENTENCE_ENDS
        return ("leaf", f"leaf in {node.names}", f"leaf words {size}", f"leaf links {link}", f"leaf closed {closed}")
    part = "some" if node.share < 0.25 else "half" if node.share < 0.6 else "most"
    extent = f"{KINDS[node.kind]} prose {part}", f"{KINDS[node.kind]} paragraphs {min(3, node.paragraphs)}"
    return (*named_features(node.tag, node.names), f"{node.tag} in {node.inside}", f"links {link}", *extent)


def _log_add(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


def marginals(nodes: list[Node], scores: list[float], ties: list[list[list[float]]]) -> tuple[list[float], list[tuple]]:
    """Content marginals of the nodes, and the joint log potentials of each node and its parent."""
    n = len(nodes)
    up = [(0.0, 0.0)] * n  # message of a node to its parent, by the parent's label
    inside = [[0.0, s] for s in scores]  # own potential and the messages from below
    for k in range(n - 1, 0, -1):
        node = nodes[k]
        t, (a, b) = ties[node.kind], inside[k]
        m0, m1 = _log_add(t[0][0] + a, t[0][1] + b), _log_add(t[1][0] + a, t[1][1] + b)
        up[k] = (m0, m1)
        top = inside[node.parent]
        top[0] += m0
        top[1] += m1
    outside = [(0.0, 0.0)] * n  # message from the parent, by the node's label
    out, joint = [0.0] * n, [()] * n
    for k in range(n):
        a, b = inside[k]
        if k:
            node = nodes[k]
            t, p = ties[node.kind], node.parent
            # the parent's belief without this node's message
            q0 = inside[p][0] + outside[p][0] - up[k][0]
            q1 = inside[p][1] + outside[p][1] - up[k][1]
            outside[k] = (_log_add(q0 + t[0][0], q1 + t[1][0]), _log_add(q0 + t[0][1], q1 + t[1][1]))
            joint[k] = (q0 + t[0][0] + a, q0 + t[0][1] + b, q1 + t[1][0] + a, q1 + t[1][1] + b)
        d = b + outside[k][1] - a - outside[k][0]
        out[k] = 1 / (1 + exp(-d)) if d > -700 else 0.0
    return out, joint


def unnamed(page: str) -> str:
    """A page without the names in class, id and role."""
    return TAG.sub(lambda m: ATTRIBUTE.sub(lambda a: a[0] if a[1].lower() == "data-keep" else "", m[0]), page)


def train(pages: list[str] = PAGES, steps: int = 200, rate: float = 0.5, decay: float = 0.0003) -> tuple[dict[str, float], list]:
    """Feature weights and parent-child potentials by kind of child, from labelled pages with and without names.

    A page without its names counts half as much, as names may be what tells its parts apart.
    """
    trees = [parse(p) for page in pages for p in (page, unnamed(page))]
    counts = [x / (1.5 * len(pages)) for _ in pages for x in (1.0, 0.5)]
    known = [[features(x) for x in nodes] for nodes in trees]
    weights: dict[str, float] = defaultdict(float)
    ties = [[[0.5, -0.5], [-0.5, 0.5]] for _ in KINDS]
    seen: dict = defaultdict(lambda: 1e-6)  # squared gradients, for steps of each weight's own size

    def move(key, old: float, slope: float) -> float:
        slope -= decay * old
        seen[key] += slope * slope
        return old + rate * slope / seen[key] ** 0.5

    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        tied: dict[tuple, float] = defaultdict(float)
        for nodes, named, count in zip(trees, known, counts):
            chances, joint = marginals(nodes, [sum(weights[f] for f in fs) for fs in named], ties)
            for k, node in enumerate(nodes):
                for f in named[k]:
                    slope[f] += (node.label - chances[k]) * count
                if k:
                    top = max(joint[k])
                    share = [exp(x - top) for x in joint[k]]
                    total = sum(share)
                    for i, x in enumerate(share):
                        tied[node.kind, i // 2, i % 2] -= x / total * count
                    tied[node.kind, nodes[node.parent].label, node.label] += count
        for f, x in slope.items():
            weights[f] = move(f, weights[f], x)
        for (kind, i, j), x in tied.items():
            ties[kind][i][j] = move((kind, i, j), ties[kind][i][j], x)
    return dict(weights), ties


def main_text(source: str | None, model: tuple[dict[str, float], list]) -> str:
    if not source:
        return ""
    weights, ties = model
    nodes = parse(source)
    chances, _ = marginals(nodes, [sum(weights.get(f, 0.0) for f in features(x)) for x in nodes], ties)
    return "\n\n".join(x.text for x, p in zip(nodes, chances) if x.text and p > 0.5)


def extract_text(pages: DataFrame, model=None, into: str = "_page") -> DataFrame:
    """`pages` with a struct column: text and n_chars (code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(train() if model is None else model)

    @F.pandas_udf("text string, n_chars long")
    def extract(sources: pd.Series) -> pd.DataFrame:
        texts = [main_text(s, sent.value) for s in sources]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.withColumn(into, extract(F.col("html")))


def op1_page_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "_page.text", "_page.n_chars")
