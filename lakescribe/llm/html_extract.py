"""Main text of web pages by a tree-structured graphical model over the DOM.

The nodes are a page's block elements and its runs of text; each is content or not. A node has a potential from its own
features (tag, role, words of class and id, length, share of linked text and so on), and each parent and child one that
says how likely both are alike. Messages go up from the leaves and down again (sum-product), which on a tree gives each
run's exact marginal; runs that are content more likely than not are the text.

The potentials are trained from labelled pages: pages that mark their article themselves (article, main, role=main or
itemprop=articleBody) label their own nodes, and in it tags and roles alone say what is no content. Each of them is learned
from twice: as it is, and as it would be without its marks, where what stands right in the mark stands right in the page.
From the second view comes what pages without marks share with those: the words of class and id that a site gives its
text and its surroundings, hashed, and what tags mean by themselves. Weights of tags and usual names start from what
these usually mean and are drawn back to it; those of hashed words start from nothing.

Pages are read in time in proportion to their length, whatever the markup: each character is passed a fixed number of
times. Elements that stand DEPTH deep or deeper end where their own end tag or an outer element's says so, and only there.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table

#: Labelled pages that the model is trained on, about.
PAGES = 1_000
ROUNDS, RATE, PULL, SEEN = 120, 0.05, (1e-2, 1e-3), 20

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: What browsers don't show as text of the page, and controls of forms.
DROPPED = frozenset("script style template head title textarea select option optgroup datalist button iframe noembed noframes annotation annotation-xml".split())
#: Markup in these isn't read; xmp's is shown as it stands.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DEPTH = 512
#: An open p ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form fieldset address menu details summary body html dialog hr center".split()
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
#: Elements that are blocks and so nodes; all others stand inside a line of text.
BLOCKS = ENDS_P | frozenset(SAME_LEVEL) | frozenset(TAGS) | frozenset("caption colgroup thead legend listing plaintext xmp search summary template head".split())
#: Words of class and id by what they tell.
NAMES = (
    ("content", r"articlebody|article|content|entry|post|story|main|text|body"),
    ("advert", r"ads?|advert\w*|sponsor\w*|promo\w*|outbrain|taboola"),
    ("menu", r"nav\w*|menu\w*|breadcrumbs?|toc|tabs?|pagination|pager|skip"),
    ("frame", r"header|footer|masthead|foot|copyright|legal|colophon"),
    ("side", r"side\w*|widget\w*|related|recommended|trending|popular|tags?|more|teaser"),
    ("comments", r"comments?|respond|replies|reply|disqus|discussion"),
    ("notice", r"cookies?|consent|gdpr|newsletter|subscribe|subscription|paywall|login|signup"),
    ("hint", r"notice|alert|modal|popup|overlay"),
    ("tool", r"banner|search|share|sharing|social"),
)
#: The weights that these start from: beside any mark of an article, and within one.
USUAL_NAMES = {"content": (2.5, 0.5), "advert": (-6, -6), "menu": (-6, -4), "frame": (-6, -2), "side": (-6, -1), "comments": (-6, -6), "notice": (-6, -5), "hint": (-6, -1), "tool": (-6, -0.5)}
#: Roles that say that an element isn't content.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar".split())
_NAMED = [re.compile(rf"(?:^|[\s_-])(?:{x})(?:$|[\s_-])") for _, x in NAMES]
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Up to the end of a tag, or a value's opening quote.
PART = re.compile(r"[^>=]*+(?:(>)|=\s*+([\"']?))")
COMMENT_END, RAW_END = re.compile(r"--!?>"), {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
#: Words of class and id, and how many numbers they are hashed to.
WORD, HASHED = re.compile(r"[^\s_-]++"), 1024
MAY_HIDE = re.compile("hidden|none", re.I)
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
BLANK = re.compile(r"\s+")
#: Tags, role; of what stands within a mark and in no block with a role, a name or a tag that says otherwise: a block, linked text; names beside a mark and within one; seven of text, one that is always 1.
PLAIN, LINKED = len(TAGS) + 1, len(TAGS) + 2
N_FEATURES = len(TAGS) + 3 + 2 * len(NAMES) + 8


#: In a marked article these are not content.
NOT_CONTENT = frozenset("nav footer aside form fieldset menu dialog search".split())


class Node:
    """A block element, or with text a run."""

    __slots__ = ("parent", "tag", "named", "words", "role", "text", "linked", "marked", "within", "plain", "run")

    def __init__(self, parent: int, tag: str, within: bool = False):
        self.parent, self.tag, self.within = parent, tag, within
        self.named, self.role, self.marked = 0, False, False
        self.words: set[int] = set()
        self.text: list[str] = []
        self.linked, self.run, self.plain = 0, False, False


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(raw):
        out.setdefault(k.lower(), html.unescape(v.strip("\"'")) if v else "")
    return out


class _Reader:
    """One page's tokens. Quotes that never close in the rest of the page end no value."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes start at at ends, behind its >; -1 if it never does."""
        page = self.page
        while True:
            m = PART.match(page, at)
            if m is None:
                return -1
            at = m.end()
            if m[1]:
                return at
            quote = m[2]
            if quote and quote not in self.unclosed:
                close = page.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)
                else:
                    at = close + 1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name, text): text, start with its attributes, end. What is left open at the end of the page is no text."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            sign = page.find("<", at)
            if sign < 0:
                yield "text", "", page[at:]
                return
            if sign > at:
                yield "text", "", page[at:sign]
            at = sign + 1
            following = page[at : at + 1]
            if following == "/":
                m = NAME.match(page, at + 1)
                end = page.find(">", at + 1)
                if end < 0:
                    return
                if m is not None:
                    yield "end", m[0].lower(), ""
                at = end + 1
            elif following == "!" or following == "?":
                if page.startswith("!--", at):
                    if page.startswith((">", "->"), at + 3):
                        at = page.index(">", at) + 1
                        continue
                    m = COMMENT_END.search(page, at + 3)
                    if m is None:
                        return
                    at = m.end()
                elif page.startswith("![CDATA[", at):
                    end = page.find("]]>", at)
                    if end < 0:
                        return
                    yield "plain", "", page[at + 8 : end]
                    at = end + 3
                else:
                    at = page.find(">", at) + 1
                    if not at:
                        return
            else:
                m = NAME.match(page, at)
                if m is None:
                    yield "plain", "", "<"
                    continue
                end = self.tag_end(m.end())
                if end < 0:
                    return
                tag = m[0].lower()
                yield "start", tag, page[m.end() : end - 1]
                at = end
                if tag in RAW:
                    found = RAW_END[tag].search(page, at)
                    if tag == "xmp":
                        yield "plain", "", page[at : size if found is None else found.start()]
                        yield "end", tag, ""
                    if found is None:
                        return
                    at = page.find(">", found.start()) + 1
                    if not at:
                        return


def parse(page: str | None) -> list[Node]:
    """The nodes of a page, parents first and runs in page order; broken markup is read as browsers do, in essence."""
    nodes = [Node(-1, "html")]
    # open elements: tag, the number of its block node (inline: that of its block), whether it hides its text
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]
    blocks, inner = [0], [{}]  # of open blocks their places on the stack, and what stands open in each line
    opened: dict[str, int] = {}
    run: Node | None = None
    links = 0
    deep: list[tuple[str, int, bool]] = []  # as stack, of what stands deeper than that
    deep_opened: dict[str, int] = {}

    def leave_deep(upto: int) -> None:
        nonlocal run, links
        while len(deep) > upto:
            tag = deep.pop()[0]
            deep_opened[tag] -= 1
            links -= tag == "a"
            if tag in BLOCKS:
                run = None

    def close(upto: int) -> None:
        nonlocal run, links
        leave_deep(0)
        while len(stack) > upto:
            tag = stack.pop()[0]
            if tag == "a":
                links = max(0, links - 1)
            if blocks[-1] == len(stack):
                blocks.pop()
                inner.pop()
                opened[tag] -= 1
                run = None
            else:
                inner[-1][tag] -= 1

    def add(text: str) -> None:
        nonlocal run
        _, owner, hides = deep[-1] if deep else stack[-1]
        if hides or not text:
            return
        if run is None:
            if text.isspace():
                return
            run = Node(owner, "#", nodes[owner].within)
            run.run = True
            nodes.append(run)
        run.text.append(text)
        if links:
            run.linked += len(text)

    def last(tags: set[str], stops: set[str]) -> int:
        """The place of the last open block of tags above any of stops, or 0."""
        if any(opened.get(x) for x in tags):
            for k in reversed(blocks):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in tags:
                    return k
        return 0

    for kind, tag, raw in _Reader(page or "").tokens():
        if kind == "text":
            add(html.unescape(raw) if "&" in raw else raw)
            continue
        if kind == "plain":
            add(raw)
            continue
        if tag == "br":
            add(" ")
            continue
        if kind == "end":
            if deep_opened.get(tag):
                leave_deep(next(k for k in range(len(deep) - 1, -1, -1) if deep[k][0] == tag))
            elif tag in BLOCKS:
                if opened.get(tag):
                    close(next(k for k in reversed(blocks) if stack[k][0] == tag))
                elif tag == "p":
                    run = None
            elif inner[-1].get(tag):  # an inline element's end tag ends no block
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag == "html":
            continue
        if deep:
            pass
        elif tag == "body":
            close(1)
        elif stack[-1][0] == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            close(len(stack) - 1)
        if not deep and tag in ENDS_P and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if not deep and tag in SAME_LEVEL:
            ends, stops = SAME_LEVEL[tag]
            while k := last(ends, stops):
                close(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag in VOID or (tag in RAW and tag != "xmp"):
            if tag == "hr":
                run = None
            continue
        _, owner, hidden = deep[-1] if deep else stack[-1]
        hidden = hidden or tag in DROPPED
        block = tag in BLOCKS
        a = _attributes(raw) if raw and not raw.isspace() and (block or MAY_HIDE.search(raw)) else {}
        if a:
            hidden = hidden or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(a.get("style") and HIDDEN.search(a["style"]))
        below = bool(deep) or len(stack) >= DEPTH
        if below:
            deep_opened[tag] = deep_opened.get(tag, 0) + 1
        if not block:
            links += tag == "a"
            if below:
                deep.append((tag, owner, hidden))
            else:
                inner[-1][tag] = inner[-1].get(tag, 0) + 1
                stack.append((tag, owner, hidden))
            continue
        run = None
        node = Node(owner, tag)
        role = a.get("role", "").strip().lower()
        words = " ".join(a[k] for k in ("class", "id") if k in a).lower()
        if words:
            node.named = sum(1 << k for k, x in enumerate(_NAMED) if x.search(words))
            node.words = {zlib.crc32(w.encode()) % HASHED for w in WORD.findall(words)}
        node.role = role in ROLES
        node.marked = tag in ("article", "main") or role == "main" or a.get("itemprop", "").strip().lower() == "articlebody"
        node.within = node.marked or nodes[owner].within
        node.plain = node.marked or (nodes[owner].plain and not (node.named or node.role or tag in NOT_CONTENT))
        nodes.append(node)
        if below:
            deep.append((tag, len(nodes) - 1, hidden))
            continue
        blocks.append(len(stack))
        inner.append({})
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, len(nodes) - 1, hidden))
    return nodes


def rows_of(nodes: list[Node], marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's parent and features, and pairs of (node, hashed word). What stands right in the page has no parent:
    whether a page as a whole is content says nothing. Without marks the page is seen as if it had none: what stands right
    in one has no parent, names count as beside one, and the marks themselves have no features."""
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    x[:, -1] = 1
    names = len(TAGS) + 3
    base = names + 2 * len(NAMES)
    pairs = []
    for k, node in enumerate(nodes):
        if node.marked and not marks:
            x[k] = 0
            continue
        if not node.run:
            n = _TAG_NUMBER.get(node.tag)
            if n is not None:
                x[k, n] = 1
            x[k, len(TAGS)] = node.role
            if node.named:
                at = names + (len(NAMES) if marks and node.within and not node.marked else 0)
                for j in range(len(NAMES)):
                    if node.named >> j & 1:
                        x[k, at + j] = 1
            if marks and node.plain and not node.marked:
                x[k, PLAIN] = 1
            pairs += [(k, w) for w in node.words]
            continue
        text = "".join(node.text)
        size = max(len(text), 1)
        words = text.count(" ") + 1
        x[k, base : base + 7] = (1, min(words, 60) / 30, min(1.0, node.linked / size), words < 4, min(1.0, 12 * sum(map(text.count, ".,;:?!")) / size), "©" in text or "(c)" in text[:8], text.rstrip()[-1:] in ".!?\"”»")
        if marks and nodes[node.parent].plain:
            x[k, LINKED] = x[k, base + 2]
    top = [n.parent < 0 or (not n.run and n.tag in ("html", "body")) or (n.marked and not marks) for n in nodes]
    parents = np.array([-1 if n.parent < 0 or top[n.parent] else n.parent for n in nodes])
    return parents, x, np.array(pairs, np.int32).reshape(-1, 2)


class Model(NamedTuple):
    weights: np.ndarray
    hashed: np.ndarray  # of hashed words of class and id
    edges: np.ndarray  # log potential of (parent's label, child's label)


def usual_weights() -> np.ndarray:
    """What tags, names and text usually mean, before training."""
    w = np.zeros(N_FEATURES)
    for tag, value in {"article": 4, "main": 3, "h1": 1, "p": 0.7, "blockquote": 0.5, "pre": 0.5, "nav": -6, "footer": -6, "aside": -6, "form": -6, "fieldset": -4, "menu": -6, "header": -1.5, "dialog": -6, "address": -1, "body": -1, "html": -1}.items():
        w[_TAG_NUMBER[tag]] = value
    w[len(TAGS)] = -6
    names = len(TAGS) + 3
    for k, (name, _) in enumerate(NAMES):
        w[names + k], w[names + len(NAMES) + k] = USUAL_NAMES[name]
    base = names + 2 * len(NAMES)
    w[[PLAIN, LINKED]] = 2
    w[base : base + 7] = (0.2, 0.6, -2.5, -0.3, 0.5, -3, 0.3)
    return w


def usual_edges() -> np.ndarray:
    """Counts of (parent's label, child's) as if seen before training: content's children are content, others' seldom are."""
    return np.array([[80.0, 0.5], [20.0, 40.0]])


def marginals(parents: np.ndarray, own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each node's probability of content, from log odds of its own and edge potentials: messages up, then down."""
    e00, e01, e10, e11 = np.exp(edges).ravel().tolist()
    n = len(parents)
    up = own.tolist()  # log odds of a node by itself and what is below
    sent = [0.0] * n
    above = parents.tolist()
    log, exp = math.log, math.exp
    for k in range(n - 1, 0, -1):
        if above[k] < 0:
            continue
        r = exp(max(-30.0, min(30.0, up[k])))
        sent[k] = log((e10 + e11 * r) / (e00 + e01 * r))
        up[above[k]] += sent[k]
    full = up[:]
    for k in range(1, n):
        if above[k] < 0:
            continue
        r = exp(max(-30.0, min(30.0, full[above[k]] - sent[k])))  # the parent without this child
        full[k] = up[k] + log((e01 + e11 * r) / (e00 + e10 * r))
    return 1 / (1 + np.exp(-np.clip(np.array(full), -30, 30)))


def labels_of(nodes: list[Node]) -> np.ndarray | None:
    """Content or not by the page's own marks: in what is marked all but certain tags and roles. None without marks."""
    if not any(n.marked for n in nodes):
        return None
    out = np.zeros(len(nodes), np.int8)
    for k, node in enumerate(nodes):
        inside = node.parent >= 0 and out[node.parent]
        against = node.tag in NOT_CONTENT or node.role
        out[k] = (inside or node.marked) and not against
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """pages: parents, features, pairs of (node, hashed word), labels. Edges: counts of labels, which weigh as SEEN beside the usual ones.

    Weights: each node's label given its parent's, by logistic regression whose offset is the edge's potential, so that
    the two don't tell the same thing twice; they are drawn to the usual ones, those of hashed words to 0.
    """
    counts, prior = np.zeros((2, 2)), np.concatenate([usual_weights(), np.zeros(HASHED)])
    for parents, _, _, y in pages:
        np.add.at(counts, (y[parents[parents >= 0]], y[parents >= 0]), 1)
    counts = usual_edges() + SEEN * counts / max(counts.sum(), 1)
    edges = np.log(counts / counts.sum(axis=1, keepdims=True))
    w, pull = prior.copy(), np.repeat(PULL, (N_FEATURES, HASHED))
    if pages:
        x, y = np.concatenate([p[1] for p in pages]), np.concatenate([p[3] for p in pages]).astype(np.float64)
        begins = np.cumsum([0, *[len(p[1]) for p in pages[:-1]]])
        of, word = np.concatenate([p[2] + [[b, 0]] for p, b in zip(pages, begins, strict=True)]).T
        odds = edges[:, 1] - edges[:, 0]
        offset = np.concatenate([np.where(p[0] >= 0, odds[p[3][p[0]]], 0.0) for p in pages])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, ROUNDS + 1):
            score = x @ w[:N_FEATURES] + offset + np.bincount(of, w[N_FEATURES + word], len(y))
            off = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
            g = np.concatenate([x.T @ off, np.bincount(word, off[of], HASHED)]) / len(y) + pull * (w - prior)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:N_FEATURES], w[N_FEATURES:], edges)


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for page in frame["html"]:
            nodes = parse(page)
            y = labels_of(nodes)
            if y is not None:
                for marks in (True, False):
                    parents, x, pairs = rows_of(nodes, marks)
                    rows.append((parents.astype("<i4").tobytes(), x.astype("<f4").tobytes(), pairs.astype("<i4").tobytes(), y.tobytes()))
        yield pd.DataFrame(rows, columns=["parents", "x", "pairs", "y"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = PAGES) -> Model:
    """Trained on about sample pages that carry marks, chosen by a hash of the id; only their nodes' numbers reach the driver.

    Pages with a null id are learned from like others, null html isn't; repeated rows count each, other columns don't
    matter, and from an empty table come the usual weights.
    """
    marked = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)|role=.?main|articlebody"))
    some = bounded_sample(marked, sample, "page_id").select("html").mapInPandas(_labelled, "parents binary, x binary, pairs binary, y binary")
    return train([(np.frombuffer(r["parents"], "<i4"), np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES), np.frombuffer(r["pairs"], "<i4").reshape(-1, 2), np.frombuffer(r["y"], np.int8)) for r in some.collect()])


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page)
    parents, x, pairs = rows_of(nodes)
    own = (x @ model.weights).astype(np.float64) + np.bincount(pairs[:, 0], model.hashed[pairs[:, 1]], len(nodes))
    content = marginals(parents, own, model.edges)
    blocks = (BLANK.sub(" ", "".join(n.text)).strip() for n, p in zip(nodes, content, strict=True) if n.run and p > 0.5)
    return "\n".join(b for b in blocks if b)


def text_column(model: Model, page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, model) for x in pages], dtype=object)

    return extract(page.cast("string"))


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages. No shuffle.

    Null and empty html give an empty text. Null ids and urls stay null, repeated rows are each treated, other columns
    are dropped whatever their names; an empty table gives an empty one.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_column(model, F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages))
