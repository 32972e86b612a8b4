"""Main-text extraction from HTML by a tree-structured graphical model.

Every page is parsed into its tree of block elements.  A node is content or not: it has a potential from its own
features (tag, words of class, id and role, share of link text, amount of text, punctuation of prose), and each parent-child edge has a
potential for every pair of states.  Sum-product messages, first upward, then downward, give the exact content marginal
of every node.  Weights are the maximum-likelihood ones for labelled pages, whose gradient comes from the same marginals.
Blocks of text whose node is content with a probability of at least one half are the main text.

Labelled pages are HTML whose elements may carry ``data-content="1"`` or ``"0"``, which holds for what is below them.
``labelled_pages`` builds a set of them by combining usual layouts; pass others to train on your own.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by newlines.
Line breaks and rules end a block.  Contents of scripts, styles, templates, form controls and SVG drawings are not text;
formulas, and what stands in objects, canvases, audio and video for browsers that can't show them, are.

Cases: null html counts as empty and gives ''.  Malformed pages (unclosed or stray tags, cut ends) are parsed with
implied end tags, in time proportional to their length.  Whole pages are read, whatever their length.  Repeated rows are all returned.  Columns beyond those
named are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names.
BLOCKS = frozenset(
    "html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption form fieldset legend address details summary center hgroup dialog menu search".split()
)
#: Read to their end tag and left out.  Without an end tag the raw ones run to the end of the page, the others are passed over.
RAW = frozenset("script style noscript iframe title textarea xmp noframes".split())
UNREAD = RAW | frozenset("template svg select button".split())
UNREAD_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for name in UNREAD}
CLOSES_ITS_LIKE = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}
HOLDERS = {"li": ["ul", "ol", "menu"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["table"], "th": ["table"]}

#: No alternative can fail after running on to the end of the page: a tag that is not closed ends there, and of unpaired
#: quotes only the last of each kind is searched for in vain.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.DOTALL
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = ".,;!?"
LABEL = re.compile(r"\bdata-content\s*=\s*[\"']?([01])")


class Page:
    """Block elements as parallel lists (parents come first), and the blocks of text with their nodes."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["#page"], [""]
        self.chars, self.link_chars, self.marks = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, parts, linked, in_link, at = [0], [], 0, False, 0
        open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
        unended: set[str] = set()
        size = len(source)

        def close_from(place: int):
            for node in stack[place:]:
                open_at[self.tag[node]].pop()
            del stack[place:]

        def flush():
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    node = stack[-1]
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                    self.link_chars[node] += min(linked, len(text))
                    self.marks[node] += sum(map(text.count, MARKS))
                parts, linked = [], 0

        while at < size:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else size]
            if text:
                if "&" in text:
                    text = html.unescape(text)
                parts.append(text)
                if in_link:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name, closing, attrs = name.lower(), m[1], m[3] or ""
            if name in UNREAD:
                if closing or attrs.endswith("/") or name in unended:
                    continue
                end = UNREAD_ENDS[name].search(source, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = size
                else:
                    unended.add(name)
            elif name in ("br", "hr"):
                flush()
            elif name == "a":
                in_link = not closing
            elif name in BLOCKS:
                flush()
                in_link = False
                if closing:
                    if open_at[name]:
                        close_from(open_at[name][-1])
                    continue
                if self.tag[stack[-1]] == "p":
                    close_from(len(stack) - 1)
                if name in CLOSES_ITS_LIKE:
                    holder = max((open_at[x][-1] for x in HOLDERS[name] if open_at[x]), default=-1)
                    like = [open_at[x][-1] for x in CLOSES_ITS_LIKE[name] if open_at[x] and open_at[x][-1] > holder]
                    if like:
                        close_from(min(like))
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.attrs.append(attrs)
                self.chars.append(0)
                self.link_chars.append(0)
                self.marks.append(0)
                open_at[name].append(len(stack))
                stack.append(len(self.tag) - 1)
        flush()
        self.total, self.total_link, self.total_marks = self.chars[:], self.link_chars[:], self.marks[:]
        for i in range(len(self.tag) - 1, 0, -1):
            self.total[self.parent[i]] += self.total[i]
            self.total_link[self.parent[i]] += self.total_link[i]
            self.total_marks[self.parent[i]] += self.total_marks[i]

    def edge_kinds(self) -> list[int]:
        return [edge_kind(t, self.tag[p] if p >= 0 else "") for t, p in zip(self.tag, self.parent, strict=True)]

    def traits(self) -> list[tuple[str, str, int, int, int]]:
        """Tag, attributes, grades of the amount of text, its links and its prose: all that a node's features depend on."""
        counts = zip(self.tag, self.attrs, self.total, self.total_link, self.total_marks, strict=True)
        return [(t, a, _grade(n), _link_grade(k, n), _prose_grade(m, n)) for t, a, n, k, m in counts]


def _grade(chars: int) -> int:
    return (chars > 0) + (chars > 40) + (chars > 200)


def _link_grade(linked: int, chars: int) -> int:
    return 0 if not linked else 1 + (linked > 0.3 * chars) + (linked > 0.7 * chars)


def _prose_grade(marks: int, chars: int) -> int:
    """None, few, or the punctuation of sentences: at least one mark in a hundred letters, and several of them."""
    return (marks > 0) + (marks > 3 and 100 * marks > chars)


def features(tag: str, attrs: str, grade: int, link_grade: int, prose_grade: int) -> tuple[str, ...]:
    out = ["bias", f"tag {tag}", f"chars {grade}", f"links {link_grade}", f"prose {prose_grade}"]
    for groups in NAMES.findall(attrs):
        for token in " ".join(groups).split():
            words = [w.lower() for w in WORDS.findall(token) if len(w) > 1]
            out += [f"name {words[0]}"] if len(words) == 1 else [f"part {w}" for w in words]
    return tuple(dict.fromkeys(out))


def edge_kind(tag: str, above: str) -> int:
    """Edges to elements that hold text, edges to containers, and those from the body to its text have potentials of their own."""
    return (2 if above in ("body", "#page") else 0) if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "figcaption", "caption") else 1


def _soft(x: float) -> float:
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def beliefs(parent: list[int], own: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float]]:
    """Log-odds of each node and, for training, of each node without its parent's message.

    own: log-odds of the node's own potential.  edge: log-potentials (00, 01, 10, 11; parent first) to the parent.
    """
    n = len(own)
    up, sent = list(own), [0.0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        e, b = edge[i], up[i]
        sent[i] = e[2] + _soft(e[3] - e[2] + b) - e[0] - _soft(e[1] - e[0] + b)
        up[parent[i]] += sent[i]
    full = list(up)
    for i in range(1, n):
        e, b = edge[i], full[parent[i]] - sent[i]
        full[i] = up[i] + e[1] + _soft(e[3] - e[1] + b) - e[0] - _soft(e[2] - e[0] + b)
    return full, up


class Model:
    """weights: by feature.  edges: four log-potentials by kind of edge."""

    def __init__(self, weights: dict[str, float], edges: list[tuple[float, float, float, float]]):
        self.weights, self.edges, self.known = weights, edges, {}

    def own(self, traits: tuple[str, str, int, int, int]) -> float:
        """Log-odds of a node by itself, remembered by its traits."""
        got = self.known.get(traits)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[traits] = sum(self.weights.get(f, 0.0) for f in features(*traits))
        return got

    def marginals(self, page: Page) -> list[float]:
        full, _ = beliefs(page.parent, [self.own(t) for t in page.traits()], [self.edges[k] for k in page.edge_kinds()])
        return [1 / (1 + exp(-max(min(b, 30), -30))) for b in full]

    def extract(self, source: str) -> str:
        page = Page(source)
        content = self.marginals(page)
        return "\n".join(text for node, text in page.blocks if content[node] >= 0.5)


class Forest:
    """The nodes of all labelled pages as arrays, so that messages pass through one level of all trees at once."""

    def __init__(self, parents: list[list[int]], kinds: list[list[int]]):
        at, parent, depth = 0, [], []
        for own in parents:
            for i, p in enumerate(own):
                parent.append(at + p if i else -1)
                depth.append(depth[at + p] + 1 if i else 0)
            at += len(own)
        self.parent, self.kinds = np.array(parent), np.concatenate([np.array(k) for k in kinds])
        self.levels = [np.flatnonzero(np.array(depth) == d) for d in range(max(depth) + 1)]

    def beliefs(self, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each node, those without the parent's message, and the messages to the parents."""
        e, up, sent = edges[self.kinds], own.copy(), np.zeros(len(own))
        for nodes in self.levels[:0:-1]:
            a, b = e[nodes], up[nodes]
            sent[nodes] = a[:, 2] + np.logaddexp(0, a[:, 3] - a[:, 2] + b) - a[:, 0] - np.logaddexp(0, a[:, 1] - a[:, 0] + b)
            np.add.at(up, self.parent[nodes], sent[nodes])
        full = up.copy()
        for nodes in self.levels[1:]:
            a, b = e[nodes], full[self.parent[nodes]] - sent[nodes]
            full[nodes] = up[nodes] + a[:, 1] + np.logaddexp(0, a[:, 3] - a[:, 1] + b) - a[:, 0] - np.logaddexp(0, a[:, 2] - a[:, 0] + b)
        return full, up, sent


def train(pages: list[str], rounds: int = 100, ridge: float = 0.02, rate: float = 0.45) -> Model:
    """Maximum-likelihood weights for labelled pages, by adaptive gradient steps on observed minus expected counts."""
    index: dict[str, int] = {}
    parents, kinds, truth, rows = [], [], [], []
    for source in pages:
        page, labels = Page(source), []
        for i, attrs in enumerate(page.attrs):
            m = LABEL.search(attrs)
            labels.append(int(m[1]) if m else labels[page.parent[i]] if i else 0)
        rows += [[index.setdefault(f, len(index)) for f in features(*t)] for t in page.traits()]
        parents.append(page.parent)
        kinds.append(page.edge_kinds())
        truth += labels
    forest, y = Forest(parents, kinds), np.array(truth)
    flat, of_node = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    child = np.flatnonzero(forest.parent >= 0)
    above, kind = forest.parent[child], forest.kinds[child]
    seen = np.zeros((len(child), 4))
    seen[np.arange(len(child)), 2 * y[above] + y[child]] = 1
    w, e = np.zeros(len(index)), np.zeros((3, 4))
    all_w, all_e = np.full(len(w), 1e-8), np.full((3, 4), 1e-8)
    for _ in range(rounds):
        full, up, sent = forest.beliefs(np.bincount(of_node, w[flat], len(rows)), e)
        gw = np.bincount(flat, (y - 1 / (1 + np.exp(-np.clip(full, -30, 30))))[of_node], len(w)) - ridge * w
        x, a, b = e[kind], full[above] - sent[child], up[child]
        joint = np.exp(np.clip(x + np.column_stack([0 * b, b, a, a + b]), -60, 60))
        ge = -ridge * e
        np.add.at(ge, kind, seen - joint / joint.sum(axis=1, keepdims=True))
        all_w += gw * gw
        all_e += ge * ge
        w += rate * gw / np.sqrt(all_w)
        e += rate * ge / np.sqrt(all_e)
    return Model({f: float(w[i]) for f, i in index.items()}, [tuple(x) for x in e.tolist()])


# Usual names of page parts, for the labelled pages.
OUTSIDE = [
    '<nav data-content="0">{links}</nav>', '<div class="nav menu" data-content="0">{links}</div>', '<div id="navbar" role="navigation" data-content="0">{links}</div>',
    '<header data-content="0"><div class="logo site-title"><a href="/">{short}</a></div>{links}</header>', '<div class="header banner masthead" data-content="0"><p>{short}</p>{links}</div>',
    '<div class="breadcrumb breadcrumbs" data-content="0">{links}</div>', '<aside data-content="0"><h3>{short}</h3><p>{long}</p>{links}</aside>', '<div class="sidebar widget" data-content="0"><h4>{short}</h4><p>{long}</p></div>',
    '<div id="side" class="sidebar-right" role="complementary" data-content="0">{links}</div>', '<div class="ad" data-content="0">{long}</div>', '<div class="ads advert advertisement" data-content="0"><p>{long}</p></div>',
    '<div class="sponsored sponsor promo promotion" data-content="0"><p>{long}</p></div>', '<section class="ad ad-slot" data-content="0"><h2>{short}</h2><p>{long}</p></section>',
    '<div class="notice alert" data-content="0">{long}</div>', '<div class="cookie cookie-notice cookie-bar consent-banner consent gdpr" data-content="0"><p>{long}</p></div>', '<div id="banner" class="popup modal overlay" role="dialog" data-content="0"><p>{long}</p></div>',
    '<form class="search" data-content="0"><label>{short}</label><p>{short}</p></form>', '<form data-content="0"><p>{long}</p></form>', '<div class="newsletter subscribe signup" data-content="0"><p>{long}</p></div>', '<div class="login" data-content="0"><p>{short}</p></div>',
    '<div class="social share sharing" data-content="0">{links}</div>', '<div class="related recommended more" data-content="0"><h3>{short}</h3>{links}</div>', '<div class="tags pagination pager" data-content="0">{links}</div>',
    '<section class="comments" id="comments" data-content="0"><h3>{short}</h3><div class="comment"><p>{long}</p></div><div class="comment reply"><p>{long}</p></div></section>',
    '<div class="comments comment-list" data-content="0"><ul><li class="comment"><p>{long}</p></li><li class="comment"><p>{long}</p></li></ul></div>', '<div class="discussion responses disqus" data-content="0"><p>{long}</p></div>',
    '<footer data-content="0"><p>{long}</p>{links}</footer>', '<footer data-content="0">{long}</footer>', '<div class="footer copyright legal disclaimer" role="contentinfo" data-content="0">{long}</div>', '<div id="bottom" class="footer-links" data-content="0">{links}</div>',
    '<div data-content="0">{links}</div>', '<div data-content="0"><p>{short}</p><p><a href="/b">{short}</a></p></div>',
]
HOLDING = [
    "<article data-content=\"1\">{body}</article>", '<main><article data-content="1">{body}</article></main>', '<div class="wrapper page"><article class="post" data-content="1">{body}</article></div>', '<main data-content="1">{body}</main>',
    '<div id="main" class="container"><div class="content article-body" data-content="1">{body}</div></div>', '<div class="post entry-content story" data-content="1">{body}</div>', '<section class="article text" data-content="1">{body}</section>', '<div role="main" class="post-content" data-content="1">{body}</div>',
    '<div data-content="1">{body}</div>', '<div data-content="1">{head}</div><div data-content="1">{rest}</div>', '<div><section data-content="1">{head}</section><div data-content="1">{rest}</div></div>',
    '<div data-content="1">{head}<p>{long}</p></div><div data-content="1"><p>{long}</p>{rest}</div>', '<h1 data-content="1">{short}</h1><p data-content="1">{long}</p><p data-content="1">{long}</p>',
]
BODIES = [
    "<h1>{short}</h1><p>{long}</p><p>{long}</p>", "<h1>{short}</h1><p><b>{long}<br><p>{long}</p>", "<h1>{short}</h1><p>{short}</p>", "<h1>{short}</h1><div><p>{long}</p></div><h2>{short}</h2><ul><li>{long}</li><li>{short}</li></ul>",
    "<h1>{short}</h1><section><h2>{short}</h2><p>{long} <a href=\"/x\">{short}</a> {long}</p></section><blockquote><p>{long}</p></blockquote>", "<h1>{short}</h1><figure><figcaption>{short}</figcaption></figure><p>{long}</p><pre>{long}</pre>",
    "<h1>{short}</h1><table><tr><th>{short}</th><td>{short}</td></tr></table><p>{long}</p>", "<p>{long}</p>", "<h1>{short}</h1><div>{long}</div><div>{long}</div>",
    '<h1>{short}</h1><div class="header-row"><p>{long}</p></div><div class="shared-memory"><p>{long}</p></div>', '<h1>{short}</h1><section class="related-work"><h2>{short}</h2><p>{long}</p></section><div class="ad-hoc row"><p>{long}</p></div>',
    '<h1>{short}</h1><div class="comment-syntax box">{long}</div><div id="menu-planning" class="col"><p>{long}</p><p>{short}</p></div>', '<div class="top-banner-history"><p>{long}</p></div><div class="legal-system side-effects"><p>{long}</p></div><p>{long}</p>',
    '<h1>{short}</h1><ol class="steps"><li>{long}</li><li>{long}</li></ol><dl class="terms"><dt>{short}</dt><dd>{long}</dd></dl>', '<h1 class="title">{short}</h1><p class="lead">{long}</p><div class="promo-video-notes"><p>{long}</p></div>',
]


def labelled_pages(n: int = 180) -> list[str]:
    """Labelled pages by rule: page k combines the k-th choices of layout, body and surrounding parts.

    Of several names of a part each page uses one, and two parts stand inside the content of every page.
    """
    short, long = "Lines of a title", "A sentence of some length, with commas and more than forty letters. " * 4
    links = "<ul>" + '<li><a href="/a">Some page</a></li>' * 5 + "</ul>"
    pages = []
    for k in range(n):

        def part(i: int, k: int = k) -> str:
            return re.sub(r'class="([^"]*)"', lambda m: f'class="{(names := m[1].split())[k % len(names)]}"', OUTSIDE[i % len(OUTSIDE)])

        body = BODIES[k % len(BODIES)]
        at = body.index("</h1>") + 5 if "</h1>" in body and k % 2 else len(body)
        body = body[:at] + part(5 * k + 9) + part(7 * k + 4) + body[at:]
        end = body.index(">", body.rindex("</h1>") if "</h1>" in body else body.index("</")) + 1
        holding = HOLDING[k % len(HOLDING)].replace("{body}", body).replace("{head}", body[:end]).replace("{rest}", body[end:])
        outside = [part(7 * k + 11 * j) for j in range(5)]
        page = f'<html><head></head><body data-content="0">{outside[0]}{outside[1]}{outside[2]}{holding}{outside[3]}{outside[4]}</body></html>'
        pages.append(page.replace("{links}", links).replace("{short}", short).replace("{long}", long if k % 4 else long[:70]))
    return pages


def extract_main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """pages: page_id, url, html.  labelled: pages to train on.  Returns page_id, url, text, n_chars, one row per page."""
    model = train(labelled or labelled_pages())
    weights, edges = model.weights, model.edges

    def run(batches):
        own = Model(weights, edges)
        for batch in batches:
            texts = [own.extract(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
