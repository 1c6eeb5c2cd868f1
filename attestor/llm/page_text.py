"""HTML extraction by minimum-cut labelling of a page's blocks.

A page is read as a stream of tags and text; block-level tags cut it into blocks, each with its text, its link share
and its ancestors. A logistic classifier gives each block a probability of being content; the costs of either label
are the capacities to the two terminals. Neighbouring blocks, and consecutive children of one parent element, are
tied by smoothness edges. The minimum cut, found by max-flow, is the cheapest labelling; what stays on the content
side is joined in page order.

The classifier is trained on blocks of at most ``SAMPLE`` pages (those with the smallest hashes of their id) that
stand in an element whose meaning is plain (article, main; nav, footer, aside, form, or a class or id of such a
name). Those marks are also features, half of them hidden at random in training, so that length, links and
punctuation decide where no mark is given. With no such page, fixed starting weights are used.

Defined cases: a null or empty page has the empty text; unclosed elements end with the page, comments and scripts
too; a ``<`` that begins no whole tag is text; a page without any content block is empty; repeated rows are each extracted; further columns are ignored.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
ADJACENT, SIBLING = 0.5, 0.5  # smoothness capacities
SURE = 6.0  # log-odds beyond this count as this

# HTML elements by their part in a page's layout.
HIDDEN = "script|style|noscript|template|title|textarea|select|button|iframe|object|svg|head(?!er)"
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTENT_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story"}
OTHER_NAMES = {
    "ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "form", "header", "login", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OPEN = re.compile(rf"(?P<hidden>{HIDDEN})\b|(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)", re.I)
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
ENDS = re.compile(r"[.!?;:][\"')]*(?:\s|$)")


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    near: int  # 1 content, -1 other, 0 nothing: the nearest telling ancestor
    other: bool  # any ancestor that tells of boilerplate
    parent: int  # number of the parent element


def telling(tag: str, attributes: str) -> int:
    names = set()
    if attributes:
        for m in NAMES.finditer(attributes):
            names.update(re.split(r"[\s_\-]+", (m[1] or m[2] or m[3] or "").lower()))
    if tag in OTHER_TAGS or names & OTHER_NAMES:
        return -1
    return int(tag in CONTENT_TAGS or bool(names & CONTENT_NAMES))


def tag_end(page: str, at: int, failed: set[int]) -> int:
    """The place of the ``>`` that ends a tag whose name ends at ``at``; those in quoted values do not. -1 without one.

    ``failed`` keeps the places outside quotes that earlier calls came by in vain, so that a page is gone through once.
    """
    seen = []
    m = STOP.search(page, at)
    while m and m.start() not in failed:
        if m[0] == ">":
            return m.start()
        seen.append(m.start())
        after = page.find(m[0], m.end())
        m = STOP.search(page, after + 1) if after >= 0 else None
    failed.update(seen)
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes) of a page in order: a text has no tag, a closing tag's name begins with ``/``.

    Comments, declarations and hidden elements are left out; those that are not closed end with the page (hidden
    ones also where the body begins). A ``<`` that begins no tag is text. Linear in the length of the page.
    """
    at, last, failed, closers = 0, page.rfind(">"), set(), {}
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            yield page[at:end], "", ""
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = OPEN.match(page, at + 1) if at < last else None
        if m and m["hidden"]:
            name, end = m["hidden"].lower(), page.find(">", m.end()) + 1
            if name not in closers:
                closers[name] = re.compile(rf"</{name}\s*>|(?=<body\b)", re.I)
            close = closers[name].search(page, end)
            at = close.end() if close else len(page)
            continue
        if m:
            end = tag_end(page, m.end(), failed)
            if end >= 0:
                yield "", m["close"] + m["name"].lower(), page[m.end() : end]
                at = end + 1
                continue
        if at < last and page[at + 1] in "!?/":
            at = page.find(">", at) + 1
            continue
        yield "<", "", ""
        at += 1


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack = [("", 0, False, 0)]  # open block elements: tag, nearest telling mark, any other mark, number
    number, links, linked, parts = 0, 0, 0, []

    def close():
        nonlocal linked, parts
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            tag, near, other, own = stack[-1]
            inner = tag in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote") or tag in HEADINGS
            out.append(Block(text, min(linked, len(text)), tag, near, other, stack[-2][3] if inner and len(stack) > 1 else own))
        linked, parts = 0, []

    held: Counter[str] = Counter()  # open elements by tag
    for piece, name, attributes in tokens(page):
        if not name:
            parts.append(piece)
            if links:
                linked += len(piece)
            continue
        closing = name[0] == "/"
        name = name.lstrip("/")
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            parts.append("\n")
        if name not in BLOCK:
            continue
        close()
        links = 0
        if closing:
            while held[name]:
                top = stack.pop()[0]
                held[top] -= 1
                if top == name:
                    break
            continue
        if stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "td", "th", "tr", "dd", "dt", "option")):
            held[stack.pop()[0]] -= 1
        if name in VOID or attributes.endswith("/"):
            continue
        number += 1
        mark = telling(name, attributes)
        _, near, other, _ = stack[-1]
        stack.append((name, mark or near, other or mark < 0, number))
        held[name] += 1
    close()
    return out


# --------------------------------------------------------------------------- classifier

FEATURES = 12
START = np.array([-0.5, 0.6, 0.3, -2.5, 0.8, 0.8, -0.8, 3.0, -3.0, -3.0, 0.5, 0.0])


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), FEATURES))
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        x[k] = (
            1.0, np.log1p(words) / 3, min(len(ENDS.findall(b.text)), 5) / 5, b.linked / len(b.text), b.tag == "p", b.tag in HEADINGS, b.tag == "li",
            b.near > 0, b.near < 0, b.other, words >= 25, k / len(found),
        )
    return x


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the block classifier."""
    chosen = pages.select("html", F.xxhash64("page_id", F.lit(3)).alias("k")).filter("html IS NOT NULL").orderBy("k").limit(sample)

    def examples(batches):
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                keep = [b for b in found if b.near]
                x = features(found)[[b.near != 0 for b in found]] if keep else np.zeros((0, FEATURES))
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([float(b.near > 0) for b in keep], pa.float64())], names=["x", "y"])

    got = chosen.select("html").mapInArrow(examples, "x binary, y double").orderBy("y", "x").toArrow()
    y = got.column("y").to_numpy()
    w = START.copy()
    if not len(y) or y.min() == y.max():
        return w
    x = np.frombuffer(b"".join(got.column("x").to_pylist())).reshape(len(y), FEATURES).copy()
    marks = x.copy()
    marks[:, 7:10] = 0
    hidden = np.random.Generator(np.random.PCG64(1)).random(len(y)) < 0.5
    x = np.concatenate([x, marks[hidden]])
    y = np.concatenate([y, y[hidden]])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):  # Newton steps, drawn to the starting weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + 2.0 * (w - START)
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(FEATURES), grad)
    return w


# --------------------------------------------------------------------------- minimum cut


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling of least cost: node k costs -gain[k] as content when gain is negative, gain[k] as other when positive.

    A node whose gain outweighs all its edges keeps its sign in every minimum, so it is settled first and its edges
    become gains of its neighbours; max-flow by shortest augmenting paths decides the rest.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        k = queue.pop()
        if label[k] is None and abs(gain[k]) >= sum(near[k].values()):
            label[k] = gain[k] > 0
            for j, c in near[k].items():
                gain[j] += c if label[k] else -c
                del near[j][k]
                queue.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {k: dict(near[k]) for k in rest}
        cap[source], cap[sink] = {}, {}
        for k in rest:
            cap[source][k], cap[k][source] = max(gain[k], 0.0), 0.0
            cap[k][sink], cap[sink][k] = max(-gain[k], 0.0), 0.0
        while True:
            came, layer = {source: source}, [source]
            while layer and sink not in came:
                following = []
                for u in layer:
                    for v, c in cap[u].items():
                        if c > 1e-9 and v not in came:
                            came[v] = u
                            following.append(v)
                layer = following
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            flow = min(cap[u][v] for u, v in path)
            for u, v in path:
                cap[u][v] -= flow
                cap[v][u] += flow
        for k in rest:
            label[k] = k in came
    return [bool(x) for x in label]


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    gain = np.clip(features(found) @ weights, -SURE, SURE).tolist()
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k and found[k - 1].near == b.near and found[k - 1].other == b.other:
            edges[k - 1, k] = ADJACENT
        if b.parent in last:
            pair = last[b.parent], k
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last[b.parent] = k
    keep = min_cut(gain, edges)
    return " ".join(b.text for b, x in zip(found, keep) if x)


def extracted(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html). Narrow: no shuffle."""
    weights = np.asarray(weights)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [main_text(page, weights) for page in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = pages.select("page_id", "url", "html")
    schema = base.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return base.mapInArrow(run, schema)
