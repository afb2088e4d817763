"""Main text of HTML pages by minimum-cut labelling of blocks.

A tolerant scan splits a page into blocks at block-level tags, with the containers around each.
A block's log odds of being content are its capacity to the source (content) or the sink
(boilerplate); neighbours in page order and neighbours under one container are joined by
smoothness edges; the minimum cut, by maximum flow, is the labelling of least cost.

The log odds add up what the containers say and what a classifier says. Containers whose tag or class
names their role (an article; a menu, a form, comments) are hard evidence, more than all edges of a
block. Blocks in no such container have only ``PLAIN``, the classifier and their neighbours, so the cut decides them.
The classifier is a logistic regression on binary cues of a block's own text and tag (length, links, marks,
paragraph, list, heading). It is fitted to all pages: blocks in an article are its content, blocks in boilerplate
its boilerplate, and the counts of each pattern of cues, at most 2 ** 13, are all that it needs.
Without blocks of both kinds it says nothing.

Blocks whose terminal outweighs all their edges keep their side in every minimum cut and are folded
into their neighbours first; flows (in phases of shortest paths) run on what is left undecided.

Null and empty pages give an empty text; a tag that the page ends in is dropped, an entity
that it ends in stays as written unless it decodes; unclosed and stray tags are tolerated;
repeated rows give repeated results; the columns ``text`` and ``n_chars`` of the input are
replaced, others kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "search"}
WORDS = set(
    "nav navbar navigation menu menus submenu header masthead topbar footer bottombar sidebar sidebars aside rail notice notices notification alert consent cookie cookies gdpr banner banners ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted form login signup subscribe subscription newsletter comment comments commentlist respond replies reply disqus share sharing social breadcrumb breadcrumbs pagination pager related recommended popup modal overlay widget widgets complementary contentinfo search skip toolbar".split()
)
SAFE = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPH, LIST = {"p", "blockquote", "pre"}, {"li", "td", "th", "dt", "dd"}
#: Log odds that containers give, and the most that the classifier adds either way.
INSIDE, OUT, PLAIN, LEARNED = 5.0, -12.0, 0.3, 1.5
#: Smoothness of neighbours in page order, and of neighbours in one container besides.
NEXT, SIBLING = 0.4, 1.2
CUES = ("under 4 words", "under 10 words", "under 25 words", "80 words", "a link", "half links", "stop", "capital", "paragraph", "list", "heading", "digits", "legal")


def scan(page: str) -> list[dict]:
    """Blocks in page order: text, container, cues."""
    out: list[dict] = []
    stack: list[tuple[str, bool, int]] = []  # tag, boilerplate, number
    text: list[str] = []
    chars = linked = number = 0
    link = 0

    def end() -> None:
        nonlocal chars, linked
        if text:
            got = " ".join(entities.unescape("".join(text)).split())
            if got:
                inside = any(t in ("article", "main") for t, _, _ in stack)
                heading = any(t[0] == "h" and t[1:].isdigit() for t, _, _ in stack)
                tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                holder = next((n for t, _, n in reversed(stack) if t in BLOCK and t not in ("p", "li") and not t[1:].isdigit()), 0)
                out.append({"text": got, "out": any(b for _, b, _ in stack), "inside": inside, "heading": heading, "holder": holder, "tag": tag, "links": linked / max(1, chars)})
            text.clear()
        chars = linked = 0

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.match(page, pos)
        pos = m.end()
        token, tag = m.group(0), m.group(2)
        if tag is None:
            if token[0] != "<" or token == "<":
                text.append(token)
                chars += len(token)
                linked += len(token) if link else 0
            continue
        if token[-1] != ">":
            break  # the page ends in a tag
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK:
                end()
            if tag == "a":
                link = max(0, link - 1)
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            end()
            if tag == "body":
                stack = [x for x in stack if x[0] == "html"]
            if stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                stack.pop()
        if tag in VOID:
            continue
        if tag == "a":
            link += 1
        bad = tag in OUTSIDE
        in_article = any(t in ("article", "main") for t, _, _ in stack)
        if tag == "header":
            bad = not in_article
        if tag in ("article", "main") and not in_article:
            stack = [x for x in stack if x[0] not in OUTSIDE and x[0] != "header"]
        if not bad and tag not in SAFE:
            for name, *values in ATTRIBUTE.findall(m.group(3)):
                if any(w in WORDS for v in values for w in re.split(r"[^a-z0-9]+", v.lower())):
                    bad = True
        if tag in BLOCK or bad:
            number += 1
            stack.append((tag, bad, number))
    end()
    return out


def cues(block: dict) -> int:
    """The cues of a block's own text and tag, one bit each."""
    text, links, tag = block["text"], block["links"], block["tag"]
    n = text.count(" ") + 1
    digits = sum(map(text.count, "0123456789"))
    found = (n < 4, n < 10, n < 25, n >= 80, links > 0, links > 0.5, text[-1] in ".!?:;…", text[0].isupper(), tag in PARAGRAPH, tag in LIST, block["heading"], 5 * digits > len(text), text[0] == "©")
    return sum(1 << i for i, on in enumerate(found) if on)


def fit(patterns: np.ndarray, content: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Bias and a weight for each cue from counts of blocks, both kinds of the same weight, by Newton steps on the penalised likelihood."""
    k = len(CUES)
    if not len(n) or content.all() or not content.any():
        return np.zeros(k + 1)
    x = np.concatenate([np.ones((len(n), 1)), (patterns[:, None] >> np.arange(k)) & 1], axis=1).astype(float)
    weight = n * np.where(content, 0.5 / n[content].sum(), 0.5 / n[~content].sum())
    w, ridge = np.zeros(k + 1), 1e-3 * np.eye(k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (content - p)) - ridge @ w)
        w = w + step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
    return w


def odds(block: dict, weights: np.ndarray | None = None) -> float:
    if block["out"]:
        return OUT
    score = 0.0
    if weights is not None:
        bits = cues(block)
        score = weights[0] + sum(w for i, w in enumerate(weights[1:]) if bits >> i & 1)
    return (INSIDE if block["inside"] else PLAIN) + min(LEARNED, max(-LEARNED, float(score)))


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the source's side: least sum of cut terminals and edges."""
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    score = list(score)
    queue = deque(range(n))
    while queue:  # terminals that outweigh all edges decide
        i = queue.popleft()
        if side[i] is None and abs(score[i]) >= sum(near[i].values()):
            side[i] = score[i] > 0
            for j, w in near[i].items():
                score[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        side_of = max_flow(open_, [(i, j, w) for i in open_ for j, w in near[i].items() if i < j], score)
        for i in open_:
            side[i] = side_of[i]
    return [bool(s) for s in side]


def max_flow(nodes: list[int], edges: list[tuple[int, int, float]], score: list[float]) -> dict[int, bool]:
    """Whether each node is on the source's side of a minimum cut, by blocking flows along shortest paths."""
    place = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    arcs: list[list[list]] = [[] for _ in range(len(nodes) + 2)]  # [head, rest, place of the arc back]

    def join(u: int, v: int, there: float, back: float) -> None:
        arcs[u].append([v, there, len(arcs[v])])
        arcs[v].append([u, back, len(arcs[u]) - 1])

    for i, j, w in edges:
        join(place[i], place[j], w, w)
    for i in nodes:
        if score[i] > 0:
            join(source, place[i], score[i], 0.0)
        elif score[i] < 0:
            join(place[i], sink, -score[i], 0.0)
    while True:
        level = [-1] * len(arcs)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for v, rest, _ in arcs[u]:
                if rest > 1e-12 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return {i: level[place[i]] >= 0 for i in nodes}
        at, path = [0] * len(arcs), [source]
        trail: list[list] = []
        while path:
            u = path[-1]
            if u == sink:
                flow = min(arc[1] for arc in trail)
                for arc in trail:
                    arc[1] -= flow
                    arcs[arc[0]][arc[2]][1] += flow
                cut = next(k for k, arc in enumerate(trail) if arc[1] <= 1e-12)
                del path[cut + 1 :], trail[cut:]
                continue
            while at[u] < len(arcs[u]) and not (arcs[u][at[u]][1] > 1e-12 and level[arcs[u][at[u]][0]] == level[u] + 1):
                at[u] += 1
            if at[u] == len(arcs[u]):
                path.pop()
                if trail:
                    trail.pop()
                    at[path[-1]] += 1
                continue
            trail.append(arcs[u][at[u]])
            path.append(arcs[u][at[u]][0])


def label(blocks: list[dict], weights: np.ndarray | None = None) -> list[bool]:
    """Which blocks of a page are content."""
    edges = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b["holder"] in last:
            edges.append((last[b["holder"]], i, SIBLING))
        last[b["holder"]] = i
    return min_cut([odds(b, weights) for b in blocks], edges)


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    blocks = scan(page or "")
    return " ".join(b["text"] for b, k in zip(blocks, label(blocks, weights), strict=True) if k)


def train(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """The classifier's weights, from the blocks of all pages whose containers name their role."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for page in batch.column("html"):
                for b in scan(page.as_py() or ""):
                    if b["out"] or b["inside"]:
                        seen[cues(b), not b["out"]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "content", "n"])

    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(f, "pattern int, content boolean, n long")
    rows = sorted(counts.groupBy("pattern", "content").agg(F.sum("n").alias("n")).collect())  # a row for each pattern and kind
    return fit(np.array([r.pattern for r in rows], np.int64), np.array([r.content for r in rows], bool), np.array([r.n for r in rows], float))


def extract(pages: DataFrame, html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every page, by the given weights or those fitted to the pages."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    weights = train(pages, html_col) if weights is None else weights

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    fields = ", ".join(f"`{n}` {t}" for n, t in pages.select(*names).dtypes)
    return pages.select(*names, F.col(html_col).alias("__html")).mapInArrow(f, f"{fields + ', ' if fields else ''}text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
