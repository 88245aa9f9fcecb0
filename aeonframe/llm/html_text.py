"""The main text of web pages: blocks labelled by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: At most so many pages train the classifier of blocks: the first by a hash of their id.
TRAINING_PAGES = 400

# Comments, tags with quoted values that are closed, tags with a quote that is open to the end of the page, declarations.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

# Tags by what they do to a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SILENT = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "head", "svg", "math", "select", "button", "option", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
NAMES_OUT = "nav|navbar|navigation|menu|breadcrumbs?|crumbs?|header|masthead|topbar|banner|footer|copyright|colophon|sidebar|side|aside|widget|rail|related|recommended|recirc|promo|promoted|advert|adverts|advertisement|advertising|ad|ads|adbox|adsense|sponsor|sponsored|comment|comments|respond|disqus|replies|reply|share|sharing|social|follow|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|signin|search|form|pagination|pager|toolbar|tags|taglist|legal|disclaimer|skip|toc"
_OUT = re.compile(rf"(?:^|[^a-z])(?:{NAMES_OUT})(?:[^a-z]|$)")
# Names that speak of the whole layout, and of parts of an article.
_MILD = re.compile(r"(?:with|has|no|without|show|hide)[-_][a-z_-]+|(?:entry|article|post|story|page)[-_]*(?:header|title|body|content|text)")
_IN = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|story|entry|body|text|maintext)(?:[^a-z]|$)")
FEATURES = ("bias", "log_chars", "link_share", "marks", "in_frame", "named_out", "in_article", "in_main", "named_in", "heading", "list", "short", "hidden", "before", "behind")


#: What an element says of the text in it; a block has the most that any element around it says.
FLAGS = ("in_frame", "named_out", "in_article", "in_main", "named_in", "list", "hidden")
#: A name that speaks for and against content counts as so much against it.
MIXED = 0.15


class Element:
    __slots__ = ("tag", "parent", "depth", "own", "chars", "holds", "flags")

    def __init__(self, tag: str, parent: Element | None, own: dict[str, float]):
        self.tag, self.parent, self.own = tag, parent, own
        self.depth = parent.depth + 1 if parent else 0
        #: Characters of text in it, and whether it holds a sign of an article; known at the end of the page.
        self.chars, self.holds = 0, tag == "main" or tag == "h1" or tag == "article" and not own.get("named_out")
        self.flags: dict[str, float] = {}


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _said(tag: str, attributes: str, within_article: bool) -> dict[str, float]:
    """What a start tag says."""
    own: dict[str, float] = {}
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = " ".join(named.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop"))
    if tag == "article":
        own["in_article"] = 1.0
    if tag == "main" or named.get("role") == "main":
        own["in_main"] = 1.0
    # A header within an article holds its title.
    if tag in FRAME and not (tag == "header" and within_article):
        own["in_frame"] = 1.0
    if names.strip() and tag not in ("html", "body"):
        against, for_ = _OUT.search(_MILD.sub("", names)), _IN.search(names)
        if against:
            own["named_out"] = MIXED if for_ else 1.0
        elif for_:
            own["named_in"] = 1.0
    if tag in ("ul", "ol", "dl", "menu"):
        own["list"] = 1.0
    if "display:none" in named.get("style", "").replace(" ", "") or named.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        own["hidden"] = 1.0
    return own


def _weigh(elements: list[Element], found: list[Block]) -> None:
    """Flags of all elements, from the outermost in, when their texts are known.

    A name or a frame says nothing of an element that holds most of the page
    and an article in it, or nearly all of the page.
    """
    for b in found:
        b.element.chars += len(b.text)
    for e in reversed(elements):
        if e.parent:
            e.parent.chars += e.chars
            e.parent.holds |= e.holds
    whole = elements[0].chars
    for e in elements:
        around = e.parent.flags if e.parent else dict.fromkeys(FLAGS, 0.0)
        own = e.own
        if own:
            if 10 * e.chars > 9 * whole or 2 * e.chars > whole and e.holds:
                own = {k: v for k, v in own.items() if k not in ("in_frame", "named_out")}
            e.flags = {k: max(around[k], own.get(k, 0.0)) for k in FLAGS}
            if "in_main" in own:
                e.flags["named_out"] = own.get("named_out", 0.0)
        else:
            e.flags = around


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block tags in page order, with the elements they stand in.

    Tags need not match: an end tag closes the nearest open element of its
    name, or nothing; a block tag closes an open p; list items close one
    another; a quote that nothing closes ends with its tag. Comments, scripts,
    styles and other silent elements are left out. Elements know their parent,
    so deep nesting costs no more than its tags.
    """
    out: list[Block] = []
    root = Element("", None, {})
    elements = [root]
    # Tags of all open elements, each with the nearest element that is not inline.
    stack: list[tuple[str, Element]] = []
    open_: dict[str, int] = {}
    at, silent, link = 0, 0, 0
    parts: list[str] = []
    linked = articles = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(stack[-1][1] if stack else root, text, linked))
        parts.clear()
        linked = 0

    def gone(tag: str) -> None:
        nonlocal silent, link, articles
        open_[tag] -= 1
        silent -= tag in SILENT
        link -= tag == "a"
        articles -= tag == "article"

    def close(k: int) -> None:
        while len(stack) > k:
            gone(stack.pop()[0])

    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not silent:
            plain = html.unescape(piece) if "&" in piece else piece
            parts.append(plain)
            if link:
                linked += len(plain.strip())
        if not m:
            break
        at = m.end()
        ends, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "br" and not silent:
                parts.append(" ")
        elif not silent or tag in SILENT or ends:
            flush()
        if ends:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if open_.get(tag) else None
            if k is None:
                continue
            # An inline end tag doesn't close blocks.
            if tag in INLINE and any(s[0] not in INLINE for s in stack[k:]):
                del stack[k]
                gone(tag)
            else:
                close(k)
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("path", "circle"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and open_.get("p"):
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p":
                close(k)
        same = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag)
        if same and any(open_.get(t) for t in same):
            stop = {"ul", "ol", "menu", "dl", "table"}
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in same | stop), None)
            if k is not None and stack[k][0] in same:
                close(k)
        element = stack[-1][1] if stack else root
        if tag not in INLINE:
            element = Element(tag, element, _said(tag, attributes, articles > 0))
            elements.append(element)
        stack.append((tag, element))
        open_[tag] = open_.get(tag, 0) + 1
        silent += tag in SILENT
        link += tag == "a"
        articles += tag == "article"
    flush()
    _weigh(elements, out)
    return out


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    body = [i for i, b in enumerate(found) if b.element.flags["in_article"] or b.element.flags["in_main"]]
    for i, b in enumerate(found):
        f, tag = b.element.flags, b.element.tag
        chars = len(b.text)
        out[i] = (
            1, math.log1p(chars) / 6, min(1.0, b.linked / chars), min(1.0, 20 * sum(b.text.count(x) for x in ".,;:!?") / chars), f["in_frame"], f["named_out"], f["in_article"], f["in_main"], f["named_in"],
            len(tag) == 2 and tag[0] == "h", f["list"], chars < 25, f["hidden"], bool(body) and i < body[0], bool(body) and i > body[-1],
        )
    return out


#: What is known before any page is seen: log odds of content by feature. Training starts from here and is drawn to it.
PRIOR = dict(zip(FEATURES, (0.4, 0.8, -2.5, 0.6, -9.0, -9.0, 3.0, 1.5, 1.0, 0.5, -0.4, -0.3, -9.0, -2.5, -2.5)))
#: Capacity of the smoothness edges.
STRENGTH = 0.5


def train(pages: list[tuple[np.ndarray, list[tuple[int, int, float]]]], rounds: int = 100, pull: float = 0.05) -> np.ndarray:
    """Weights of content from the features and smoothness edges of some pages, without labels.

    Each page's blocks are labelled by the cut under the present weights, so
    neighbours teach what single blocks do not show; a logistic regression,
    drawn to the prior, learns from these labels. Three turns do.
    """
    prior = np.array([PRIOR[f] for f in FEATURES])
    weights = prior.copy()
    pages = [p for p in pages if len(p[0])]
    x = np.concatenate([t for t, _ in pages]) if pages else np.zeros((0, len(FEATURES)))
    for _ in range(3 if len(x) else 0):
        y = np.concatenate([min_cut(t @ weights, edges) for t, edges in pages]).astype(float)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            weights = weights - 0.5 * (x.T @ (p - y) / len(x) + pull * (weights - prior))
    return weights


def min_cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which of the nodes are on the source's side of a minimum cut.

    cost: log odds, the capacity from the source if positive, else to the
    sink. edges: (a, b, capacity both ways). Dinic's algorithm; of the minimum
    cuts it takes the one with fewest nodes on the source's side.
    """
    n = len(cost)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            add(source, i, float(c), 0.0)
        elif c < 0:
            add(i, sink, float(-c), 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)])
        following = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[at] < len(out[at]):
                e = out[at][following[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                following[at] += 1
            else:
                if at == source:
                    break
                e = path.pop()
                at = to[e ^ 1]
                following[at] += 1
                continue
            path.append(e)
            at = to[e]


def smoothness(found: list[Block], strength: float = STRENGTH) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours in page order, more the more ancestors they share; siblings that others stand between."""
    edges = []
    last_in: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            x, y = found[i - 1].element, b.element
            deepest = max(x.depth, y.depth, 1)
            while x is not y:
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
            edges.append((i - 1, i, strength * (0.1 + 0.9 * x.depth / deepest)))
        parent = id(b.element.parent)
        if parent in last_in and last_in[parent] < i - 1:
            edges.append((last_in[parent], i, strength * 0.5))
        last_in[parent] = i
    return edges


def main_text(page: str, weights: np.ndarray, strength: float = STRENGTH) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    kept = min_cut(features(found) @ weights, smoothness(found, strength))
    return "\n".join(b.text for b, k in zip(found, kept) if k)


def _main_texts(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x, weights) if x else "" for x in batch.column(2).to_pylist()]
        yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks_of(x) for x in batch.column(0).to_pylist()]
        edges = [np.array(smoothness(b), float).reshape(-1, 3).tobytes() for b in found]
        yield pa.record_batch({"x": pa.array([features(b).tobytes() for b in found], pa.binary()), "edges": pa.array(edges, pa.binary())})


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Minimum-cut labelling: the classifier's log odds of a block being content
    are the capacities to the terminals; neighbours in the page and in the
    element tree are joined by smoothness edges; the maximum flow's cut
    separates content from the rest. Character references are decoded, white
    space in a block becomes one space, blocks are joined by a line break in
    page order.

    The classifier is trained here on the blocks of at most TRAINING_PAGES
    pages, labelled by the cut itself, from what is known of tags and names
    (PRIOR). A null or empty page has an empty text; repeated rows give
    repeated rows, equal pages equal texts; other columns are left alone; no
    pages give no rows; a page may stop anywhere.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    some = rows.filter("html is not null").select("html", F.xxhash64("page_id", "html").alias("o")).orderBy("o").limit(TRAINING_PAGES).select("html")
    held = sorted((bytes(x), bytes(e)) for x, e in some.mapInArrow(_examples, "x binary, edges binary").collect())
    edges = lambda e: [(int(a), int(b), c) for a, b, c in np.frombuffer(e, np.float64).reshape(-1, 3).tolist()]
    weights = train([(np.frombuffer(x, np.float64).reshape(-1, len(FEATURES)), edges(e)) for x, e in held])
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return rows.mapInArrow(lambda it: _main_texts(it, weights), schema)
