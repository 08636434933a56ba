"""Main text of web pages by tag-path ratios.

Each block of text belongs to the path of tags from the root to its leaf; a tag whose class or id names boilerplate counts
as another tag. Per path, text length, punctuation and the share of text in links are aggregated. Length and punctuation
are smoothed over neighbouring blocks in page order and fused into one score by their product; links lower it, and a
boilerplate name on the path lowers it to four tenths, once. Paths that reach a share of the page's mean score hold content, named or not.
They mark the article: the outermost ``article`` or ``main`` around what holds most of them, else the smallest element with
all of them and what is beside it. In the article, short headings, items and cells whose path reaches a far lower share stay
too, unless the path has a boilerplate name. What the standard's own elements and roles set aside (navigation, footers,
forms and the like) and what is hidden is no part of the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import Part, carried, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)""", re.S)
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡’“”\"']")
#: Elements by their part in a page (fixed values of the HTML standard).
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements and roles that are set aside (fixed values of the HTML standard), and name parts that lower a path's score.
OUTSIDE = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promoted|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|foot|masthead|site-header|page-header|topbar|toolbar|comment|comments|disqus|replies|reply|respond|discussion|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|outbrain|taboola|pagination|pager|tags|hidden|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
#: End tags of raw elements, found in the page itself: lower() may change its length.
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
#: Of what can be the article's title or lead before the element that holds its text.
LEAD = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
#: Half-width of the smoothing window; the share of the mean score that marks the article, and the share of that which stays
#: in it; the factor of paths with boilerplate names; the share of marked text over which an ``article`` or ``main`` is
#: the article, and that which the only one on a page needs.
SMOOTH, THRESHOLD, STAYS, NAMED, HALF, SOLE = 2, 0.5, 0.04, 0.4, 0.5, 0.2
#: Elements that end an open one of their family, and those that hide it (fixed values of the HTML standard).
_FAMILIES = {
    "p": ({"p"}, {"div", "article", "section", "td", "li", "body"}),
    "li": ({"li"}, {"ul", "ol", "menu", "table", "dl", "select", "body"}),
    "tr": ({"tr"}, {"ul", "ol", "menu", "table", "dl", "select", "body"}),
    "td": ({"td", "th"}, {"ul", "ol", "menu", "table", "dl", "select", "body", "tr", "tbody", "thead"}),
    "dd": ({"dd", "dt"}, {"ul", "ol", "menu", "table", "dl", "select", "body"}),
    "option": ({"option"}, {"ul", "ol", "menu", "table", "dl", "select", "body"}),
}
_FAMILY_OF = {name: family for family, (names, _) in _FAMILIES.items() for name in names} | dict.fromkeys(CLOSES_P, "p")


class _Node:
    """An element: its place in page order, the last place inside it, its path, and per family the open element to end."""

    __slots__ = ("article", "aside", "at", "chars", "last", "named", "name", "open", "parent", "path")

    def __init__(self, name: str, parent: _Node | None, named: bool, aside: bool, at: int, path: int) -> None:
        self.name, self.parent, self.named, self.aside, self.at, self.path, self.last = name, parent, named, aside, at, path, at
        self.chars = 0.0  # of marked text
        self.article = parent is not None and (parent.article or name in ("article", "main"))
        self.open = parent.open if parent is not None else {}
        changed = {f: (self if name in members else None) for f, (members, hide) in _FAMILIES.items() if name in members or name in hide}
        if changed:
            self.open = self.open | changed


def _aside(name: str, attributes: str, parent: _Node) -> bool:
    """An element or role that the standard sets apart from the content."""
    if name in OUTSIDE or (name == "header" and not parent.article):
        return True
    return bool(attributes) and any(k.lower() == "role" and (a or b or c).lower() in OUTSIDE_ROLES for k, a, b, c in _ATTR.findall(attributes))


def _boilerplate(name: str, attributes: str) -> bool:
    """A class or id that names boilerplate."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return any(k.lower() in ("class", "id") and OUTSIDE_NAMES.search(a or b or c) for k, a, b, c in _ATTR.findall(attributes))


def _hidden(attributes: str) -> bool:
    """The element is never shown."""
    for k, a, b, c in _ATTR.findall(attributes):
        k, v = k.lower(), a or b or c
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", "").lower()):
            return True
    return False


@dataclass
class _Page:
    """Elements in page order, and blocks of text: their elements, texts, and lengths of text in links."""

    nodes: list[_Node]
    at: list[_Node]
    texts: list[str]
    linked: list[int]


def _parsed(page: str) -> _Page:
    """Elements without inline ones, in one pass: each is opened and closed once, whatever the depth."""
    paths: dict[tuple[int, str, bool], int] = {}
    root = _Node("", None, False, False, 0, 0)
    out = _Page([root], [], [], [])
    node, run, linked = root, [], 0
    depth: dict[str, int] = {}  # open elements by name
    inline: list[tuple[bool, bool]] = []  # of open inline elements: boilerplate, link
    outside = anchors = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text and not node.aside:
                out.at.append(node)
                out.texts.append(text)
                out.linked.append(min(linked, len(text)))
            linked = 0

    def ended(up: _Node) -> _Node:
        """The parent of ``up``, which is closed with all that is open inside it."""
        x = node
        while True:
            depth[x.name] -= 1
            x.last = len(out.nodes) - 1
            if x is up:
                return x.parent
            x = x.parent

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not outside:
            run.append(text)
            if anchors:
                linked += len(text)
        if not m:
            break
        at = m.end()
        close, name = m.group(1), (m.group(2) or "").lower()
        if not name:
            continue
        end = _INSIDE.match(page, at).end()
        if page[end : end + 1] != ">":  # a quote that is never closed: the tag ends at the next bracket
            end = page.find(">", at)
            end = n if end < 0 else end
        attributes, at = page[at:end], min(n, end + 1)
        empty = attributes[-1:] == "/"
        if name in INLINE:
            if close:
                if inline:
                    x, y = inline.pop()
                    outside, anchors = outside - x, anchors - y
            elif not empty:
                inline.append((bool(attributes) and (_aside(name, attributes, node) or _boilerplate(name, attributes) or _hidden(attributes)), name == "a"))
                outside, anchors = outside + inline[-1][0], anchors + inline[-1][1]
            continue
        if name == "br":
            run.append(" ")
            continue
        if close:
            if depth.get(name, 0):
                up = node
                while up.name != name:
                    up = up.parent
                flush()
                node = ended(up)
                inline.clear()
                outside = anchors = 0
            continue
        hidden = bool(attributes) and name not in VOID and name not in ("html", "body") and _hidden(attributes)
        if name in RAW:
            if not empty:
                closing = _RAW_END[name].search(page, at)
                at = n if closing is None else (page.find(">", closing.start()) + 1 or n)
            continue
        flush()
        inline.clear()
        outside = anchors = 0
        up = node.open.get(_FAMILY_OF.get(name, ""))
        if up is not None:
            node = ended(up)
        if name not in VOID and not empty:
            named = _boilerplate(name, attributes)
            path = paths.setdefault((node.path, name, named), len(paths) + 1)
            node = _Node(name, node, node.named or named, node.aside or hidden or _aside(name, attributes, node), len(out.nodes), path)
            out.nodes.append(node)
            depth[name] = depth.get(name, 0) + 1
    flush()
    while node is not root:
        node = ended(node)
    root.last = len(out.nodes) - 1
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-SMOOTH, SMOOTH + 1) / 1.0) ** 2)
    near = lambda v: np.convolve(v, weights)[SMOOTH : SMOOTH + len(x)]
    return near(x) / near(np.ones(len(x)))


def path_scores(path: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray, named: np.ndarray) -> np.ndarray:
    """For each block the score of its path, in means of the page's (weighted by length).

    A block's score is the root of smoothed length, of punctuation and of the path's own length, lowered by the path's share
    of links; the path's score is the mean of its blocks', times NAMED where it has a boilerplate name.
    """
    of = np.unique(path, return_inverse=True)[1]
    count, size = np.bincount(of), np.bincount(of, length)
    lowered = (1 - np.bincount(of, linked) / size) ** 2
    text_ratio, mark_ratio = size / count * lowered, np.bincount(of, marks) / count * lowered
    fused = np.sqrt(_smooth(text_ratio[of]) * (1 + _smooth(mark_ratio[of])) * np.maximum(size / count, 1)[of]) * lowered[of]
    by_path = np.bincount(of, fused * length) / size * np.where(np.bincount(of, named) > 0, NAMED, 1.0)
    mean = float((by_path * size).sum() / length.sum())
    return by_path[of] / mean if mean > 0 else np.ones(len(path))


def extract(page: str | None) -> str:
    """The article's text: blocks in page order joined by one blank; empty for null, empty or textless pages.

    Time and memory are in proportion to the page, however deep its elements are.
    """
    found = _parsed(page) if page else None
    if found is None or not found.texts:
        return ""
    length = np.array([len(t) for t in found.texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in found.texts], float)
    path = np.array([x.path for x in found.at])
    named = np.array([x.named for x in found.at])
    score = path_scores(path, length, marks, np.array(found.linked, float), named)
    for x, size, use in zip(found.at, length, score >= THRESHOLD, strict=True):
        x.chars += size if use else 0.0
    for x in reversed(found.nodes[1:]):
        x.parent.chars += x.chars
    first, last, lead = _article(found)
    stays = (score >= THRESHOLD) | (~named & (score >= THRESHOLD * STAYS))
    return " ".join(t for x, t, s in zip(found.at, found.texts, stays, strict=True) if s and (first <= x.at <= last or x.at in lead))


def _article(found: _Page) -> tuple[int, int, set[int]]:
    """First and last place of the article's elements, and the places of titles and leads before it."""
    total = found.nodes[0].chars
    most = [x for x in found.nodes if x.chars > HALF * total or x.chars >= total]  # each inside the one before
    outer = [x for x in found.nodes if x.name in ("article", "main") and x.parent is not None and not x.parent.article]
    sole = outer[0] if len(outer) == 1 and outer[0].chars >= SOLE * total > 0 else None
    top = next((x for x in most if x.name in ("article", "main")), sole)
    if top is not None:
        return top.at, top.last, set()
    top = [x for x in most if x.chars >= total][-1]
    if top.name in ("", "html", "body"):
        return top.at, top.last, set()
    while top.parent.name not in ("", "html", "body", "td", "th"):
        top = top.parent
    return top.at, top.last, {x.at for x in found.nodes[: top.at] if x.parent is top.parent and x.name in LEAD}


def extract_pages(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, text and n_chars (code points) per page; whole pages of any length, null ones give empty texts.

    Null and repeated keys are pages of their own; an empty table gives no rows; other columns, whatever their names, are
    not read.
    """

    def run(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for kept, column in parts:
            texts = [extract(t.as_py()) for t in column]
            yield kept, [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return carried(pages, key, source, "text string, n_chars long", run)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the url goes through as part of the key, so rows are neither joined nor moved
    rows = extract_pages(pages.select(F.struct("page_id", "url").alias("k"), "html"), "k")
    return rows.select("k.page_id", "k.url", "text", "n_chars")


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE: dict[str, str] = {}
