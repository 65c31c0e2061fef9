"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, tag by tag, into flat blocks: runs of text between block-level tags.
Each block has shallow features: its words and link density, the words and link density of
the blocks before and after it, whether it is a heading, and what the elements it lies in say of themselves.  A
decision tree, grown here by Gini impurity on the labelled table below, says which blocks are the
article; they are joined in page order by one line feed.  Its first SHAPE_FIRST splits are by
words, links and neighbours alone; names of regions are asked only below them.

Scripts, styles, templates, comments and forms never become blocks.  Character
references are decoded; white space within a block becomes one blank, and its ends are trimmed.

Names of regions: an element is chrome by its tag or by a word of its class, id or role that means nothing
else (`footer`, `sidebar`); a word that articles use too (`more`, `related`) counts only if the
rest of the name says nothing of its own, so `related-posts` is chrome and `more-about-cats` is not.

Defined results: null and empty pages, and pages without an article, give an empty text;
broken markup (unclosed tags, a bare <, an unended comment, script or reference) is read as
far as it goes; a page without tags is one block.  Repeated pages are each read alone; other
columns pass through.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate, fresh, struct

# Names of HTML elements and of usual page regions.
SKIPPED = frozenset("script style noscript template textarea select option button form input iframe embed svg head title datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SCOPES = frozenset("html body table td th caption button".split())
LISTS = frozenset("ul ol menu".split())
CONTENT_TAGS = frozenset("article main".split())
CHROME_TAGS = frozenset("nav footer aside menu header search address dialog".split())
#: What a content tag adds to the content level of what it holds; a class or id adds 1.
BY_TAG = 1 << 20
CONTENT_WORDS = frozenset("article content main post story entry body text".split())
CHROME_WORDS = frozenset(
    """ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb
    breadcrumbs masthead topbar footer colophon copyright sidebar siderail aside widget widgets subscribe subscription newsletter signup login pagination
    pager taglist toolbar modal popup overlay cookie cookies consent gdpr disclaimer comment comments disqus respond
    outbrain taboola toc contentinfo complementary paywall""".split()
)
SHARED_WORDS = frozenset(
    """header foot legal side rail related recommended recommendations more share sharing social follow register search tags skip hidden notice notices alert
    alerts warning reply replies discussion feedback review reviews rating ratings print dialog form""".split()
)
PLAIN_WORDS = frozenset("site page top bottom left right box block section area bar list links link items item group wrapper wrap container inner outer button buttons posts articles stories icons panel col column row".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""", re.I)
_WORD = re.compile(r"[a-z]+")
_WITHOUT = re.compile(r"\b(?:no|has|with|without)[-_][a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    content: int
    chrome: int
    heading: int


def _is_chrome(words: set[str]) -> bool:
    """Whether one name, such as a class, tells a part of the page that is not the article."""
    return bool(words & CHROME_WORDS) or bool(words & SHARED_WORDS) and words <= SHARED_WORDS | PLAIN_WORDS


def _says(name: str, attributes: str) -> tuple[int, int, bool]:
    """(content, chrome, hidden) of an element by its name, class, id and role."""
    content, chrome, hidden = BY_TAG * (name in CONTENT_TAGS), int(name in CHROME_TAGS), False
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _ATTRIBUTE.finditer(attributes):
            if m[5]:
                hidden = True
                continue
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                names = [set(_WORD.findall(x)) for x in _WITHOUT.sub("", value).split()]
                if any(_is_chrome(words) for words in names):
                    chrome = 1
                elif name in BLOCK and any(words & CONTENT_WORDS for words in names):
                    content += 1
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif key == "aria-hidden" and value == "true" or key == "hidden":
                hidden = True
    return content, chrome, hidden


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int]] = []  # name, content, chrome, skipped, heading
    parts: list[str] = []
    links, linked = 0, []
    content = chrome = skipped = heading = 0
    at = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                own = text.count(" ") + 1
                inside = len(_SPACE.sub(" ", html.unescape("".join(linked))).split())
                out.append(Block(text, own, min(inside, own), content, chrome, heading))
        parts, linked = [], []

    def text(some: str) -> None:
        if not skipped:
            parts.append(some)
            if links:
                linked.append(some)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name = name.lower()
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            close()
        if m[1]:  # an end tag closes what was opened inside it; one without a start says nothing
            if name == "a":
                links = max(0, links - 1)
            if any(x[0] == name for x in stack):
                while stack:
                    was, a, b, c, d = stack.pop()
                    content, chrome, skipped, heading = content - a, chrome - b, skipped - c, heading - d
                    if was == name:
                        break
            continue
        attributes = m[3]
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                gt = page.find(">", at)
                at = gt + 1 if gt >= 0 else size
            continue
        if attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        ends = "li" if name == "li" else "p" if name in BLOCK else ""
        if ends:  # an item ends the open one of its list, a block the open paragraph
            for x in reversed(stack):
                if x[0] == ends:
                    while True:
                        was, a, b, c, d = stack.pop()
                        content, chrome, skipped, heading = content - a, chrome - b, skipped - c, heading - d
                        if was == ends:
                            break
                    break
                if x[0] in SCOPES or (ends == "li" and x[0] in LISTS):
                    break
        if name == "a":
            links += 1
            continue
        if name in BLOCK or name in SKIPPED or attributes:
            a, b, hidden = _says(name, attributes)
            if name in ("body", "html"):
                a = b = 0  # their classes speak of the whole page
            c = int(hidden or name in SKIPPED)
            d = int(len(name) == 2 and name[0] == "h" and name[1] in "123456")
            if not stack or a or b or c or d or name in BLOCK:
                stack.append((name, a, b, c, d))
                content, chrome, skipped, heading = content + a, chrome + b, skipped + c, heading + d
        if name in BLOCK:
            links = 0
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "content", "chrome", "elsewhere")
#: The features that come from names of regions, and the splits that come before any of them.
REGIONS = frozenset(k for k, f in enumerate(FEATURES) if f in ("content", "chrome", "elsewhere"))
SHAPE_FIRST = 2


def features(own: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; `elsewhere`: outside the regions that the page names as its content."""
    words = np.array([b.words for b in own], float)
    density = np.array([b.linked for b in own], float) / np.maximum(words, 1)
    pad = lambda x: np.concatenate([[0.0], x, [0.0]])
    w, d = pad(words), pad(density)
    heading = np.array([b.heading > 0 for b in own], float)
    content = np.array([b.content > 0 for b in own], float)
    chrome = np.array([b.chrome > 0 for b in own], float)
    inside = [b for b in own if b.content and not b.chrome]
    named = any(b.content >= BY_TAG for b in inside) or sum(b.words for b in inside if not b.heading) > 3
    return np.stack([words, density, w[:-2], d[:-2], w[2:], d[2:], heading, content, chrome, (1 - content) * named], axis=1)


# Pages labelled by hand, a page in each line, a block in each word: its number of words, then
# `/` and the per cent of them in links, `h` for a heading, a letter for its region (`a` content, `x` chrome, `y` chrome within
# content, none: no names), and `+` if it is a part of the article.
PAGES = """
5h+ 60+ 45+ 80+
1/100 1/100 1/100 2/100 6h+ 60+ 45+ 80+ 2/100 3/100 4/100
3/100 2/100 1/100 9h+ 70+ 5+ 48+ 20+ 18+ 1/100 1/100
2/100 4/100 1/100 3/100 30+ 12+ 40+ 7+ 25+ 3/100 2/100
4/100 6/100 3 5/100 7/100 60+ 6+ 55+ 4/100 3 2/100
1/100 7h+ 250+ 8+ 120+ 1/100
2/100 3h 4/100 6/100 5/100 8h+ 22+ 31+ 3h+ 44+ 17+ 3h 5/100 6/100 8/90
12/60 10/80 9/70 3h 9/60 52+ 38/10+ 66+ 14/75 10/90
2/100 40/25+ 33/5+ 1+ 50+ 2+ 61/8+ 5/100
6h+ 15+ 20+ 16+ 6/100 8/100
100+
12+
3+
1/100 2/100
2/100 5/60 3/100 4/75
3 2/100 4 1/100 5/80 2
1/100 2 1/100 4/100 3 2/100
9/100 8/100 7h 9/100 10/80 7h 11/100
20/70 5/100 30/75 4/100
35+ 3+ 4+ 28+ 6+ 45+ 11+
18+ 7+ 6+ 5+ 30+ 9+ 50+ 10+ 8+ 40+
6 3/100 2/100 64+ 7+ 70+ 13+ 58+ 4/100 5
8h+ 42+ 7+ 6+ 39+ 1+ 90+
5 1/100 1/100 25+ 35+ 45+ 1/100 6 1/100
1/100 4h+ 3+ 80+ 4h+ 2+ 65+ 1/100 2/100
7 2/100 3/100 8 1/100 5 2/100
90+ 8/100 60+ 6/100 5/100 4/100
30/80 28/90 2/100 55+ 35+ 3/100 40/85
7/100 8/100 66+ 9/100 6/100 33+ 8/100 70+ 10/100 50+ 7/100
10/100 61+ 11/100 12/100 58+ 14/100 9/100 40/20+ 25/30+ 70/12+ 30/20+ 8/100
16/100 65+ 20/90 48+ 12/100 36/15+ 9/100 62+ 3/100 33+ 24/80 67+ 6/100
ah8+ a60+ a45+ a80+ x12
x1/100 x1/100 x1/100 x14 ah6+ a45+ a60+ a3+ x16
x1/100 x3/100 x2/100 x5 a40+ a1+ a7/85+ a25/30+ x30 x16
x2/100 x40 a6+ a7+ a5+ a8+ a90+ y12 y30 y4/100 x20
x1/100 14 ah9+ a250+ a2+ 15 x22
6 x1/100 a10+ a12/60+ a9/100+ a70+ 35 48 x8
x90 a30+ x60 a45+ x120 a20+ y80 y6
a2+
a12+ x300
x7 x6 x6/100 a51+ x51
x60 x45 x2/100 x5 x3
30+ x14 45+ x60 20+
x1/100 x2/100 60+ 50+ x35 44+ x11/20
8h+ x30 60+ 7+ 80+ x70 x5h x9
5/100 x16 70+ 40+ x16 x1/100
a13/100+ a8/100+ a9/90+ a60+
3h 9 40 ah5+ a30+ a22+ 3h 7/100 50
"""
#: Draws for which the table says, by rule, that a region's name holds whatever the block and its neighbours are.
DRAWS = 250
_SKETCH = re.compile(r"([axy]?)(h?)(\d+)(?:/(\d+))?(h?)(\+?)$")


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for the article) of the blocks of PAGES, and of DRAWS blocks in each kind of region."""
    x, y = [], []
    for line in PAGES.strip().splitlines():
        parts = [_SKETCH.match(word).groups() for word in line.split()]
        own = [Block("", int(n), round(int(n) * int(link or 0) / 100), int(r in ("a", "y")), int(r in ("x", "y")), int(bool(h or g))) for r, h, n, link, g, _ in parts]
        x.append(features(own))
        y += [int(bool(p[-1])) for p in parts]
    rng = np.random.default_rng(5)
    for _ in range(DRAWS):
        n, before, after = np.floor(2 ** rng.uniform(0, 9.5, 3)) * (1, rng.random() < 0.8, rng.random() < 0.8)
        shape = [n, rng.choice([0, 0, 0.1, 1]), before, rng.choice([0, 0, 1]), after, rng.choice([0, 0, 1]), float(n < 30 and rng.random() < 0.3)]
        for content, chrome, elsewhere in ((1, 0, 0), (0, 1, 0), (0, 1, 1), (1, 1, 0), (0, 0, 1)):
            x.append(np.array([[*shape, content, chrome, elsewhere]]))
            y.append(int(content and not chrome))
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0, most: int = 24) -> tuple:
    """A binary tree as nested tuples: (feature, threshold, below, above), or (share of ones,)."""
    share = float(y.mean())
    best, at = len(y) * 2 * share * (1 - share) - 1e-9, None
    if depth < most and 0 < share < 1:
        for f in range(x.shape[1]):
            if f in REGIONS and depth < SHAPE_FIRST:
                continue
            order = np.argsort(x[:, f], kind="stable")
            value, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(value[1:] > value[:-1])  # after these
            if not len(cut):
                continue
            n, low = cut + 1.0, ones[cut]
            high, rest = ones[-1] - low, len(y) - n
            gini = 2 * low * (n - low) / n + 2 * high * (rest - high) / rest
            k = int(gini.argmin())
            if gini[k] < best:
                best, at = float(gini[k]), (f, float(value[cut[k]] + value[cut[k] + 1]) / 2)
    if at is None:
        return (share,)
    low = x[:, at[0]] <= at[1]
    return (*at, grow(x[low], y[low], depth + 1, most), grow(x[~low], y[~low], depth + 1, most))


def decide(tree: tuple, row: list[float]) -> float:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


_tree: list[tuple] = []


def tree() -> tuple:
    if not _tree:
        _tree.append(grow(*labelled()))
    return _tree[0]


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text of the article, its blocks, all blocks)."""
    own = blocks(page) if page else []
    if not own:
        return "", 0, 0
    rule = tree()
    kept = [b.text for b, row in zip(own, features(own).tolist()) if decide(rule, row) >= 0.5]
    return "\n".join(kept), len(kept), len(own)


def extract(pages: DataFrame, html_col: str = "html", name: str = "main") -> DataFrame:
    """pages with a struct column: text, n_kept, n_blocks."""

    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            raw = data.tobytes()
            told = [main_text(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return struct(text=pa.array([t[0] for t in told], pa.string()), n_kept=pa.array([t[1] for t in told], pa.int32()), n_blocks=pa.array([t[2] for t in told], pa.int32()))

        return work

    return annotate(pages, html_col, "struct<text:string,n_kept:int,n_blocks:int>", fresh(pages, name), make)
