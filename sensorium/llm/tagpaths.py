"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks; each block has the path of its open elements from the root
(inline elements left out). Text length and punctuation are added up for each path and
set against its number of tags; the ratios are smoothed over neighbouring paths in page
order, the two are fused by a product, and paths below a share of the page's spread fail.
The outermost article or main element of the best path is the container; without one, the
smallest that joins the chosen paths. In it, link lists and failing paths go, save headings,
elements of running text and short blocks between others.
Paths through elements that never hold the article are out from the start, and those through
elements with such class or id words too, unless the element holds an article or main element
or, on pages without these, most of the text. Inside an article, words that also name content ("related",
"notice") only halve a path's score.
"""

from __future__ import annotations

import html
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas select option button form nav footer aside menu dialog audio video map fieldset textarea title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Words of class and id names that mark what is no article.
OUTSIDE = re.compile(
    r"(?:^|[\s_-])(ad|ads|adbox|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|side|aside|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|comment|comments|disqus|replies|respond|related|recommended|widget|pagination|pager|tags|hidden)(?=$|[\s_-])",
    re.I,
)
#: Of these, words that also name content of an article.
EITHER = frozenset("alert comment comments header hidden menu notice notices overlay promo related replies respond share sharing side social tags widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？؟،।]")
CONTAINERS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text; others (div, section) are boxes.
RUNNING = frozenset("p li pre td th dt dd blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
#: Characters of a block that may stay between others by its place alone.
SHORT = 200


@dataclass
class Block:
    path: tuple[str, ...]
    outside: bool
    parts: list[str] = field(default_factory=list)
    links: int = 0
    #: Numbers of the open elements whose class or id has a word of OUTSIDE.
    marks: tuple[int, ...] = ()
    #: Inside an article, under a word of EITHER.
    doubtful: bool = False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Open elements are closed as browsers close paragraphs, items and cells."""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []
    holds: set[int] = set()
    marked = 0
    now: Block | None = None
    at, links = 0, 0

    def add(raw: str, decode: bool = True) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if not raw.strip():
                return
            outside, marks, doubtful = stack[-1][1:] if stack else (False, (), False)
            now = Block(tuple(e[0] for e in stack), outside, marks=marks, doubtful=doubtful)
            out.append(now)
        text = html.unescape(raw) if decode else raw
        now.parts.append(text)
        if links:
            now.links += len(text)

    def close(upto: int) -> None:
        nonlocal now
        if len(stack) > upto:
            del stack[upto:]
            now = None

    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = max(found.end(), at + 1)
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>"), False)
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if found[1] else 1))
            continue
        if name == "br":
            add(" ", False)
            continue
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            now = None
            links = 0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?|$", re.I).search(page, at)
            at = end.end() if end.end() > at else size
            continue
        now = None
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ITEMS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ITEMS[name]:
                    close(k)
                    break
                if stack[k][0] in SCOPES[name]:
                    break
        if name in VOID:
            continue
        if name == "body" or name == "html":
            close(next((k for k, e in enumerate(stack) if e[0] == "head"), len(stack)))
        outside, marks, doubtful = stack[-1][1:] if stack else (False, (), False)
        inside = any(e[0] in CONTAINERS for e in stack)
        outside = outside or _outside(name, found[3], inside)
        if not outside and name in CONTAINERS:
            holds.update(marks)
        words = _words(name, found[3])
        if inside and words and words <= EITHER:
            doubtful = doubtful or words != {"header"}
        elif words:
            marks += (marked,)
            marked += 1
        stack.append((name, outside, marks, doubtful))
    return _judged([b for b in out if b.text()], holds)


def _judged(blocks: list[Block], holds: set[int]) -> list[Block]:
    """Blocks under marked elements are outside, save where the element holds an article or main or, on pages without these, most of the text."""
    if not any(b.marks for b in blocks):
        return blocks
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        if not b.outside:
            size = max(0, len(b.text()) - b.links)
            total += size
            for k in b.marks:
                held[k] = held.get(k, 0) + size
    free = holds
    if not any(c in b.path for b in blocks if not b.outside for c in CONTAINERS):
        free = holds | {k for k, size in held.items() if 2 * size > total}
    for b in blocks:
        b.outside = b.outside or not free.issuperset(b.marks)
    return blocks


def _words(name: str, attributes: str) -> set[str]:
    """Words of OUTSIDE in the class and id of an element that may be outside for them."""
    if name in ("html", "body", "header") or name in CONTAINERS or name in HIDDEN or not attributes or "=" not in attributes:
        return set()
    values = ["".join(v) for k, *v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id")]
    return {m[1].lower() for v in values for m in OUTSIDE.finditer(v)}


def _outside(name: str, attributes: str, inside: bool) -> bool:
    if name in HIDDEN:
        return True
    if name == "header":
        # a header is the page's own unless an article holds it
        return not inside
    if name in ("html", "body") or not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _smooth(values: np.ndarray) -> np.ndarray:
    """Mean of each value and its neighbours."""
    padded = np.concatenate([[0.0], values, [0.0]])
    count = np.full(len(values), 3.0)
    count[0] -= 1
    count[-1] -= 1
    return (padded[:-2] + padded[1:-1] + padded[2:]) / count


def select(blocks: list[Block], spread: float = 0.5) -> list[Block]:
    """The blocks of the paths that pass, and of the container that joins them."""
    inside = [b for b in blocks if not b.outside]
    if not inside:
        return []
    key = lambda b: (b.path, b.doubtful)
    paths = list(dict.fromkeys(map(key, inside)))
    number = {p: k for k, p in enumerate(paths)}
    tags, length, points = np.zeros(len(paths)), np.zeros(len(paths)), np.zeros(len(paths))
    for b in inside:
        k, text = number[key(b)], b.text()
        tags[k] += 1
        length[k] += max(0, len(text) - b.links)
        points[k] += len(PUNCTUATION.findall(text))
    fused = _smooth(length / tags) * _smooth((points + 1) / tags)
    # doubtful paths count by themselves and half, not by their neighbours
    doubtful = np.array([d for _, d in paths])
    own = length / tags * (points + 1) / tags
    fused = np.where(doubtful, 0.5 * own, fused)
    # text share keeps a path of many short blocks ahead of one long notice
    fused *= 1 + length / max(1.0, length.sum())
    least = spread * (fused.std() if len(paths) > 1 else 0.0)
    keep = fused >= least
    # without punctuation a path does not pass by its neighbours alone
    alone = keep & ((points > 0) | (own >= least))
    best = int(np.argmax(np.where(keep, fused * length, -1)))
    article = _container(paths[best][0])
    if article is None:
        chosen = [p for (p, _), k in zip(paths, keep, strict=True) if k]
        article = os.path.commonprefix(chosen)
    held = [b for b in inside if b.path[: len(article)] == article]
    return _trimmed(held, [bool(alone[number[key(b)]]) for b in held], article)


def _trimmed(blocks: list[Block], passed: list[bool], article: tuple[str, ...]) -> list[Block]:
    """The blocks of a container without those of failing or link-heavy paths.

    Link lists (runs of a path, mostly links and without punctuation) go. What fails the threshold
    stays if it is short and between blocks that stay, if it is a heading before one, or if it is
    an element of running text (items, cells, code) of the article; doubtful blocks go.
    """
    start = 0
    good, links = list(passed), [False] * len(blocks)
    for k in range(1, len(blocks) + 1):
        if k == len(blocks) or (blocks[k].path, blocks[k].doubtful) != (blocks[start].path, blocks[start].doubtful):
            run = blocks[start:k]
            if run[0].path[-1:] and run[0].path[-1] not in HEADINGS:
                texts = [b.text() for b in run]
                heavy = 2 * sum(b.links for b in run) > sum(map(len, texts)) and sum(len(PUNCTUATION.findall(t)) for t in texts) < len(run)
                links[start:k] = [heavy] * len(run)
            start = k
    if all(links):
        return blocks
    good = [p and not h for p, h in zip(passed, links, strict=True)]
    if not any(good):
        return [b for b, h in zip(blocks, links, strict=True) if not h]
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    # on a page without article or main, joined only by its body, the ends are not the article's
    whole = article[-1:] not in ((), ("html",), ("body",))
    # of a main around an article, what stands before the article is its title and lead
    inner = [k for k, b in enumerate(blocks) if any(n in CONTAINERS for n in b.path[len(article) :])]
    low = inner[0] if inner and article[-1] == "main" else 0
    high = inner[-1] if inner and article[-1] == "main" else len(blocks)
    out = []
    for k, b in enumerate(blocks):
        stays = good[k]
        if not stays and not links[k] and not b.doubtful:
            name = b.path[-1] if b.path else ""
            between = first < k < last and len(b.text()) <= SHORT
            heading = name in HEADINGS and k < last
            running = whole and name in RUNNING and k <= high and (k >= low or name in ("p", "blockquote"))
            stays = between or heading or running
        if stays:
            out.append(b)
    return out


def _container(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """The outermost article or main element of a path."""
    for k, name in enumerate(path):
        if name in CONTAINERS:
            return path[: k + 1]
    return None


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text() for b in select(blocks_of(page or "")))


def with_text(pages: DataFrame, html_column: str = "html", result: str = "text") -> DataFrame:
    """Add the main text of each whole page; "" for null, empty or text-free pages.

    Blocks have their white space joined and are joined by an empty line, in page order.
    Rows are neither dropped nor repeated, nothing is shuffled; a column called ``text`` is replaced.
    """

    @F.arrow_udf("string")
    def extract(page: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in page], pa.string())

    return pages.withColumn(result, extract(F.col(html_column)))
