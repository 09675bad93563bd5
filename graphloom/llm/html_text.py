"""Main text of HTML pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path. For each path the text length
and the punctuation marks a node are taken; their product, and the same after smoothing both
over the page's order of nodes, are fused to the path's weight. Paths whose weight passes a
share of the page's mean are content. Elements that HTML itself sets apart (menus, forms,
asides, hidden ones) are no text of the page; a class, id or role that names something else
(adverts, reader comments and the like), links, and a place outside the one article of a page
only lower a weight, the first never for an element that holds most of the text. Blocks between
selected ones, headings in front of them, and what shares the element that holds them all, before and
behind them, are kept unless they are named otherwise or mostly links.

Defined cases: null or empty html, or none of it text, gives empty text; broken markup is read
as browsers do in the common cases (implied ends, stray ends ignored, an open comment or script
runs to the end); repeated rows give repeated results; other columns are never read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where markup starts, and what matters on the way to a tag's end.
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_IN_TAG = re.compile(r"[\"'>]")
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

#: Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("table ul ol dl select html body article section main div".split())
NEVER = frozenset("script style template noscript iframe nav aside footer form button select textarea head title menu dialog object svg canvas audio video map".split())
#: Words of a class, id or role that declare something beside the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar sidebars aside complementary contentinfo widget widgets "
    "related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond toolbar pagination pager login search searchbox copyright "
    "legal disclaimer alert skip teaser teasers".split()
)
PAGE_HEAD = frozenset(["header", "topbar"])
KEEPERS = frozenset(["html", "body", "article", "main"])
#: Elements that running text, lists and tables are made of.
FLOW = frozenset("p blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements are nested no deeper, as in browsers; deeper ones follow one another.
_DEEPEST = 512
#: Words that make a class say what a page has or lacks, not what the element is.
_STATE = frozenset("has have with without no not hide hides show shows is".split())


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "inside", "link", "named", "length", "weight", "articles")

    def __init__(self, tag: str, parent: _Element | None, out: bool, named: bool = False, paths: dict | None = None) -> None:
        self.tag, self.parent, self.out, self.named, self.length, self.weight, self.articles = tag, parent, out, named, 0, 0.0, 0
        # a path is the number of (its parent's path, tag, whether named)
        self.path = paths.setdefault((parent.path, tag, named), len(paths)) if parent else -1
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.link = tag == "a" or bool(parent and parent.link)


def _set_apart(tag: str, attributes: str, parent: _Element) -> bool:
    """Whether HTML itself says that the element is no part of the page's text."""
    if tag in NEVER or (tag == "header" and not parent.inside):
        return True
    return bool(attributes) and tag not in KEEPERS and bool(_HIDDEN.search(attributes))


def _named_aside(tag: str, attributes: str, parent: _Element) -> bool:
    """Whether class, id or role name something beside the article."""
    if not attributes or tag in KEEPERS:
        return False
    said: set[str] = set()
    for m in _HINT.finditer(attributes):
        for name in m[1].strip("\"'").lower().split():
            words = _WORDS.findall(name)
            if not _STATE & set(words):
                said.update(words)
    return bool(said & ASIDE) or bool(said & PAGE_HEAD and not parent.inside)


class _Markup:
    """Finds the pieces of markup of a page one after another, in time that grows with the page alone."""

    def __init__(self, html: str) -> None:
        self.html, self.last_end, self.quoted = html, html.rfind(">"), True
        self.closed = {q: html.rfind(q) for q in "\"'"}

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, whether an end tag, attributes) of the next piece; the tag of what isn't an element is empty."""
        html = self.html
        while m := _OPEN.search(html, pos):
            start, name = m.start(), m[2]
            if name is None and m[0] != "<!" and m[0] != "<?":
                close = "-->" if m[0] == "<!--" else "]]>"
                end = html.find(close, m.end())
                end = len(html) if end < 0 else end + 3
                return start, end, "", False, html[m.end() : end].removesuffix("]]>") if close == "]]>" else ""
            if self.last_end < m.end():
                return None
            end = html.find(">", m.end()) if name is None else self._tag_end(m.end())
            return start, end + 1, (name or "").lower(), bool(m[1]), html[m.end() : end] if name else ""
        return None

    def _tag_end(self, pos: int) -> int:
        """The end of a tag, outside its quotes; a quote that never closes is a character like any other."""
        start = pos
        while self.quoted and (m := _IN_TAG.search(self.html, pos)):
            if m[0] == ">":
                return m.start()
            pos = self.html.find(m[0], m.end()) + 1 if self.closed[m[0]] >= m.end() else m.end()
        # once quotes hide all ends up to the end of the page, they are not respected any more
        self.quoted = False
        return self.html.find(">", start)


def blocks(html: str) -> list[tuple[_Element, str, float]]:
    """(element, text, share of it in links) of each block of text that HTML doesn't set apart, in page order."""
    root, paths, markup = _Element("#", None, False), {}, _Markup(html)
    stack, found, run = [root], [], []
    at, owner, linked = 0, root, 0
    raw: str | None = None

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(html_lib.unescape("".join(run)).split()) if run else ""
        if text:
            found.append((owner, text, linked / sum(map(len, run))))
        run, linked = [], 0

    def add(text: str) -> None:
        nonlocal owner, linked
        if raw is None and text and not stack[-1].out:
            if not run:
                owner = stack[-1]
            run.append(text)
            linked += len(text) if stack[-1].link else 0

    pos = 0
    while True:
        if raw is not None:
            end = re.compile(rf"</{raw}(?=[\s/>])", re.IGNORECASE).search(html, pos)
            pos = at = end.start() if end else len(html)
            raw = None
        piece = markup.next(pos)
        if piece is None:
            break
        start, end, tag, closes_one, attributes = piece
        if start > at:
            add(html[at:start])
        at = pos = end
        if not tag:
            add(html_lib.escape(attributes))
            continue
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            flush()
        if closes_one:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                if any(e.tag not in INLINE or e.out for e in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag not in INLINE and tag not in ("html", "head", "body"):
            closes = CLOSED_BY.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in BARRIER:
                    break
        if tag in VOID or (attributes.endswith("/") and tag not in RAW and tag in INLINE):
            continue
        del stack[_DEEPEST:]
        element = _Element(tag, stack[-1], stack[-1].out or _set_apart(tag, attributes, stack[-1]), _named_aside(tag, attributes, stack[-1]), paths)
        if element.out and not stack[-1].out:
            flush()
        stack.append(element)
        if tag in RAW:
            raw = tag
    add(html[at:])
    flush()
    return found


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over the order of nodes, radius 2."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    padded = np.pad(x, 2)
    weight = np.convolve(np.pad(np.ones(len(x)), 2), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def _above(e: _Element | None) -> Iterator[_Element]:
    while e is not None:
        yield e
        e = e.parent


def path_weights(found: list[tuple[_Element, str, float]], share: float = 0.8, lower: float = 0.002) -> np.ndarray:
    """Fused weight of each block's path: text length a node times punctuation a node, plain and smoothed over the page."""
    by_path: dict[int, list[int]] = {}
    for k, (e, text, _) in enumerate(found):
        by_path.setdefault(e.path, []).append(k)
        for x in _above(e):
            x.length += len(text)
    length, marks, links = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found))
    for rows in by_path.values():
        chars = sum(len(found[k][1]) for k in rows)
        length[rows] = chars / len(rows)
        marks[rows] = sum(len(_PUNCTUATION.findall(found[k][1])) for k in rows) / len(rows)
        links[rows] = sum(len(found[k][1]) * found[k][2] for k in rows) / chars
    weights = np.sqrt(length * (1 + marks) * _smooth(length) * (1 + _smooth(marks)))
    total = sum(len(text) for _, text, _ in found)
    articles = {id(x): x for e, _, _ in found for x in _above(e) if x.tag in ("article", "main")}
    named = {id(x): x for e, _, _ in found for x in _above(e) if x.named}
    for a in articles.values():
        for x in _above(a):
            x.articles += 1
    for x in named.values():
        # what holds most of a page is beside the text only if an article stands beside it
        around = sum(id(y) in articles for y in _above(x))
        x.named = 2 * x.length < total or len(articles) > x.articles + around
    for k, (e, _, _) in enumerate(found):
        if any(x.named for x in _above(e)):
            weights[k] *= lower
    for k, (e, text, _) in enumerate(found):
        for x in _above(e):
            x.weight += weights[k] * len(text)
    one = [a for a in articles.values() if a.weight >= share * sum(weights[k] * len(found[k][1]) for k in range(len(found)))]
    if one:
        weights *= [1.0 if one[0] in _above(e) else 0.1 for e, _, _ in found]
    weights *= 1 - links
    for rows in by_path.values():
        weights[rows] = weights[rows].mean()
    return weights


def _container(elements: list[_Element]) -> _Element:
    """The innermost element, but for one of running text, that holds all the given ones."""
    common = list(_above(elements[0]))[::-1]
    for e in elements[1:]:
        own = {id(x) for x in _above(e)}
        common = [x for x in common if id(x) in own]
    while len(common) > 1 and (common[-1].tag in INLINE or common[-1].tag in FLOW):
        common.pop()
    return common[-1]


def _belongs(e: _Element, container: _Element) -> bool:
    """Whether a block lies in the container of the selected ones, or is a paragraph right beside it.

    Of a whole page's body only blocks of running text, lists and tables do: a bare division there may be anything.
    """
    way: list[_Element] = []
    for x in _above(e):
        if x is container:
            return container.tag not in ("#", "html", "body") or all(y.tag in FLOW or y.tag in INLINE for y in way)
        if x is container.parent:
            return any(y.tag in FLOW for y in way) and all(y.tag in _PARAGRAPHS or y.tag in INLINE for y in way)
        way.append(x)
    return False


def main_text(html: str | None, share: float = 0.8, least: float = 0.1) -> str:
    """The article of one page: blocks whose path weighs ``least`` of the mean character, and what belongs to them.

    ``share`` of the weight in one article or main element makes it the page's article.
    """
    found = blocks(html) if html else []
    if not found:
        return ""
    weights = path_weights(found, share)
    chars = np.array([len(text) for _, text, _ in found], float)
    keep = weights >= least * float((weights * chars).sum() / chars.sum())
    chosen = np.flatnonzero(keep)
    low, high = int(chosen[0]), int(chosen[-1])
    inside = [e.inside for e, _, _ in found]
    container = _container([found[k][0] for k in chosen])
    for k, (e, _, linked) in enumerate(found):
        # blocks between selected ones, in the article that holds them, or beside them in what holds them all
        near = low < k < high or inside[k] and (inside[low] or inside[high]) or _belongs(e, container)
        if not keep[k] and near and linked <= 0.5 and not any(x.named for x in _above(e)):
            keep[k] = True
    for k in range(len(found) - 2, -1, -1):
        e = found[k][0]
        if keep[k + 1] and not keep[k] and any(x.tag in HEADINGS for x in _above(e)) and not any(x.named for x in _above(e)):
            keep[k] = True
    return "\n\n".join(text for k, (_, text, _) in enumerate(found) if keep[k])


def extract(html: Column) -> Column:
    """Main text of an html column; each page is parsed on its own, a batch of pages at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string").asNondeterministic()(html)
