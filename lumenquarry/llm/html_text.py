"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks, each with the path of block elements from the root to it. For each path the text length and
the punctuation of its blocks are summed and divided by their number; both ratios are smoothed over the paths in
page order, fused by multiplication, and paths over the threshold (a share of the standard deviation) are content. The
article is the smallest element around all content blocks and the headline, or the article or main element around that; all its
blocks are kept, but for those in menus, forms, notices, adverts, reader comments or elements that aren't shown. Where only the body is around
them all, what stands before the one headline and outside its element isn't the article's, nor what follows the last content block's element.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Elements that start a block, elements whose text isn't shown, and elements that aren't the article.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title button label select option iframe object canvas audio video".split())
BESIDE = frozenset("nav header footer aside menu dialog".split())
#: Parts of names that tell what isn't the article, and parts that may stand beside them in a name.
BESIDE_PART = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|sidebar|complementary|contentinfo|footer|masthead|comments?|replies|respond|disqus|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|widget|login|search", re.I)
NEUTRAL_PART = re.compile(r"site|page|main|global|top|bottom|left|right|primary|secondary|bar|box|list|links?|buttons?|icons?|area|section|block|wrap(?:per)?|container|inner|outer|form|signup|thread|user|reader|posts?|articles?|stories|items?|[0-9]+", re.I)
SITE_HEADER = re.compile(r"(?:(?:site|main|global|top)[-_]+)?header", re.I)
AUTHOR_BOX = re.compile(r"(?:(?:post|entry)[-_]+)?(?:author|writer)[-_]+(?:box|bio|card|info|profile)|about[-_]+(?:the[-_]+)?(?:author|writer)", re.I)
#: What makes an attribute style hide its element.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements that mark an article, and those that can be one.
ARTICLE = frozenset("article main".split())
AROUND = frozenset("html body main article section div form".split())
#: Elements that no name makes other than the article, and those that show where the article is.
NEVER = frozenset("html body main article".split())
HEADS = frozenset("h1 article main".split())
#: Elements whose content isn't markup; theirs isn't shown either.
RAW = frozenset("script style noscript template textarea svg math".split())
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def _names(rest: str) -> tuple[list[str], str]:
    """The names in a tag's class, id and role, and its class."""
    names, classes = [], ""
    if "=" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            if (name := name.lower()) in ("class", "id", "role"):
                value = values[0] or values[1] or values[2]
                names += value.split()
                classes = value if name == "class" else classes
    return names, classes


def _unseen(rest: str) -> bool:
    """Whether a tag's attribute hidden or style hides its element."""
    small = rest.lower()
    if "hidden" not in small and "none" not in small:
        return False
    for name, *values in _ATTRIBUTE.findall(rest):
        value = values[0] or values[1] or values[2]
        if (name.lower() == "hidden" and value.lower() != "until-found") or (name.lower() == "style" and UNSEEN.search(value)):
            return True
    return False


@functools.lru_cache(10_000)
def _suggests(name: str) -> bool:
    """Whether a whole name, each part of it, suggests what isn't the article."""
    parts = [x for x in re.split("[-_]+", name) if x]
    known = [bool(BESIDE_PART.fullmatch(x)) for x in parts]
    return bool(SITE_HEADER.fullmatch(name) or AUTHOR_BOX.fullmatch(name)) or (any(known) and all(k or NEUTRAL_PART.fullmatch(x) for k, x in zip(known, parts, strict=True)))


class Element:
    """A block element: path is a number for the tags and classes from the root to it; ids are no part of it.

    beside: it is, or lies in, what isn't the article by its element. named: its name, or that it is a form, suggests so.
    """

    __slots__ = ("parent", "tag", "path", "depth", "beside", "named", "inside", "size", "heads")

    def __init__(self, parent: Element | None, tag: str, path: int, beside: bool, named: bool):
        self.parent, self.tag, self.path, self.beside, self.named, self.inside = parent, tag, path, beside, named, False
        self.size = self.heads = 0
        self.depth = parent.depth + 1 if parent else 0


class _Ends:
    """Where the next end tag of a name begins and ends. Answers are kept, so that a page is searched once for each name."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def after(self, tag: str, at: int) -> tuple[int, int] | None:
        if tag not in self.known or (self.known[tag] and self.known[tag][0] < at):
            m = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>", re.I).search(self.page, at)
            self.known[tag] = m.span() if m else None
        return self.known[tag]


def _end_of_tag(page: str, at: int, without: set[str]) -> int:
    """The place of the > that ends a tag whose name ends at ``at``; -1 if the page ends first.

    A quote opens a value after = if what follows the next such quote can follow a value; other quotes are
    signs like others. ``without`` keeps which quotes the rest of the page has none of.
    """
    while m := _MARK.search(page, at):
        at = m.end()
        quote = m[0]
        if quote == ">":
            return m.start()
        if quote in without or not page[max(0, m.start() - 20) : m.start()].rstrip().endswith("="):
            continue
        close = page.find(quote, at)
        if close < 0:
            without.add(quote)
        elif close + 1 == len(page) or page[close + 1] in " \t\r\n\f/>":
            at = close + 1
    return -1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(tag, "/" for an end tag, what else is in the tag), or ("", "", text). Time grows with the page's length alone.

    What the page's end cuts off, within a tag, comment or raw element, is left out.
    """
    at, ends, without = 0, _Ends(page), set()
    while True:
        lt = page.find("<", at)
        if lt != at and page[at : lt if lt >= 0 else None]:
            yield "", "", page[at : lt if lt >= 0 else None]
        if lt < 0:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3
        elif m := _TAG.match(page, lt + 1):
            end = _end_of_tag(page, m.end(), without)
            at, tag, rest = end + 1, m[2].lower(), page[m.end() : end]
            if end >= 0 and tag in RAW and not m[1]:
                if rest.endswith("/"):
                    continue
                found = ends.after(tag, at)
                end = at = found[1] if found else -1
            elif end >= 0:
                yield tag, m[1], rest
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt + 1)
            at = end + 1
        else:
            yield "", "", "<"
            at = end = lt + 1
        if end < 0:
            return


def _parsed(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """All block elements in page order, the root first, and (element, text) of each block with text."""
    root = Element(None, "", 0, False, False)
    elements, stack, paths, open_tags = [root], [root], {}, Counter()
    out, parts = [], []
    hidden: list[tuple[str, int, bool]] = []  # tag, depth, and whether an end tag follows
    tokens = list(_tokens(page))
    ends = Counter(tag for tag, end, _ in tokens if end)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((stack[-1], text))

    def pop() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        while hidden and hidden[-1][1] > len(stack):  # what is open in an element ends with it
            hidden.pop()
        return tag

    for tag, end, rest in tokens:
        ends[tag] -= bool(end)
        if not tag:
            if not hidden:
                parts.append(html.unescape(rest))
            continue
        if tag in HIDDEN and tag != "head":
            if end:
                if any(h[0] == tag for h in hidden):
                    while hidden.pop()[0] != tag:
                        pass
            elif not rest.endswith("/"):
                if tag == "option" and hidden and hidden[-1][0] == tag:
                    hidden.pop()
                hidden.append((tag, len(stack), ends[tag] > 0))
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            # An inline element that isn't shown, with those of its kind inside.
            if end:
                if hidden and hidden[-1][0] == tag:
                    hidden.pop()
            elif tag not in VOID and not rest.endswith("/") and ((hidden and hidden[-1][0] == tag) or _unseen(rest)):
                hidden.append((tag, len(stack), ends[tag] > 0))
            continue
        flush()
        if end:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        while hidden and not hidden[-1][2]:  # one that is never closed ends where a block begins
            hidden.pop()
        # A paragraph ends where any block begins; items and cells end where the next begins.
        if stack[-1].tag == "p":
            pop()
        if tag in _CLOSES:
            while stack[-1].tag in _CLOSES[tag]:
                pop()
        if tag not in VOID:
            names, classes = _names(rest)
            top = stack[-1]
            path = paths.setdefault((top.path, tag, classes), len(paths) + 1)
            # The header of an article holds its headline.
            beside = top.beside or tag == "head" or (tag not in ("html", "body") and _unseen(rest)) or (tag in BESIDE and not (tag == "header" and _outermost(top)))
            stack.append(Element(top, tag, path, beside, tag == "form" or (tag not in NEVER and any(map(_suggests, names)))))
            open_tags[tag] += 1
            elements.append(stack[-1])
    flush()
    _judge(elements, out)
    return elements, out


def _judge(elements: list[Element], found: list[tuple[Element, str]]) -> None:
    """Settles beside for named elements: one that wraps the article, with most of the page's text, isn't beside it."""
    for e, text in found:
        if not e.beside:
            e.size += len(text)
    for e in elements:
        e.heads += not e.beside and e.tag in HEADS
    for e in reversed(elements[1:]):
        e.parent.size += e.size
        e.parent.heads += e.heads
    root = elements[0]
    for e in elements[1:]:
        wraps = 2 * e.size > root.size and (e.heads > 0 or root.heads == 0)
        e.beside = e.beside or e.parent.beside or (e.named and not wraps)


def blocks(page: str) -> list[tuple[int, str, bool]]:
    """(path, text, beside) of each block with text, in page order."""
    return [(e.path, text, e.beside) for e, text in _parsed(page)[1]]


def _common(a: Element, b: Element) -> Element:
    """The lowest element around both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _outermost(e: Element) -> Element | None:
    """The outermost article or main element around e, if there is one."""
    found = None
    while e:
        if e.tag in ARTICLE:
            found = e
        e = e.parent
    return found


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    kernel = [math.exp(-(i * i) / (2 * radius * radius)) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(w, values[j]) for w, j in zip(kernel, range(i - radius, i + radius + 1), strict=True) if 0 <= j < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def _top(found: list[tuple[Element, str]], content: set[int]) -> Element:
    """The lowest element around all content blocks and the headline."""
    held: dict[Element, int] = {}
    for e, text in found:
        if e.path in content:
            held[e] = held.get(e, 0) + len(text)
    # Where articles hold most of the content, content outside them isn't the article's.
    marked = [e for e in held if _outermost(e)]
    chosen = marked if 2 * sum(held[e] for e in marked) > sum(held.values()) else list(held)
    headlines = {e for e, _ in found if e.tag == "h1"}
    if len(headlines) == 1:
        chosen += headlines
    top = chosen[0]
    for e in chosen[1:]:
        top = _common(top, e)
    while top.parent and top.tag not in AROUND:  # a list or a table isn't the whole article
        top = top.parent
    return _outermost(top) or top


def _holder(e: Element) -> Element:
    """The lowest element that can be an article and holds e, itself included."""
    while e.parent and e.tag not in AROUND:
        e = e.parent
    return e


def _between(kept: list[tuple[Element, str]], content: set[int]) -> list[tuple[Element, str]]:
    """Blocks from the one headline's element, if there is one, to the end of the last content block's element.

    Of the body itself only blocks count that no element of their own holds.
    """

    def belongs(e: Element, around: Element) -> bool:
        return _holder(e) is around or (around.tag not in ("", "html", "body") and _common(e, around) is around)

    heads = [i for i, (e, _) in enumerate(kept) if e.tag == "h1"]
    first = heads[0] if len(heads) == 1 else 0
    while first and belongs(kept[first - 1][0], _holder(kept[heads[0]][0])):
        first -= 1
    last = max((i for i, (e, _) in enumerate(kept) if e.path in content and i >= first), default=len(kept) - 1)
    around = _holder(kept[last][0])
    while last + 1 < len(kept) and belongs(kept[last + 1][0], around):
        last += 1
    return kept[first : last + 1]


def main_text(page: str | None, share: float = 0.5) -> str:
    elements, found = _parsed(page or "")
    found = [b for b in found if not b[0].beside]
    if not found:
        return ""
    paths: dict[int, list[float]] = {}
    for e, text in found:
        x = paths.setdefault(e.path, [0, 0, 0])
        x[0] += len(text)
        x[1] += len(_PUNCTUATION.findall(text))
        x[2] += 1
    order = list(paths)
    lengths = _smooth([paths[p][0] / paths[p][2] for p in order])
    marks = _smooth([paths[p][1] / paths[p][2] for p in order])
    fused = [a * (b + 0.1) for a, b in zip(lengths, marks, strict=True)]
    mean = sum(fused) / len(fused)
    threshold = share * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    content = [p for p, x in zip(order, fused, strict=True) if x >= threshold] or order
    # A path without any mark passes by its neighbours alone: it doesn't widen the article.
    chosen = set([p for p in content if paths[p][1]] or content)
    top = _top(found, chosen)
    for e in elements:
        e.inside = e is top or (e.parent is not None and e.parent.inside)
    kept = [(e, text) for e, text in found if e.inside]
    if top.tag in ("", "html", "body"):
        kept = _between(kept, chosen)
    return "\n".join(text for _, text in kept)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(h) for h in batch["html"]]
        yield batch.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page. A null or empty page, or one without an article, has an empty text; an
    empty table gives an empty one.

    pages has page_id, url and html; other columns aren't read. Repeated rows give repeated results.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.selectExpr("cast(page_id as string) as page_id", "url", "html")
    return source.mapInPandas(_extracted, "page_id string, url string, text string, n_chars bigint").selectExpr(f"cast(page_id as {kind}) as page_id", "url", "text", "n_chars")
