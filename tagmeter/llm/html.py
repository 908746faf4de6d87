"""Operator 9, main text of HTML by line-block distribution.

Markup is stripped to lines, one for each block element's text.  A line's
weight is the number of its code points outside links; roles only lower it: in
furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments) it is 0, and outside marked content (``article``, ``main``) a quarter
where the page marks any.  Weights are summed over sliding windows of lines.  A
passage begins where a window's sum surges to ``SURGE`` code points, or to half
of the page's heaviest window if that is less, and ends where the sums dive to
nothing; once one has begun, any later weight begins another.  Text between a
surge and its dive is the page's.

Marked content that such a passage meets is taken from its first to its last
line, so its short lines and those that are all link stay, and then nothing
outside counts.  Marked content that no passage meets decides nothing: a long
text beside ``article`` teasers is found by its windows.

Furniture is told by the element or by a whole class, id or role token: the
word itself, a compound that ends in it (``site-header``, but not
``has-sidebar``) or that begins with it and ends in a word like ``box``.  Where
all of a page's surging windows or all its marked content stand in furniture,
the marks around them don't hold.

Defined cases: a null or empty page gives an empty text; unclosed and stray
tags are tolerated: a list item, cell or paragraph ends where the next begins,
a head where text begins, an element without text (``RAW``) that has no end tag
loses its start tag only, but for script and style, which then last to the end
of the page, as do a comment and a tag that nothing ends; character references
are decoded after the markup is gone; white space inside a line becomes one
space; equal pages give equal texts; time and memory are linear in the page.
Nothing is dropped for its size, but for lines before the first surge that
stand outside marked content.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces

#: Lines in a window.
WINDOW = 3
#: Code points in a window that make a surge on any page.
SURGE = 80
#: Lines outside marked content weigh this part of their size.
OUTSIDE = 4

#: Elements whose content isn't text.
RAW = frozenset("script style title noscript template textarea iframe object select".split())
#: Elements whose text stays in the line around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mrow mfrac msup msub msqrt mtext semantics svg g text tspan path picture source".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Words of a class, id or role token that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search form comment comments reply replies respond disqus share sharing social related recommended pagination pager complementary contentinfo".split()
)
#: Words after a mark that leave it one, and words before it that undo it.
HOLDERS = frozenset("area bar block box button buttons column container content form inner item items left link links list main panel right row section slot top unit widget wrap wrapper".split())
UNDO = frozenset("has is no non not with without".split())
CONTENT = frozenset(("article", "main"))

#: What an opening tag ends where it stands directly inside: each name with
#: the elements beyond which it doesn't look.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ()),
}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r"=\s*[\"']|>")
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")


def _furniture_token(token: str) -> bool:
    parts = _PARTS.findall(token)
    if not parts or parts[0] in UNDO:
        return False
    return parts[-1] in MARKS or (parts[0] in MARKS and len(parts) > 1 and parts[-1] in HOLDERS)


def _marked(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    return any(_furniture_token(t) for m in _NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split())


class _Page:
    """Lines of a page: parts of text with the furniture around each.

    ``above`` and ``hard`` describe furniture nodes (0 is none) by the node
    around them and whether the element itself tells; ``contents`` has the
    node around each marked content and the content around that.
    """

    def __init__(self, page: str) -> None:
        self.lines: list[tuple[int, list[tuple[int, bool, str]]]] = []
        self.above, self.hard = [0], [False]
        self.contents: list[tuple[int, int]] = []
        self._parse(page)

    def _parse(self, page: str) -> None:
        text: list[tuple[int, bool, str]] = []
        names: list[str] = []  # open elements, their furniture and content before
        back: list[tuple[int, int]] = []
        where: dict[str, list[int]] = {}  # places of open elements by name
        node, content, links = 0, -1, 0

        def close() -> None:
            nonlocal text
            if text:
                self.lines.append((content, text))
                text = []

        def leave(depth: int) -> None:
            """Close the elements from *depth* on."""
            nonlocal node, content
            while len(names) > depth:
                where[names.pop()].pop()
                node, content = back.pop()

        def enter(name: str, furniture: bool, hard: bool) -> None:
            nonlocal node, content
            where.setdefault(name, []).append(len(names))
            names.append(name)
            back.append((node, content))
            if furniture:
                self.above.append(node)
                self.hard.append(hard)
                node = len(self.above) - 1
            elif name in CONTENT:
                self.contents.append((node, content))
                content = len(self.contents) - 1

        def last_of(these: tuple[str, ...]) -> int:
            return max((where[n][-1] for n in these if where.get(n)), default=-1)

        at, size = 0, len(page)
        endless: set[str] = set()  # what no later text ends
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                text.append((node, links > 0, page[at:mark]))
            if mark == size:
                break
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 2)
                at = size if end < 0 else end + 3
                continue
            m = _NAME.match(page, mark + 1)
            if m is None:
                if page[mark + 1 : mark + 2] in ("!", "?", "/"):
                    end = page.find(">", mark)
                    at = size if end < 0 else end + 1
                else:  # a sign in the text
                    text.append((node, links > 0, "<"))
                    at = mark + 1
                continue
            # the tag's end: the first > outside quoted values
            end = m.end()
            while stop := _IN_TAG.search(page, end):
                end = stop.end()
                quote = page[end - 1]
                if quote == ">":
                    break
                if quote not in endless:
                    closing = page.find(quote, end)
                    if closing < 0:
                        endless.add(quote)
                    else:
                        end = closing + 1
            if stop is None:  # nothing ends it
                break
            at = end
            name, attributes = m[0].lower(), page[m.end() : end - 1]
            ending = name[0] == "/"
            name = name.lstrip("/")
            if name in RAW:
                if ending:
                    continue
                text.append((node, links > 0, " "))
                if name not in endless:
                    closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                    if closing:
                        at = closing.end()
                        continue
                    endless.add(name)
                if name in ("script", "style"):
                    break
                continue
            if name in INLINE:
                if name == "a":
                    links = max(0, links + (-1 if ending else 1))
                elif name == "br":
                    text.append((node, links > 0, " "))
                if ending:
                    if where.get(name) and all(n in INLINE for n in names[where[name][-1] :]):
                        leave(where[name][-1])
                elif name not in VOID and _marked(attributes) and not attributes.endswith("/"):
                    enter(name, True, False)
                continue
            close()
            links = 0
            while names and names[-1] in INLINE:
                leave(len(names) - 1)
            if name in VOID:
                continue
            if ending:
                if where.get(name):
                    leave(where[name][-1])
                continue
            if names and names[-1] == "p":
                leave(len(names) - 1)
            if name in _ENDS:
                these, beyond = _ENDS[name]
                while (k := last_of(these)) > last_of(beyond):
                    leave(k)
            hard = name in FURNITURE
            enter(name, hard or (name not in ("body", "head", "html") and _marked(attributes)), hard)
        close()

    def furniture(self, undone: set[int], hard_only: bool = False) -> list[bool]:
        """Whether a node, or one around it, is furniture that holds."""
        out = [False]
        for i in range(1, len(self.above)):
            out.append(out[self.above[i]] or (i not in undone and (self.hard[i] or not hard_only)))
        return out

    def around(self, node: int) -> set[int]:
        out = set()
        while node:
            out.add(node)
            node = self.above[node]
        return out


def _weighed(page: _Page, furniture: list[bool]) -> list[tuple[str, int, int]]:
    """(text, code points outside links, content) of each line with text."""
    out = []
    for content, parts in page.lines:
        kept = [(linked, html.unescape(t)) for node, linked, t in parts if not furniture[node]]
        text = " ".join("".join(t for _, t in kept).split())
        if text:
            free = text if not any(linked for linked, _ in kept) else " ".join("".join(" " if linked else t for linked, t in kept).split())
            out.append((text, len(free), content))
        elif any(furniture[node] and not t.isspace() for node, _, t in parts):
            out.append(("", 0, -1))  # a line of furniture has no weight
    return out


def _sums(weight: list[int], window: int) -> list[int]:
    """Sums over the window that begins at each line."""
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    n = len(weight)
    return [total[min(n, i + window)] - total[i] for i in range(n)]


def passages(weight: list[int], window: int, need: int) -> list[tuple[int, int]]:
    """(surge, dive) of each passage, end exclusive."""
    sums, out, i, n = _sums(weight, window), [], 0, len(weight)
    while i < n:
        if not weight[i] or sums[i] < need:
            i += 1
            continue
        j = i + 1
        while j < n and sums[j] > 0:
            j += 1
        out.append((i, j))
        i, need = j, 1
    return out


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not page:
        return ""
    found = _Page(page)
    furniture = found.furniture(set())
    lines = _weighed(found, furniture)
    if not any(text for text, _, _ in lines) or (found.contents and all(furniture[n] for n, _ in found.contents) and max(_sums([w for _, w, _ in lines], window)) < surge):
        # all that could be the text is held by furniture
        held = set().union(*(found.around(n) for n, _ in found.contents)) if found.contents else set()
        for undone, hard_only in ((held, False), (held, True), (set(range(len(found.above))), True)):
            furniture = found.furniture(undone, hard_only)
            lines = _weighed(found, furniture)
            if any(text for text, _, _ in lines):
                break
    holds = [not furniture[n] for n, _ in found.contents]
    inside = [c >= 0 and holds[c] for _, _, c in lines]
    marked = any(inside)
    # a line that is all link is text inside marked content
    weight = [(w or len(t)) if k else w // OUTSIDE if marked else w for (t, w, _), k in zip(lines, inside, strict=True)]
    sums = _sums(weight, window)
    need = max(1, min(surge, -(-max(sums, default=0) // 2)))
    met = passages(weight, window, need)
    outer = list(range(len(found.contents)))
    for i, (_, above) in enumerate(found.contents):
        if above >= 0 and holds[above]:
            outer[i] = outer[above]
    own = _sums([w if k else 0 for w, k in zip(weight, inside, strict=True)], window)
    if marked and max(own) >= need:
        # passages that meet marked content spread over it, and end at it
        hit = {outer[lines[i][2]] for a, b in met for i in range(a, b) if inside[i]}
        kept = [t for (t, _, c), k in zip(lines, inside, strict=True) if k and outer[c] in hit]
    else:
        plain = [w for _, w, _ in lines]
        sums = _sums(plain, window)
        met = passages(plain, window, max(1, min(surge, -(-max(sums, default=0) // 2))))
        kept = [lines[i][0] for a, b in met for i in range(a, b) if plain[i]]
    return "\n".join(kept or [t for t, _, _ in lines if t])


def extract_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns *keep*, text and n_chars."""

    def make(piece: pa.RecordBatch) -> dict:
        text = [extract(p, window, surge) for p in piece.column("html").to_pylist()]
        return {c: piece.column(c) for c in keep} | {"text": text, "n_chars": [len(t) for t in text]}

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_pieces(pages.select(*keep, F.col("html")), make, f"{schema}, text string, n_chars long", "html")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html": op9_html}
ORACLES: dict[str, str] = {}
