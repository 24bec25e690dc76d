"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. A line weighs what of its text is not link
text; what is left out stands as blank lines between lines of different boxes. The weights of
``WINDOW`` lines are summed at every line: where the sums surge over ``SURGE`` characters the
text begins, where they dive to nothing it ends. A stretch within a content element
(``article``, ``main`` or one that says so) is widened to that element, so that short paragraphs
and headings at its edges are kept. Of the other stretches the text is kept as far as it lies
in the innermost box around all their lines that are as heavy as a surge.

* Left out wherever they stand: scripts, styles, menus, headers outside of a content element,
  footers, sidebars, forms and their controls, articles within an article (reader comments),
  and hidden elements; known by element, by role, or by a word of their class or id.
* In a content element, too, the line blocks decide what is a menu: lines that are mostly links
  are kept between lines of text, one or two together, and else left out; so is a box of three
  or more of them without a surge, with its heading.
* A word is no verdict. It does not do for headings, nor, within a content element, for inline
  elements and code; an id not for paragraphs. Boxes within a content element, and sections by
  their id anywhere, are left out by a word only if they are short or mostly links, but for
  adverts, sidebars, cookie boxes, subscriptions and reader comments that say so first. And a
  word that would leave out what outweighs all other text, on a page without a content element
  that holds any, says nothing on that page; one that names adverts, comments and the like only
  where there is no other text. A form is judged in that way, as if it were a word.
* Character references are decoded, white space within a block becomes one space (so does
  ``br`` and the edge of a table cell), blocks are trimmed and joined by one newline. Blank
  blocks vanish; nothing else is dropped or cut, and no text for being shorter than another.
* A page without a surge gives the lines of its content element, or else all lines that are not
  mostly links. A null page or one without text gives an empty text.
* A quote opens a value only behind ``=``; one that is not closed ends with its tag. Unclosed
  elements end with their parent; tags, comments and scripts without end at the page's end.
* Very long pages, deep nesting and broken markup take time and memory in proportion to the
  page's length. Repeated rows are treated alike, an empty table gives no rows; further columns
  are carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86
MARKUP = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
#: An element's name, then attributes as far as they are well formed.
TAG = re.compile(
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:\s++[^\s=<>\"'/]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>=`]++))?+)*+)\s*+/?>"
)
ATTRIBUTE = re.compile(r"([^\s=<>\"'/]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+)))?")
#: The same one by one, for tags that are not: a name, and whether a value follows.
NAME = re.compile(r"[\s/]*+(?P<name>=?[^\s/>=]*+)(?P<value>\s*+=\s*+)?+")
PLAIN = re.compile(r"[^\s>]*+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CELLS = {"td", "th"}
SPACED = CELLS | {"br"}
#: What an element ends if it is open in the same list or table: a block of any name, paragraphs.
ENDED = {
    "p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"),
    "tr": ("p", "tr"), "option": ("p", "option"),
}
BOXES = {"article", "body", "center", "div", "main", "section", "table", "td"}
HOLDERS = {"ul", "ol", "menu", "dl", "table", "select", "div", "section", "article", "main", "body"}
ASIDE = {
    "nav", "footer", "aside", "head", "svg", "object", "canvas", "audio", "video", "button",
    "select", "dialog", "menu", "search", "label", "legend",
}
ASIDE_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog",
    "dialog", "form", "menu", "menubar", "toolbar",
}
ASIDE_WORDS = {
    "ad", "ads", "adbox", "adslot", "adsense", "banner", "sponsor", "promo", "nav", "navbar",
    "menu", "footer", "masthead", "topbar", "notice", "notices", "alert", "alerts", "consent",
    "gdpr", "disqus", "respond", "reply", "replies", "share", "sharing", "related", "popup",
    "modal", "overlay", "pagination", "pager", "copyright", "toolbar", "login", "signup",
    "search", "form", "widget", "disclaimer", "skip", "teaser", "teasers",
}
ASIDE_STARTS = (
    "advert", "breadcrumb", "comment", "cookie", "navig", "newsletter", "promot", "recommend",
    "sidebar", "social", "sponsor", "subscri",
)
#: Words of a box inside the article that is left out however long it is.
STRONG_WORDS = {"ad", "ads", "adbox", "adslot", "adsense", "disqus", "consent", "gdpr", "replies"}
STRONG_STARTS = ("advert", "comment", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Blocks that an id may tell to be no article text; the ids of others are anchors.
JUDGED = BOXES | HOLDERS | {"header", "figure", "details", "address"}
CODE = {"pre", "code", "kbd", "samp"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "post", "story", "main"}


@dataclass(slots=True)
class Span:
    """Lines of an element, from the first up to the last."""

    first: int
    last: int = -1  # not closed yet
    words: frozenset[str] = frozenset()  # that speak against it


@dataclass(slots=True)
class Element:
    name: str
    aside: bool
    content: int  # number of the content element that holds it, 0 for none
    box: int  # number of the innermost box
    first: int  # its first line
    before: int  # weight of the page before it
    opens: bool = False  # is a content element
    least: int = 0  # left out if its lines weigh less
    span: Span | None = None
    ended: bool = False


@dataclass(slots=True)
class Line:
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    content: int = 0
    box: int = 0
    apart: bool = False  # something left out, or another content element, lies before it
    text: str = ""
    weight: int = 0


def tokens(html: str) -> Iterator[tuple[str, str, str | dict[str, str]]]:
    """``("text", "", text)``, ``("open", name, attributes)`` and ``("close", name, "")``.
    Every character is looked at a bounded number of times."""
    at, last = 0, {q: html.rfind(q) for q in ("'", '"')}
    while at < len(html):
        found = MARKUP.search(html, at)
        start = found.start() if found else len(html)
        if start > at:
            yield "text", "", html[at:start]
        if not found:
            return
        if html[start + 1] in "!?":
            close = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(close, start + len(close) + 1)
            at = end + len(close) if end >= 0 else len(html)
        else:
            tag = TAG.match(html, start)
            if tag:
                closes, name, at = bool(tag["end"]), tag["name"].lower(), tag.end()
                attributes = _attributes(tag["rest"]) if tag["rest"] else {}
            else:
                closes, name, attributes, at = _broken_tag(html, start, last)
            yield ("close", name, "") if closes else ("open", name, attributes)
            if not closes and name in RAW and at < len(html):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)


def _broken_tag(html: str, start: int, last: dict[str, int]) -> tuple[bool, str, dict[str, str], int]:
    """A tag with stray quotes and the like: whether it closes, name, attributes, where it ends."""
    closes = html[start + 1] == "/"
    head = re.compile(r"[a-zA-Z][^\s/>]*+").match(html, start + 1 + closes)
    name, at, attributes = head[0].lower(), head.end(), {}
    while at < len(html) and html[at] != ">":
        found = NAME.match(html, at)
        at = found.end()
        value = ""
        if found["value"]:
            quote = html[at : at + 1]
            if quote in last and last[quote] > at:
                end = html.index(quote, at + 1)
                value, at = html[at + 1 : end], end + 1
            else:
                plain = PLAIN.match(html, at)
                value, at = plain[0], plain.end()
        attributes.setdefault(found["name"].lower(), value)
    return closes, name, attributes, min(at + 1, len(html))


def _attributes(rest: str) -> dict[str, str]:
    return {n.lower(): a or b or c for n, a, b, c in ATTRIBUTE.findall(rest)}


def _named(value: str) -> list[str]:
    split = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", unescape(value)).lower()
    split = re.sub(r"\b(?:has|with|no|without)[-_]+\w+", " ", split)
    return re.findall(r"[a-z]+", split)


def _is_aside(name: str, attributes: dict[str, str], nested: bool, inside: bool) -> bool:
    """Whether an element is none of the text, whatever it holds; ``nested`` in an article."""
    if name in ASIDE or name == "header" and not inside:
        return True
    if name == "article" and nested or name in ("form", "fieldset") and inside:
        return True
    if name in ("html", "body", "main", "article") or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "") == "true":
        return True
    style = attributes.get("style")
    if style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style):
        return True
    role = attributes.get("role", "")
    return role in ASIDE_ROLES and not (role == "banner" and inside)


def _aside_word(word: str) -> str:
    """The word that is meant, empty for none: one of a fixed number."""
    if word in ASIDE_WORDS:
        return word
    return next((start for start in ASIDE_STARTS if word.startswith(start)), "")


def _strong_word(word: str) -> bool:
    return word in STRONG_WORDS or word.startswith(STRONG_STARTS)


def _judge(
    name: str, attributes: dict[str, str], inside: bool, code: bool
) -> tuple[int, frozenset[str]]:
    """What speaks against an element's text: the weight it needs to be kept, and words that
    leave it out whatever it weighs. Anchors say nothing: ids of headings, of paragraphs and of
    inline elements. The id of a section may be made of its heading."""
    nothing: frozenset[str] = frozenset()
    if name in ("form", "fieldset"):
        return 0, frozenset({"form"})
    if name in ("html", "body", "main", "article") or name in HEADINGS or code or name in CODE:
        return 0, nothing
    if name not in BLOCK and inside:
        return 0, nothing
    classes = [_named(x) for x in attributes.get("class", "").split()]
    ids = [_named(x) for x in attributes.get("id", "").split()] if name in JUDGED else []
    section = name == "section" or ["section"] in classes
    of_class = frozenset(filter(None, (_aside_word(w) for x in classes for w in x)))
    of_id = [x for x in ids if any(map(_aside_word, x))]
    words = set()
    if not inside:
        words |= of_class
        words |= {_aside_word(w) for x in of_id if not section or all(map(_aside_word, x)) for w in x}
        if name in ("div", "section", "table") and any("header" in x for x in classes + ids):
            words.add("header")
    else:
        words |= {_aside_word(x[0]) for x in classes if x and _strong_word(x[0])}
    if not section:
        words |= {_aside_word(x[0]) for x in of_id if all(map(_aside_word, x)) and _strong_word(x[0])}
    if words:
        return 0, frozenset(words - {""})
    if of_class:
        return SURGE, nothing
    return (0 if not of_id else 1 if section else SURGE), nothing


def _is_content(name: str, attributes: dict[str, str]) -> bool:
    if name in ("article", "main") or attributes.get("role", "") in ("main", "article"):
        return True
    if attributes.get("itemprop", "") == "articleBody":
        return True
    if name not in ("div", "section", "td") or not ("class" in attributes or "id" in attributes):
        return False
    words = _named(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    return any(w in CONTENT_WORDS for w in words)


class Page:
    """The lines of a page outside of what is left out, and the elements that hold them."""

    def __init__(self, html: str) -> None:
        self.lines: list[Line] = []
        self.around = [0]  # the content element around each content element
        self.boxes: list[Span] = [Span(0)]  # the page itself first; inner ones later
        self.inner: list[Span] = []  # boxes and lists within content elements
        self.judged: list[Span] = []  # elements with words against them
        self._stack: list[Element] = []
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._holders: list[int] = []
        self._blocks: list[int] = []
        self._cut: list[Span] = []  # too light for what their words say
        self._weight = 0  # of all lines but those
        self._line = Line()
        self._aside = self._links = self._code = 0
        self._apart = False
        for kind, name, more in tokens(html):
            if kind == "text":
                self._text(more)
            elif kind == "close":
                self._close(name)
            else:
                self._begin(name, more)
        self._pop_to(0)
        self.boxes[0].last = len(self.lines)
        self._forget(_covered(len(self.lines), self._cut))

    def _text(self, part: str) -> None:
        if not self._aside:
            part = unescape(part)
            self._line.pieces.append(part)
            if self._links:
                self._line.linked.append(part)

    def _flush(self) -> None:
        line = self._line
        if line.pieces:
            line.text = " ".join("".join(line.pieces).split())
            self._line = Line()
            if line.text:
                line.weight = max(0, len(line.text) - 2 * len(" ".join("".join(line.linked).split())))
                line.apart, self._apart = self._apart, False
                self.lines.append(line)
                self._weight += line.weight
        if self._stack:
            self._line.content, self._line.box = self._stack[-1].content, self._stack[-1].box
        else:
            self._line.content = self._line.box = 0

    def _pop_to(self, depth: int, flush: bool = True) -> None:
        if flush:
            self._flush()
        while len(self._stack) > depth:
            place, e = len(self._stack) - 1, self._stack.pop()
            for places in (self._holders, self._blocks):
                if places and places[-1] == place:
                    places.pop()
            if not e.ended:
                self._end(e)
            if e.span:
                e.span.last = len(self.lines)
            if self._weight - e.before < e.least:
                self._cut.append(Span(e.first, len(self.lines)))
                self._weight, self._apart = e.before, True
        if flush:
            self._flush()

    def _end(self, e: Element) -> None:
        e.ended = True
        self._open[e.name].pop()
        self._aside -= e.aside
        self._apart |= e.aside or e.opens
        self._links -= e.name == "a"
        self._code -= e.name in CODE

    def _forget(self, gone: list[bool]) -> None:
        place = [0, *accumulate(not g for g in gone)]
        self.lines = [x for x, g in zip(self.lines, gone) if not g]
        for span in {id(s): s for s in (*self.boxes, *self.inner, *self.judged)}.values():
            span.first, span.last = place[span.first], place[span.last]

    def _close(self, name: str) -> None:
        places = self._open.get(name)
        if name in BLOCK:
            if places:
                self._pop_to(places[-1])
            else:
                self._flush()
        elif places and not (self._blocks and self._blocks[-1] >= places[-1]):
            if places[-1] == len(self._stack) - 1:
                e = self._stack.pop()
                self._end(e)
            else:
                self._end(self._stack[places[-1]])
        if name in SPACED:
            self._text(" ")

    def _end_cell(self) -> None:
        """Cells of a row make one line, unless they hold blocks or are judged by themselves."""
        holder = self._holders[-1] if self._holders else -1
        place = max((self._open[n][-1] for n in CELLS if self._open.get(n)), default=-1)
        if place > holder:
            cell = self._stack[place]
            blocks = self._blocks[-1] > place if self._blocks else False
            self._pop_to(place, blocks or cell.opens or bool(cell.span and cell.span.words))

    def _begin(self, name: str, attributes: dict[str, str]) -> None:
        if name in RAW:
            return
        if name in SPACED:
            self._text(" ")
        if name in BLOCK:
            holder = self._holders[-1] if self._holders else -1
            ends = [o[-1] for n in ENDED.get(name, ENDED["p"]) if (o := self._open.get(n)) and o[-1] > holder]
            if ends:
                self._pop_to(min(ends))
            elif self._line.pieces:
                self._flush()
        if name in CELLS:
            self._end_cell()
        if name in VOID:
            return
        outer = self._stack[-1] if self._stack else Element("", False, 0, 0, 0, 0)
        nested = bool(self._open.get("article"))
        inside = nested or bool(self._open.get("main")) or outer.content > 0
        aside = _is_aside(name, attributes, nested, inside)
        e = Element(name, aside, outer.content, outer.box, len(self.lines), self._weight)
        words: frozenset[str] = frozenset()
        block = name in BLOCK or name in CELLS
        if not e.aside and not self._aside:
            if name in ("form", "fieldset") or "class" in attributes or "id" in attributes:
                e.least, words = _judge(name, attributes, inside, self._code > 0)
                e.least = e.least if block else 0
            content = not e.least and not words and _is_content(name, attributes)
            if name in CELLS and (words or content or e.least):
                self._flush()
                e.first, e.before = len(self.lines), self._weight
            if content:
                self.around.append(e.content)
                e.content, e.opens, self._apart = len(self.around) - 1, True, True
            if words and not block:
                e.aside = True
            elif words or name in BOXES or name in HOLDERS:
                span = Span(e.first, words=words)
                e.span = span
                if words:
                    self.judged.append(span)
                if name in BOXES:
                    self.boxes.append(span)
                    e.box = len(self.boxes) - 1
                if outer.content and not e.opens and (name in BOXES or name in HOLDERS):
                    self.inner.append(span)
        self._stack.append(e)
        place = len(self._stack) - 1
        self._open.setdefault(name, []).append(place)
        if name in HOLDERS:
            self._holders.append(place)
        if name in BLOCK:
            self._blocks.append(place)
        self._aside += e.aside
        self._links += name == "a"
        self._code += name in CODE
        if not self._line.pieces:
            self._line.content, self._line.box = e.content, e.box

    def widest(self) -> list[int]:
        """The outermost content element around each one; outer ones come first."""
        out: list[int] = []
        for n, outer in enumerate(self.around):
            out.append(out[outer] if outer else n)
        return out


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """First and last place of the stretches between a surge and a dive of the window sums."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    found, i = [], 0
    while i < len(sums):
        if sums[i] >= SURGE:
            start = i
            while start < len(weights) and not weights[start]:
                start += 1
            while i < len(sums) and sums[i]:
                i += 1
            found.append((start, i - 1))
        i += 1
    return found


def _covered(n: int, spans: Iterable[Span]) -> list[bool]:
    """Which of ``n`` lines lie in any of the spans."""
    turns = [0] * (n + 1)
    for span in spans:
        turns[span.first] += 1
        turns[span.last] -= 1
    return [depth > 0 for depth in accumulate(turns[:n])]


def _left_out(page: Page) -> list[Span]:
    """The elements that words leave out, but for words that say nothing on this page."""
    lines, said = page.lines, set()
    sums = [0, *accumulate(x.weight for x in lines)]
    while True:
        out = [s for s in page.judged if s.words - said]
        gone = _covered(len(lines), out)
        if any(x.content and not g for x, g in zip(lines, gone)):
            return out
        free = sum(x.weight for x, g in zip(lines, gone) if not g)
        heaviest = max(out, key=lambda s: sums[s.last] - sums[s.first], default=None)
        if heaviest is None:
            return out
        against, weight = heaviest.words - said, sums[heaviest.last] - sums[heaviest.first]
        if weight <= free or free and (weight < SURGE or any(map(_strong_word, against))):
            return out
        said |= against


def _menus(page: Page) -> list[Span]:
    """Boxes and lists in content elements that are mostly links, three lines or more of them."""
    weights = [0, *accumulate(x.weight for x in page.lines)]
    links = [0, *accumulate(not x.weight for x in page.lines)]
    return [
        s
        for s in page.inner
        if links[s.last] - links[s.first] >= WINDOW
        and 2 * (links[s.last] - links[s.first]) > s.last - s.first
        and weights[s.last] - weights[s.first] < SURGE
    ]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = Page(html or "")
    out = [*_left_out(page), *_menus(page)]
    gone = _covered(len(page.lines), out)
    apart = [x.apart for x in page.lines] + [False]
    for span in out:
        apart[span.last] = True
    # places of lines in the distribution, blank ones between
    weights: list[int] = []
    of_line: list[int] = []
    pending = False
    for i, x in enumerate(page.lines):
        pending |= apart[i]
        if gone[i]:
            continue
        last = page.lines[of_line[-1]] if of_line else None
        same = last is not None and (x.box, x.content) == (last.box, last.content)
        if pending and last is not None and not same:  # what is left out within a box parts no text
            weights += [0] * WINDOW
            of_line += [of_line[-1]] * WINDOW
        pending = False
        weights.append(x.weight)
        of_line.append(i)
    widest = page.widest()
    lines = page.lines
    found = stretches(weights)
    kept: set[int] = set()
    within: set[int] = set()
    if found:
        contents, plain, heavy = set(), [], []
        for a, b in found:
            inner = [(weights[i], -i) for i in range(a, b + 1)]
            content = lines[of_line[-max(inner)[1]]].content
            contents.add(widest[content])
            within |= {of_line[i] for i in range(a, b + 1)}
            if not content:
                plain += [of_line[i] for i in range(a, b + 1)]
                surging = [of_line[-i] for w, i in inner if w >= SURGE]
                heavy += surging or [of_line[-i] for w, i in inner if w]
        contents.discard(0)
        if heavy:
            box = _innermost(page.boxes, min(heavy), max(heavy))
            kept |= {i for i in plain if box.first <= i < box.last}
    else:
        most: dict[int, int] = {}
        for i, x in enumerate(lines):
            if x.content and not gone[i]:
                most[x.content] = most.get(x.content, 0) + len(x.text)
        contents = {widest[max(most, key=lambda c: (most[c], -c))]} if most else set()
        if not most:
            kept = {of_line[p] for p in range(len(weights)) if weights[p]}
    chosen = [i for i, x in enumerate(lines) if x.content and widest[x.content] in contents and not gone[i]]
    kept |= {i for i in chosen if lines[i].weight or i in within}
    return "\n".join(lines[i].text for i in sorted(kept or chosen))


def _innermost(boxes: list[Span], first: int, last: int) -> Span:
    """Of boxes, outer ones before inner ones, the last that holds both lines."""
    return [b for b in boxes if b.first <= first and last < b.last][-1]


def extract(html_column: str = "html") -> Column:
    """The main text of each page, as a column."""

    @F.pandas_udf("string")
    def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    return extracted(F.col(html_column))
