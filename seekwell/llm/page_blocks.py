"""The blocks of text of a web page, and where each stands: in an article, in what surrounds it, or open to question."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

OPEN, ARTICLE, MAIN, AROUND = range(4)

# A comment, a declaration, or a tag; quoted values may hold a closing bracket.
MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z) | <[!?][^>]*(?:>|\Z)
    | </?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    | </?([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)  # a quote that is not closed""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORDS = re.compile(r"[a-z0-9]+")

# Elements without an end tag, elements whose content is no markup, elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
# Elements that hold no main text, wherever they stand.
SURROUNDINGS = frozenset(
    "head title script style template noscript iframe object svg canvas audio video map textarea select option button "
    "datalist form nav footer aside menu dialog search xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of a class or id that name surroundings.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar masthead footer share sharing social related recommended recommendations comment comments disqus reply replies "
    "respond pagination pager widget toolbar skip".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
# Elements whose class and id say what the page looks like, not what they hold.
WHOLE = frozenset(("html", "body", "main"))
# An element that is not closed ends where one of the same kind begins.
SAME_KIND = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    place: int  # OPEN, ARTICLE, MAIN or AROUND
    element: str
    text: str


class _Open(NamedTuple):
    name: str
    place: int
    headings: int | None = None  # in the header of an article: where headings stand


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag, the first of a name; names in lower case."""
    found: dict[str, str] = {}
    for name, double, single, bare, alone in ATTRIBUTE.findall(source):
        found.setdefault((name or alone).lower(), unescape(double or single or bare))
    return found


def opened(name: str, source: str, within: _Open) -> _Open:
    """An element inside `within`, with its attributes in `source`."""
    if within.place == AROUND:
        if within.headings is not None and name in HEADINGS:
            return _Open(name, within.headings)
        return _Open(name, AROUND, None if name in SURROUNDINGS else within.headings)
    if name in SURROUNDINGS:
        return _Open(name, AROUND)
    if name == "header":
        # the header of a page goes; of that of an article the headings are the article's
        return _Open(name, AROUND, None if within.place == OPEN else within.place)
    found = attributes(source) if source.strip("/ ") else {}
    role = found.get("role", "").lower()
    if found and name not in WHOLE:
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        if role in ROLES or hidden or "display:none" in found.get("style", "").replace(" ", "").lower():
            return _Open(name, AROUND)
        hints = set(WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
        if hints & (COMMENTS if name == "article" else HINTS):
            return _Open(name, AROUND)
    if name == "article" or found.get("itemprop", "").lower() == "articlebody":
        return _Open(name, ARTICLE)
    if within.place == OPEN and (name == "main" or role == "main"):
        return _Open(name, MAIN)
    return _Open(name, within.place)


def blocks(html: str) -> Iterator[Block]:
    """The blocks of a page in page order. White space inside a block is one space; a block without text is none.

    Markup that is not well formed is taken as browsers take it where that matters here: elements that are not closed end with what
    holds them, a comment or tag that is not closed reaches to the end, end tags without a beginning are nothing.
    """
    stack = [_Open("", OPEN)]
    parts: list[tuple[int, str]] = []

    def flush() -> Iterator[Block]:
        if parts:
            block = next((o for o in reversed(stack) if o.name in BLOCKS), stack[0])
            # a hidden or foreign piece inside a line is left out of its block
            text = "".join(t for place, t in parts if place != AROUND or block.place == AROUND)
            parts.clear()
            if text := " ".join(text.split()):
                yield Block(block.place, block.name, text)

    at, end = 0, len(html)
    while at < end:
        tag = MARKUP.search(html, at)
        text = html[at : tag.start() if tag else end]
        if text:
            parts.append((stack[-1].place, unescape(text) if "&" in text else text))
        if tag is None:
            break
        at = tag.end()
        name, source = (tag[1] or tag[3] or "").lower(), tag[2] or ""
        if not name:
            continue
        if name in BLOCKS:
            yield from flush()
        elif name == "br" or name in CELLS:
            parts.append((stack[-1].place, " "))
        if html[tag.start() + 1] == "/":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if name not in BLOCKS and name not in CELLS and stack[depth].name in BLOCKS:
                    break  # the end of a piece of a line ends nothing outside its block
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        elif name not in VOID:
            ends, keeps = SAME_KIND.get(name, ("p",) if name in BLOCKS else ()), KEEPS.get(name, ())
            for depth in range(len(stack) - 1, 0, -1) if ends else ():
                inner = stack[depth].name
                if inner in ends:
                    del stack[depth:]
                    break
                if inner in (keeps or BLOCKS):
                    break
            if not source.endswith("/") or name in BLOCKS:
                stack.append(opened(name, source, stack[-1]))
    yield from flush()
