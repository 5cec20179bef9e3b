"""Text blocks of an HTML page, with what surrounds each of them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?(?=[a-zA-Z])[^>]*$",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML's own element kinds.
RAW = {"script", "style", "template", "iframe", "textarea", "title", "svg", "select", "noembed", "annotation", "annotation-xml"}
# Without an end these take the rest of the page; of all others only the tag is lost.
ENDLESS = {"script", "style", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol",
    "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp",
}
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Elements and words of class, id and role that say what a part of a page is for.
AWAY = {
    "nav": "menu", "navbar": "menu", "navigation": "menu", "menu": "menu", "breadcrumb": "menu", "breadcrumbs": "menu",
    "toolbar": "menu", "pagination": "menu", "pager": "menu", "skip": "menu", "toc": "menu",
    "footer": "footer", "contentinfo": "footer", "copyright": "footer", "colophon": "footer",
    "aside": "side", "sidebar": "side", "complementary": "side", "widget": "side", "related": "side",
    "recommended": "side", "trending": "side",
    "ad": "advert", "ads": "advert", "adv": "advert", "advert": "advert", "adverts": "advert", "advertisement": "advert",
    "advertising": "advert", "adsense": "advert", "adslot": "advert", "sponsor": "advert", "sponsored": "advert", "promo": "advert",
    "promotion": "advert", "banner": "notice", "cookie": "notice", "cookies": "notice", "consent": "notice",
    "gdpr": "notice", "notice": "notice", "notices": "notice", "alert": "notice", "popup": "notice", "modal": "notice", "dialog": "notice",
    "overlay": "notice", "disclaimer": "notice",
    "form": "form", "newsletter": "form", "subscribe": "form", "signup": "form", "login": "form", "search": "form",
    "fieldset": "form", "button": "form", "label": "form", "legend": "form",
    "comment": "comment", "comments": "comment", "reply": "comment", "replies": "comment", "disqus": "comment",
    "respond": "comment", "discussion": "comment", "share": "share", "sharing": "share", "social": "share",
    "hidden": "hidden",
}
HEADS = {"header", "masthead", "head", "topbar"}
HERE = {"article", "main", "content", "post", "entry", "story", "articlebody", "maincontent"}
# Articles in these are comments, or not shown.
STAYS = {"comment", "hidden"}
# What follows these says how a page is laid out or what an article is about: has-sidebar, no-ads, tag-login.
ABOUT = {"no", "not", "non", "has", "with", "without", "hide", "tag", "category"}
# These are never a whole page's wrapper.
PARTS = {"nav", "footer", "aside", "dialog", "button", "label", "legend", "menu"}


class Block(NamedTuple):
    """A block's text, the characters of it in links, its own tag, path of elements, and marks."""

    text: str
    linked: int
    tag: str
    path: tuple[int, ...]
    marks: frozenset[str]


class _Meaning(NamedTuple):
    """What an element is for: ``away`` kinds, ``head``, ``here``, and whether ``here`` is beyond doubt."""

    number: int
    tag: str
    away: frozenset[str]
    head: bool
    here: bool
    sure: bool


class _Open(NamedTuple):
    tag: str
    number: int
    meanings: tuple[_Meaning, ...]


def _named(value: str) -> set[str]:
    """Words of a class, id or role, but not those that only tell of the layout or the topic."""
    found = set()
    for token in value.split():
        words = [word.lower() for word in _WORDS.findall(token)]
        found.update(word for before, word in zip(["", *words], words) if before not in ABOUT)
        found.add(re.sub(r"[^a-z]", "", token.lower()))
    return found


def _meaning(tag: str, number: int, attributes: str) -> _Meaning | None:
    if tag in ("body", "html", "meta"):
        return None
    names = {tag}
    sure = tag in ("article", "main")
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            name = name.lower()
            if name in ("class", "id", "role", "itemprop"):
                found = _named(value)
                names |= found
                sure |= name == "role" and not found.isdisjoint(("main", "article")) or "articlebody" in found
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                names.add("hidden")
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                names.add("hidden")
    away = frozenset(AWAY[name] for name in names & AWAY.keys())
    head, here = bool(names & HEADS), bool(names & HERE)
    # An element cannot be the page's main part and also something beside it.
    if tag == "main":
        away = away & {"hidden"}
    if away or head or here:
        return _Meaning(number, tag, away, head, here, sure and not away)
    return None


def _marks(meanings: tuple[_Meaning, ...], wrappers: set[int]) -> frozenset[str]:
    """The nearest element with a meaning decides; an article's own parts can lead away from it again."""
    marks: set[str] = set()
    for meaning in meanings:
        if meaning.sure and not marks & STAYS:
            marks = {"here"}
            continue
        # An article's own head belongs to it.
        if meaning.head and "here" not in marks:
            marks.add("head")
        if meaning.number not in wrappers:
            marks |= meaning.away
        if meaning.here:
            marks.add("here")
    return frozenset(marks)


def _wrappers(found: list[tuple[str, tuple[_Meaning, ...]]]) -> set[int]:
    """Elements whose names would lead away, but that hold the page itself.

    Such an element holds half of the text and all that is marked as the article, or, where
    nothing is, nine tenths of the text.
    """
    total = heres = 0
    inside: dict[int, list] = {}
    for text, meanings in found:
        total += len(text)
        here_at = max((k for k, meaning in enumerate(meanings) if meaning.here), default=-1)
        heres += here_at >= 0
        for k, meaning in enumerate(meanings):
            if meaning.away and meaning.tag not in PARTS and not meaning.away & STAYS:
                sums = inside.setdefault(meaning.number, [0, 0])
                sums[0] += len(text)
                sums[1] += here_at >= k
    return {
        number for number, (size, here) in inside.items()
        if here == heres and size >= (0.5 if heres else 0.9) * total
    }


def page_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Broken markup never fails; the unreadable is text."""
    blocks: list[Block] = []
    meant: list[tuple[_Meaning, ...]] = []
    stack: list[_Open] = [_Open("", 0, ())]
    endless: set[str] = set()
    pieces: list[str] = []
    linked = links = numbered = 0

    def finish() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                # The innermost element that makes a block is the block's own.
                depth = len(stack) - 1
                while depth and stack[depth].tag not in BLOCK:
                    depth -= 1
                own = stack[depth]
                blocks.append(Block(text, min(linked, len(text)), own.tag, tuple(e.number for e in stack[: depth + 1]), frozenset()))
                meant.append(stack[-1].meanings)
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text.strip())

    place, size = 0, len(page)
    while place < size:
        match = _TAG.search(page, place)
        if match is None:
            add(page[place:])
            break
        if match.start() > place:
            add(page[place : match.start()])
        place = match.end()
        name = match.group(2) or match.group(5)
        if name is None:
            continue
        tag, closing = name.lower(), bool(match.group(1) or match.group(4))
        attributes = match.group(3) or match.group(6) or ""
        if closing:
            if tag in BLOCK:
                finish()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    links -= sum(1 for e in stack[depth:] if e.tag == "a")
                    del stack[depth:]
                    break
            continue
        if tag in RAW or tag == "xmp":
            end = None
            if not attributes.endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}(?![-\w])[^>]*(?:>|$)", re.I).search(page, place)
                if end is None:
                    # Nothing further on ends it either.
                    endless.add(tag)
                    place = size if tag in ENDLESS else place
            if tag == "xmp":
                finish()
                if end:
                    add(html.escape(page[place : end.start()]))
                    finish()
            place = end.end() if end else place
            continue
        if tag in BLOCK:
            finish()
            closed = CLOSES_ITSELF.get(tag, frozenset()) | ({"p"} if tag != "p" else frozenset())
            for depth in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                if stack[depth].tag in closed:
                    links -= sum(1 for e in stack[depth:] if e.tag == "a")
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            continue
        numbered += 1
        if not (attributes.endswith("/") and tag not in BLOCK):
            meaning = _meaning(tag, numbered, attributes)
            outer = stack[-1].meanings
            stack.append(_Open(tag, numbered, (*outer, meaning) if meaning else outer))
            links += tag == "a"
    finish()
    wrappers = _wrappers([(block.text, meanings) for block, meanings in zip(blocks, meant)])
    known: dict[tuple[_Meaning, ...], frozenset[str]] = {}
    for meanings in meant:
        if meanings not in known:
            known[meanings] = _marks(meanings, wrappers)
    return [block._replace(marks=known[meanings]) for block, meanings in zip(blocks, meant)]
