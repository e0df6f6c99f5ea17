"""HTML pages as sequences of leaf blocks with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas math datalist".split())
RAW = frozenset("script style noscript template iframe object svg canvas math textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: What an opening element closes if it is still open, and what such a search does not leave.
CLOSES = {
    "p": frozenset(["p"]),
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head", "title"]),
}
SCOPE = frozenset(
    "html body div article main section aside nav header footer ul ol dl table form blockquote figure td th".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol pre section table ul".split()
)

#: What may stand in a head; any other element, or text, ends a head that is still open.
HEAD = frozenset("html head title meta link base script style noscript template".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUOTED = re.compile(r"[^>\"']*+(?:(>)|\"[^\"]*+\"|'[^']*+')")
#: Attributes are first looked for within so many characters.
_NEAR = 4096
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """Text of one leaf block, white space as it stands, and what is above it."""

    text: str
    tags: tuple[str, ...]
    marks: tuple[str, ...]
    link_chars: int


def _marks(rest: str) -> tuple[str, ...]:
    """Words of the class, id and role."""
    if not rest or not rest.strip(" /"):
        return ()
    out: list[str] = []
    for match in _ATTRIBUTE.finditer(rest):
        value = match.group(2) or match.group(3) or match.group(4) or match.group(1)
        out.extend(_TOKEN.findall(_CAMEL.sub(" ", value).lower()))
    return tuple(dict.fromkeys(out))


class _Tags:
    """The tags of a page one after the other, in time that follows the page's length.

    A tag ends at the first ``>`` outside quotes. Where quotes are never closed, so
    that there is none, it ends at the first ``>`` whatever quotes there are.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        # Places outside quotes from which no ``>`` outside quotes can be reached.
        self.hopeless: set[int] = set()

    def _end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``."""
        page = self.page
        near = _REST.match(page, at, at + _NEAR)
        if near:
            return near.end()
        passed = []
        while at not in self.hopeless:
            passed.append(at)
            part = _QUOTED.match(page, at)
            if not part:
                break
            at = part.end()
            if part.group(1):
                return at
        self.hopeless.update(passed)
        return page.find(">", passed[0] if passed else at) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next piece of markup, with the sign of an end tag, its name and attributes."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                # Without a ``>`` only a comment can follow.
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            head = _NAME.match(page, start)
            if head:
                end = self._end(head.end())
                return start, end, head.group(1), head.group(2).lower(), page[head.end() : end - 1]
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", "", ""
            at = start + 1


def _end_tag(page: str, name: str, at: int) -> tuple[int, int]:
    """Where the content of a raw element ends, and its end tag; the page's end if there is none."""
    found = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
    close = page.find(">", found.end()) if found else -1
    return (found.start(), close + 1) if close >= 0 else (len(page), len(page))


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, the head and comments have none.

    Open elements that are never closed last until an outer one closes; a head lasts
    until something that can't stand in one. What an unknown element holds is read like
    a part of its surroundings.
    """
    if not page:
        return []
    blocks: list[Block] = []
    names: list[str] = []
    count: Counter[str] = Counter()
    marks: list[tuple[str, ...]] = []
    hidden = links = 0
    parts: list[str] = []
    link_chars = 0
    above: tuple[tuple[str, ...], tuple[str, ...]] | None = None

    def flush() -> None:
        nonlocal link_chars, above
        if parts:
            text = "".join(parts)
            if above and text.strip():
                blocks.append(Block(html.unescape(text), *above, link_chars))
            parts.clear()
        link_chars, above = 0, None

    def pop_to(place: int) -> None:
        nonlocal hidden, links
        for name in names[place:]:
            count[name] -= 1
            hidden -= name in HIDDEN
            links -= name == "a"
        del names[place:], marks[place:]

    def push(name: str, words: tuple[str, ...]) -> None:
        nonlocal hidden, links
        names.append(name)
        marks.append(words)
        count[name] += 1
        hidden += name in HIDDEN
        links += name == "a"

    def add(text: str) -> None:
        nonlocal link_chars, above
        if hidden and names[-1] == "head" and not text.isspace() and text:
            pop_to(len(names) - 1)
        if hidden or not text:
            return
        parts.append(text)
        if text.isspace():
            return
        if above is None:
            above = tuple(names), tuple(m for some in marks for m in some)
        if links:
            link_chars += len(text)

    tags = _Tags(page)
    at = 0
    while True:
        found = tags.next(at)
        if not found:
            # A tag that the page's end cuts off is markup too.
            tail = page[at:]
            cut = tail.rfind("<")
            if cut >= 0 and re.match(r"<[/!?a-zA-Z]", tail[cut:]) and ">" not in tail[cut:]:
                tail = tail[:cut]
            add(tail)
            break
        start, end, closing, name, rest = found
        add(page[at:start])
        at = end
        if not name:
            continue
        if count["head"] and not closing and name not in HEAD:
            pop_to(names.index("head"))
        if name not in INLINE:
            flush()
        elif name in ("br", "wbr", "img"):
            if name != "wbr":
                add(" ")
            continue
        if closing:
            place = len(names) - 1 if count[name] else -1
            while place >= 0 and names[place] != name:
                # An inline end tag does not reach out of its block.
                if name in INLINE and names[place] not in INLINE:
                    place = -1
                    break
                place -= 1
            if place >= 0:
                pop_to(place)
            continue
        if name in VOID:
            continue
        if name in RAW:
            content_end, at = _end_tag(page, name, at)
            if name == "textarea":
                push(name, _marks(rest))
                add(page[end:content_end])
                flush()
                pop_to(len(names) - 1)
            continue
        shut = CLOSES.get(name) or (frozenset(["p"]) if name in CLOSES_PARAGRAPH else None)
        if shut:
            place = len(names) - 1
            first = None
            while place >= 0 and (names[place] not in SCOPE or names[place] in shut):
                if names[place] in shut:
                    first = place
                place -= 1
            if first is not None:
                pop_to(first)
        if (rest or "").rstrip().endswith("/") and name not in INLINE:
            continue
        push(name, _marks(rest))
    flush()
    return blocks


def plain(text: str) -> str:
    """White space inside a block as single spaces, none at its ends."""
    return " ".join(text.split())
