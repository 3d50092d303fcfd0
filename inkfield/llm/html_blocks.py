"""Text blocks of a web page in page order, each with the path of elements that it stands in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title|textarea|select|button|svg|iframe|object|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/)?(?P<tag>[a-z][a-z0-9-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-z][a-z0-9-]*)[^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements that do not end a block of text (fixed values: HTML's phrasing elements).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element ends where it was left open.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}


@dataclass
class Block:
    """``path`` has a tuple of names for each open element: its tag, then the words of its class, id and role."""

    path: tuple[tuple[str, ...], ...]
    text: str
    link_chars: int = 0


@dataclass
class _Open:
    path: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    in_link: int = 0
    link_chars: int = 0


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks that have text; scripts, styles, controls and the title are no text."""
    if not page:
        return []
    out: list[Block] = []
    state = _Open()
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(state.text)).split())
        if text:
            out.append(Block(tuple(state.path), text, state.link_chars))
        state.text, state.link_chars = [], 0

    def text(part: str) -> None:
        if part:
            state.text.append(part)
            if state.in_link:
                state.link_chars += len(part)

    for m in _MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                text(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                state.in_link = 0 if m["end"] or m["end2"] else 1
            continue
        flush()
        state.in_link = 0
        if m["end"] or m["end2"]:
            _close(state.path, tag)
            continue
        if state.path and state.path[-1][0] == "p":
            state.path.pop()
        for other in CLOSES.get(tag, ()):
            if state.path and state.path[-1][0] == other:
                state.path.pop()
        if tag not in VOID and not (m["rest"] or "").endswith("/"):
            state.path.append(_names(tag, m["rest"] or ""))
    text(page[at:])
    flush()
    return out


def _close(path: list[tuple[str, ...]], tag: str) -> None:
    for k in range(len(path) - 1, -1, -1):
        if path[k][0] == tag:
            del path[k:]
            return


_known_names: dict[tuple[str, str], tuple[str, ...]] = {}


def _names(tag: str, rest: str) -> tuple[str, ...]:
    if not rest.strip():
        return (tag,)
    known = _known_names.get((tag, rest))
    if known is None:
        names = [tag]
        for name, *values in _ATTRIBUTE.findall(rest):
            value = "".join(values).lower()
            if name.lower() in ("class", "id", "role"):
                names += _PARTS.findall(value)
            elif "hidden" in name.lower() and value != "false" or "display:none" in value.replace(" ", ""):
                names.append("hidden")
        known = tuple(dict.fromkeys(names))
        if len(_known_names) > 50_000:
            _known_names.clear()
        _known_names[tag, rest] = known
    return known
