"""HTML to a sequence of leaf blocks: their text, and the path of block elements above them."""

from __future__ import annotations

import html
import re

#: Fixed values of HTML: elements that break the text into blocks, and elements whose content is no text.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search
section summary table tbody td tfoot th thead tr ul""".split())
RAW_TAGS = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "noframes", "xmp")
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element of these is closed by the start of one of those.
CLOSED_BY = {"p": BLOCK_TAGS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}

#: A raw element's name ends at white space, ``/`` or ``>``; of these elements only svg may be closed in its own tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<svg(?=[\s/>])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    rf"|<(?P<raw>{'|'.join(RAW_TAGS)})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_BITS = re.compile(r"[a-z]+|[0-9]+")


class Block:
    __slots__ = ("text", "path", "link_chars")

    def __init__(self, text: str, path: tuple[str, ...], link_chars: int):
        self.text, self.path, self.link_chars = text, path, link_chars


def _names(attrs: str) -> list[str]:
    out: list[str] = []
    for m in NAMES.finditer(attrs):
        out += NAME_BITS.findall((m[1] or m[2] or m[3] or "").lower())
    return out


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order.

    Character references are decoded, white space runs become one space and the
    ends are trimmed.  Inline elements leave the text whole, ``br`` counts as
    white space.  Elements that are not closed end where HTML lets them, or with the page.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    parts: list[str] = []
    links, link_chars = 0, 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                # references may decode to halves of pairs, which no UTF-8 text can hold
                out.append(Block(text.encode("utf-8", "replace").decode(), path, link_chars))
        parts, link_chars = [], 0

    def add(text: str) -> None:
        nonlocal link_chars
        parts.append(text)
        if links:
            link_chars += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if m["end"] or m["end2"] else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS and tag != "head":
            continue
        flush()
        links = 0
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if tag in CLOSED_BY.get(name, ()):
                    del stack[k:]
                    break
                if name in SCOPES.get(tag, ()) or name not in CLOSED_BY and tag not in SCOPES:
                    break
            if tag not in VOID_TAGS:
                stack.append((tag, tuple([tag, *(f".{n}" for n in _names(m["attrs"] or m["attrs2"] or ""))])))
        path = tuple(n for _, names in stack for n in names)
    if at < len(page):
        add(page[at:])
    flush()
    return out
