"""HTML as a flat list of DOM nodes, for extraction and for WARC derivatives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

COMMENT = r"<!--.*?(?:-->|\Z)"
QUOTED = r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
PLAIN = r"<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>"
OTHER = r"<[!?/][^>]*>"
TOKEN = re.compile("|".join((COMMENT, QUOTED, PLAIN, OTHER)), re.S)
#: Where quotes don't close, each tag would be read to the page's end in vain: after so many of them quotes are plain.
TOKEN_WITHOUT_QUOTES = re.compile("|".join((COMMENT, QUOTED.replace("""|\\"[^\\"]*\\"|'[^']*')""", "|[\"'])"), PLAIN, OTHER)), re.S)
UNCLOSED_QUOTES = 8
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noframes noembed template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption button object body html".split())


@dataclass
class Page:
    """Node 0 is the root; a node comes after its parent. Text nodes have no tag."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    attributes: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    block: list[int] = field(default_factory=lambda: [0])
    title: str = ""

    def add(self, parent: int, tag: str, attributes: str, text: str, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1


def parse(html: str) -> Page:
    """Any text is a page: what doesn't read as markup is text; open elements end with the page.

    Time is linear in the page: of each name it is known where its open elements are on the stack.
    """
    page, stack, at, block, size = Page(), [0], 0, 0, len(html)
    last = html.rfind(">") + 1  # no tag ends behind it
    token, unclosed = TOKEN, 0
    opened: dict[str, list[int]] = {}  # by name, the places on the stack
    scopes: list[int] = []

    def close(index: int) -> None:
        nonlocal block
        while len(stack) > index:
            name = page.tag[stack.pop()]
            block += name in BLOCK
            opened[name].pop()
            if name in SCOPE:
                scopes.pop()

    def highest(names: frozenset[str] | set[str]) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    while at < size:
        found = token.search(html, at, last) if at < last else None
        if found:
            start, end = found.span()
            if end == last and html.startswith("<!--", start) and html[max(end - 3, start + 4) : end] != "-->":
                end = size  # a comment that isn't closed
        else:
            start = html.find("<!--", max(at, last))
            start, end = (start if start >= 0 else size), size
        if start > at:
            page.add(stack[-1], "", "", unescape(html[at:start]), block)
        if not found:
            break
        at = end
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["name2"]:
            unclosed += 1
            token = TOKEN_WITHOUT_QUOTES if unclosed >= UNCLOSED_QUOTES else TOKEN
        if found["end"] or found["end2"]:
            place = highest({name})
            if not place:
                block += name in BLOCK
            elif name in SCOPE or name in BLOCK or not scopes or scopes[-1] < place:
                close(place)
            continue
        attributes = found["attributes"] or found["attributes2"] or ""
        if name == "html":
            page.attributes[0] += attributes
            continue
        if name in RAW:
            if name == "iframe":  # its content is raw, its target a link
                page.add(stack[-1], name, attributes, "", block)
            ending = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
            closed = html.find(">", ending.end()) + 1 if ending else 0
            if name == "title" and not page.title:
                page.title = " ".join(unescape(html[at : ending.start() if closed else size]).split())
            at = closed or size
            continue
        closes, until = CLOSES.get(name, (frozenset(), frozenset()))
        if name in BLOCK and name not in ("option", "body"):
            closes, until = closes | {"p"}, until | SCOPE
        while closes and (place := highest(closes)) and highest(until) <= place:
            own = page.tag[stack[place]]
            close(place)
            if name in CLOSES and own != "p":
                break
        block += name in BLOCK
        if name == "br":
            page.add(stack[-1], "", "", " ", block)
            continue
        node = page.add(stack[-1], name, attributes, "", block)
        if name not in VOID and not attributes.endswith("/"):
            opened.setdefault(name, []).append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
            stack.append(node)
        elif name == "hr":
            block += 1
    return page


def attributes(raw: str) -> dict[str, str]:
    """The first of each name, in lower case."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def joined(page: Page, nodes: list[int]) -> str:
    """The text of some text nodes: white space within a block is one space, blocks are two line feeds apart."""
    blocks: list[list[str]] = []
    last = None
    for node in nodes:
        if page.block[node] != last:
            blocks.append([])
            last = page.block[node]
        blocks[-1].append(page.text[node])
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)
