"""A small HTML tree builder: tolerant, linear in the input, and without recursion."""

from __future__ import annotations

import html
import re

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the value closes an open element of the key (up to a barrier element).
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select", "datalist"}}
#: Start tags that close an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "select"}

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"  # doctype, processing instruction
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    """An element. ``children`` holds elements and text strings in page order."""

    __slots__ = ("tag", "attrs", "children", "parent", "index")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.index = -1

    def attributes(self) -> dict[str, str]:
        found = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.attrs):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order. Character references in texts are decoded."""
    root = Node("#root", "", None)
    nodes = [root]
    root.index = 0
    here, at = root, 0

    def add_text(text: str) -> None:
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add_text(page[at:])
            return root, nodes
        add_text(page[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if start:
            tag = start.lower()
            attrs = m.group(3)
            if here.tag == "p" and tag in _ENDS_P:
                here = here.parent
            elif tag in _ENDS_P:
                probe = here
                while probe.parent is not None and probe.tag not in BLOCK:
                    probe = probe.parent
                if probe.tag == "p":  # inline elements left open inside a paragraph end with it
                    here = probe.parent
            for open_tag, closers in _CLOSED_BY.items():
                if tag in closers:
                    probe, barrier = here, _BARRIER[open_tag]
                    while probe.parent is not None and probe.tag not in barrier and probe.tag != open_tag:
                        probe = probe.parent
                    if probe.tag == open_tag:
                        here = probe.parent
            node = Node(tag, attrs, here)
            node.index = len(nodes)
            nodes.append(node)
            here.children.append(node)
            if tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                content, at = (page[at:], len(page)) if stop is None else (page[at : stop.start()], stop.end())
                if content:
                    node.children.append(html.unescape(content) if tag in ("title", "textarea") else content)
            elif tag not in VOID:  # as in HTML, a slash before ">" ends nothing
                here = node
        elif end:
            tag = end.lower()
            probe = here
            while probe.parent is not None and probe.tag != tag:
                if tag not in BLOCK and probe.tag in BLOCK:  # an inline end tag does not close blocks
                    probe = root
                    break
                probe = probe.parent
            if probe.parent is not None:
                here = probe.parent
            elif tag == "br":
                here.children.append(" ")
