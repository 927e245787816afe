"""Main-text extraction by composite text density of DOM nodes.

Every block of the page gets characters per tag, adjusted for the characters and tags that are links (inline
formatting is part of its block and no tag of its own). The block with the largest sum of its children's
densities is the core of the page, and the least density of text blocks on its path to the body is what blocks
outside an article or main element must reach to be content too; within it, or where a page has none, neighbours of
that path are content unless they are mostly links. Elements that by their tag, role or class are no article text
(menus, forms, notices, comments) are left out first, and so are blocks of links before and outside the text.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code
from .dom import BLOCK, Node, parse

#: Elements that never hold article text.
_NEVER = frozenset(
    "head script style noscript template nav aside footer form button input select textarea iframe object embed svg math canvas"
    " audio video map dialog menu title".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of class and id names of what surrounds an article.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial adsense adslot sponsor sponsored promo promos"
    " promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars rail aside footer"
    " masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup popover modal overlay lightbox newsletter subscribe"
    " subscription signup login signin register share sharing social related recommended recommendation recommendations teaser"
    " teasers comment comments commentlist disqus discussion respond reply replies pagination pager skip widget widgets copyright"
    " disclaimer tagcloud paywall".split()
)
#: Words that say nothing about what a name stands for: a name of noise words and these is noise.
_NEUTRAL = frozenset(
    "site global main primary secondary left right top bottom upper lower center middle side box block area list wrapper wrap container"
    " inner outer bar panel slot unit item items section group row col column grid layout links link posts stories thread form text"
    " user reader bottom sticky fixed mobile desktop small large big new more js c m s".split()
)
#: Names of the header of a site; other headers are those of articles and sections.
_HEADERS = frozenset("header site-header page-top global-header main-header top-header header-top header-main".split())
_SPLIT = re.compile(r"[-_:\d]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text.
_TEXTS = _HEADINGS | frozenset("p li dd dt td th blockquote figcaption a abbr b cite code em i mark q small span strong u".split())
#: Noise words of what readers write.
_COMMENTS = frozenset("comment comments commentlist disqus discussion respond reply replies".split())
#: Elements that class names do not make noise.
_FRAMES = frozenset("html body article main".split())


def _named_noise(names: str) -> bool:
    """Whether a class or id name, as a whole, is that of noise: ``cookie-notice`` is, ``with-sidebar`` is not."""
    for name in names.split():
        parts = [w.lower() for w in _SPLIT.split(name) if w]
        if "-".join(parts) in _HEADERS:
            return True
        if any(w in _NOISE for w in parts) and all(w in _NOISE or w in _NEUTRAL for w in parts) and parts[-1:] != ["text"]:
            return True
    return False


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up is not None and up.tag not in tags:
        up = up.parent
    return up is not None


def _is_noise(node: Node) -> bool:
    """By tag, role or state, whatever it holds."""
    if node.tag == "button" and node.parent.tag in _TEXTS and any(isinstance(c, str) and c.strip() for c in node.parent.children):
        return False  # a word of a sentence
    if node.tag in _NEVER:
        return True
    if node.tag == "header" and not _inside(node, ("article", "main")):  # a page's header, not the heading of an article
        up = node.parent
        if up is None or up.tag in ("html", "body", "#root") or any(isinstance(c, Node) and c.tag in ("main", "nav", "article", "aside") for c in up.children):
            return True
    if not node.attrs:
        return False
    attrs = node.attributes()
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES:
        return True
    return "style" in attrs and bool(_HIDDEN_STYLE.search(attrs["style"]))


def _is_named_noise(node: Node) -> bool:
    if not node.attrs or node.tag in _FRAMES:
        return False
    attrs = node.attributes()
    return _named_noise(f"{attrs.get('class', '')} {attrs.get('id', '')}")


def _is_comments(node: Node) -> bool:
    attrs = node.attributes()
    return any(w.lower() in _COMMENTS for w in _SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".replace(" ", "-")))


def _kept(nodes: list[Node]) -> list[bool]:
    """Which elements may be content. A class name takes nothing away that holds the page's main element or its
    only first-level heading, or that leaves less than a tenth of the text; comments go if any text is left."""
    n = len(nodes)
    kept = [True] * n
    for node in nodes[1:]:
        kept[node.index] = kept[node.parent.index] and not _is_noise(node)
    named = [node for node in nodes[1:] if kept[node.index] and _is_named_noise(node)]
    if not named:
        return kept
    chars, firsts, mains = [0] * n, [0] * n, [0] * n
    for node in reversed(nodes):
        i = node.index
        if kept[i]:
            chars[i] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            firsts[i] += node.tag == "h1"
            mains[i] += node.tag == "main"
            if node.parent is not None:
                up = node.parent.index
                chars[up] += chars[i]
                firsts[up] += firsts[i]
                mains[up] += mains[i]
    left = chars[0]
    names = {node.index for node in named}
    for node in nodes[1:]:  # parents come before their children
        i = node.index
        if not kept[i] or not kept[node.parent.index]:
            kept[i] = False
        elif i in names and not mains[i] and not (firsts[i] and firsts[i] == firsts[0]) and ((left - chars[i]) * 10 >= chars[0] or (left > chars[i] and _is_comments(node))):
            kept[i] = False
            left -= chars[i]
    return kept


def _measure(nodes: list[Node], kept: list[bool]) -> tuple[list[float], list[float], list[float]]:
    """Of each node its composite density, the sum of its children's densities, and the share of its characters
    that are links. Inline elements have no density: they count as text of their block."""
    n = len(nodes)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node in reversed(nodes):  # children come after their parents
        i = node.index
        if not kept[i]:
            continue
        chars[i] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            link_chars[i] = chars[i]
            link_tags[i] += 1
        if node.parent is not None:
            up = node.parent.index
            chars[up] += chars[i]
            tags[up] += tags[i] + (node.tag in BLOCK or node.tag == "a")
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
    body_ratio = link_chars[0] / chars[0] if chars[0] else 0.0
    density, sums, links = [0.0] * n, [0.0] * n, [0.0] * n
    for node in nodes:
        i = node.index
        if not kept[i] or not chars[i]:
            continue
        links[i] = link_chars[i] / chars[i]
        if node.tag in BLOCK or node.parent is None:
            density[i] = composite(chars[i], tags[i], link_chars[i], link_tags[i], body_ratio)
    for node in nodes[1:]:
        if density[node.index]:
            up = node.parent
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            sums[up.index] += density[node.index]
    return density, sums, links


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag times the logarithm of the same without links, to a base that grows with the links."""
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    gain = math.log(chars / lc * t / lt)
    return chars / t * max(gain / math.log(base + 1e-9), 0.0) if base > 1 else chars / t * math.log(chars / lc * t / lt + 1)


#: Blocks of links: this share of their characters, in at least so many links. Blocks that are mostly links.
_LINKED_SHARE, _LINKED_TAGS, _MOSTLY = 0.7, 2, 0.5
_TOPS = frozenset(["html", "#root"])
_NOTICE = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


def _core(nodes: list[Node], kept: list[bool], density: list[float], sums: list[float]) -> Node:
    blocks = [x for x in nodes if kept[x.index] and (x.tag in BLOCK or x.parent is None)]
    frames = {x.index for x in nodes if x.tag in ("article", "main")}
    # of equal sums the denser block, then one that says what it is, then the first
    core = max(blocks, key=lambda x: (sums[x.index], density[x.index], x.index in frames, -x.index))
    if sums[core.index] == 0:
        core = max(blocks, key=lambda x: (density[x.index], x.index in frames, -x.index))
    return core


def _first_text(node: Node) -> str:
    stack: list = [node]
    while stack:
        item = stack.pop()
        if not isinstance(item, str):
            stack += reversed(item.children)
        elif item.strip():
            return item
    return ""


def _content(nodes: list[Node], kept: list[bool]) -> tuple[Node, set[int], set[int]]:
    """The core, indices of the subtrees that are content, and of elements whose own text is content besides."""
    density, sums, links = _measure(nodes, kept)
    if not any(density[1:]):
        return nodes[0], {0}, set()  # only text at the top
    core = _core(nodes, kept, density, sums)
    path = [core]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    texts = [x for x in path if x.tag in BLOCK and any(isinstance(c, Node) and kept[c.index] and c.tag in _TEXTS or isinstance(c, str) and c.strip() for c in x.children)]
    threshold = min((density[x.index] for x in texts), default=0.0)
    frame = max((k for k, x in enumerate(path) if x.tag in ("article", "main")), default=len(path))
    roots, loose = {core.index}, set()
    for k, above in enumerate(path[1:], 1):
        within = k <= frame
        if above.tag in _TOPS and any(isinstance(x, Node) and x.tag == "body" for x in above.children):
            break
        for other in above.children:
            if isinstance(other, str):
                if within and other.strip():
                    loose.add(above.index)
            elif other is not path[k - 1] and kept[other.index]:
                i = other.index
                plain = (within or other.tag in ("article", "main") or density[i] >= threshold > 0) and links[i] < _MOSTLY and not _NOTICE.match(_first_text(other))
                if other.tag in _HEADINGS or plain:
                    roots.add(i)
    return core, roots, loose


def _roots(nodes: list[Node], kept: list[bool]) -> set[int]:
    """Indices of the subtrees that are content."""
    return _content(nodes, kept)[1]


def _without_link_blocks(nodes: list[Node], kept: list[bool], core: Node) -> None:
    """Leave out lists, sections and other containers that consist of links, with the headings inside them: those
    outside the core, those in it that no text precedes, and those at the end of a body. In an article or main
    element, and among the text of any core, they are part of the text."""
    n = len(nodes)
    link_tags, chars, link_chars = [0] * n, [0] * n, [0] * n
    for node in reversed(nodes):
        i = node.index
        if kept[i]:
            chars[i] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) if node.tag not in _HEADINGS else 0
            if node.tag == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            if node.parent is not None and node.tag not in _HEADINGS:
                up = node.parent.index
                chars[up] += chars[i]
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i]
    if link_chars[0] >= _LINKED_SHARE * chars[0]:
        return  # the page is one of links
    linked = {
        x.index for x in nodes[1:] if kept[x.index] and x is not core and x.tag in ("ul", "ol", "menu", "section", "div", "dl")
        and link_tags[x.index] >= _LINKED_TAGS and link_chars[x.index] >= _LINKED_SHARE * chars[x.index]
    }
    if not linked:
        return
    # in page order: the text of the core before each of its blocks of links
    before: dict[int, int] = {}
    plain, stack = 0, [(c, False) for c in reversed(core.children)]
    while stack:
        item, quiet = stack.pop()
        if isinstance(item, str):
            plain += 0 if quiet else len(item.strip())
        elif kept[item.index]:
            if item.index in linked:
                before[item.index] = plain
            quiet = quiet or item.index in linked or item.tag in _HEADINGS or item.tag == "a"
            stack += [(c, quiet) for c in reversed(item.children)]
    for node in nodes[1:]:
        i = node.index
        if i in linked and kept[i]:
            if i not in before:
                kept[i] = False
            elif core.tag not in ("article", "main"):
                siblings = [c for c in node.parent.children if isinstance(c, Node) and kept[c.index]]
                at = siblings.index(node)
                headed = at > 0 and siblings[at - 1].tag in _HEADINGS
                kept[i] = before[i] > 0 and (before[i] < plain or headed or core.tag not in ("body", "#root") or node.parent is not core)
        kept[i] = kept[i] and kept[node.parent.index]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by line feeds."""
    if not page:
        return ""
    root, nodes = parse(page)
    kept = _kept(nodes)
    core, roots, loose = _content(nodes, kept)
    _without_link_blocks(nodes, kept, core)
    blocks: list[str] = []
    inline: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            blocks.append(text)

    stack: list = [(root, root.index in roots, False)]
    while stack:
        item, inside, leaving = stack.pop()
        if isinstance(item, str):
            inline.append(item)
            continue
        if leaving:
            end_block()
            continue
        if not kept[item.index]:
            continue
        if item.tag == "br":
            inline.append(" ")
            continue
        is_block = item.tag in BLOCK
        if is_block:
            end_block()
            stack.append((item, inside, True))
        for child in reversed(item.children):
            if isinstance(child, str):
                if inside or item.index in loose:
                    stack.append((child, True, False))
            else:
                stack.append((child, inside or child.index in roots, False))
    end_block()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Null or empty pages, and pages without content, give empty text; a page of any length is read whole. Of
    blocks with equal sums the denser, then an article or main element, then the first is the core. Null ids
    and urls stay null. Pages are independent: repeated rows give repeated results, an empty table none, and
    other columns, whatever their names, are not looked at.
    """
    ship_code(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
