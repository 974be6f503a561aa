"""Main text of web pages by ratios of text to tag paths."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr br".split()
)
RAW = {"script", "style", "textarea", "title", "noframes", "xmp", "iframe", "noembed"}
# Elements that never hold main text.
NOISE = set(
    "head script style noscript template nav header footer aside form button select textarea iframe svg canvas"
    " object audio video menu dialog title noframes noembed map".split()
)
# Words in a class, id or role, compounds included, that always mark such elements.
SURE_WORDS = set(
    "comment comments commentlist commenters disqus reply replies respond"
    " cookie cookies consent gdpr ad ads adv advert adverts advertisement advertisements advertising adsbygoogle"
    " sponsor sponsors sponsored promo promos promoted promotion nav navbar navs navigation menu menus breadcrumb"
    " breadcrumbs toolbar pagination share shares sharing sidebar sidenav newsletter subscribe signup popup modal".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies".split())
# Words that mark them unless the structure says otherwise.
OPEN_WORDS = set(
    "header masthead banner footer contentinfo notice notices notification notifications alert alerts search"
    " related recommended widget widgets social complementary trending".split()
)
# A header or footer of a section is not one of the page.
OWN_HEADERS = {"header", "footer"}
PAGE_WORDS = set("site page global main top bottom header footer masthead".split())
# Compounds with these words tell of a state or of what is elsewhere: has-sidebar, comments-open.
STATE_WORDS = set(
    "has have with without no non not is js hide show open opened closed enabled disabled on off free layout fixed"
    " sticky count counter ready loaded visible supported allowed".split()
)
# Share of linked text, and number of links, from which a part without content paths is a menu.
MENU_LINKED, MENU_LINKS = 0.6, 3
# Elements that can be a main part.
CONTAINERS = set("html body div main article section table tbody tr td center".split())
# An open element of the first kind ends when one of the second kind begins.
CLOSED_BY = {
    "p": set(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
        " header hr main menu nav ol p pre section table ul li dd dt td th tr".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
    **{f"h{i}": {f"h{j}" for j in range(1, 7)} | {"p", "div", "article", "section"} for i in range(1, 7)},
}
# What a main part ends if it was left open.
LEFT_OPEN = {"nav", "header", "footer", "aside", "form", "menu"}
SMOOTHING = np.exp(-0.5 * np.arange(-2, 3) ** 2)
# A node is content if its fused ratio is at least this share of the standard deviation.
THRESHOLD = 0.3

_NAME = r"[a-zA-Z][^\s/<>\"']*"
# A tag without odd quotes, and the beginning of any other.
_TAG = re.compile(rf"<(/?)({_NAME})((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_TAG_START = re.compile(rf"<(/?)({_NAME})")
_STOP = re.compile(r"[\"'>]")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass
class Element:
    name: str
    parent: Element | None
    path: int
    noise: bool
    kind: str = ""
    mass: float = 0.0
    chars: int = 0
    linked: int = 0
    links: int = 0
    best: bool = False
    inside: bool = False
    sure: bool = False
    wanted: int = 0


@dataclass
class Node:
    """A run of text between two block tags."""

    element: Element
    text: str
    linked: int
    links: int


def kind_of(marks: list[str]) -> str:
    """What the values of class, id and role say: sure, comment, open, related or nothing."""
    found = ""
    for value in marks:
        for compound in value.split():
            words = {w.lower() for w in _WORD.findall(compound)}
            if not words or (len(words) > 1 and words & STATE_WORDS):
                continue
            if words & SURE_WORDS:
                return "comment" if words & COMMENT_WORDS else "sure"
            opened = words & OPEN_WORDS
            if opened <= OWN_HEADERS and not words <= PAGE_WORDS:
                continue
            if opened:
                found = "related" if opened <= {"related"} and found in ("", "related") else "open"
    return found


class Scanner:
    """Finds where tags end, in time that grows with the page however odd its quotes are."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "<>\"'"}
        self.failed: set[int] = set()

    def end_of_tag(self, start: int) -> int:
        """The position of the ``>`` that ends the tag, outside of quotes where they have an end."""
        html, at, seen = self.html, start, []
        while at <= max(self.last[">"], self.last["\""], self.last["'"]):
            stop = _STOP.search(html, at)
            if not stop:
                break
            place = stop.start()
            if html[place] == ">":
                return place
            # From a quote that did not lead to an end before it will not now.
            if place in self.failed or place >= self.last[html[place]]:
                break
            seen.append(place)
            at = html.find(html[place], place + 1) + 1
        self.failed.update(seen)
        return html.find(">", start)


def parse(html: str) -> tuple[list[Element], list[Node]]:
    """The block elements, root first, and the text nodes, both in page order; noise included.

    ``noise`` is that of tags only; what names say stands in ``kind``. An element's path
    is the number of its chain of tags with class, id and role. Tags inside a text run do
    not end it. Unknown and unclosed tags are accepted; what looks like a tag but has no
    end is text.
    """
    root = Element("", None, 0, False)
    elements = [root]
    paths: dict[tuple[int, str, str], int] = {}
    kinds: dict[str, str] = {}
    opened: dict[str, int] = defaultdict(int)
    here, depth = root, 0
    nodes: list[Node] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal parts, linked, links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                nodes.append(Node(here, text, min(linked, len(text)), links))
            parts, linked = [], 0
        links = 0

    def close(last: Callable[[Element], bool]) -> None:
        """Close open elements up to the one that ``last`` names."""
        nonlocal here
        done = False
        while not done:
            done = last(here)
            opened[here.name] -= 1
            here = here.parent

    scanner = Scanner(html)
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at) if at <= scanner.last["<"] else -1
        done = start < 0 or start > scanner.last[">"]
        if done:  # text, up to a comment that is left open
            comment = html.find("<!--", at)
            start = comment if comment >= 0 else size
        if start > at:
            parts.append(html[at:start])
            linked += (start - at) * (depth > 0)
        if done:
            break
        tag = _TAG.match(html, start)
        if tag:
            closing, name, inner, at = tag[1], tag[2].lower(), tag[3], tag.end()
        elif tag := _TAG_START.match(html, start):
            closing, name, end = tag[1], tag[2].lower(), scanner.end_of_tag(tag.end())
            inner, at = html[tag.end() : end], end + 1
        else:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            elif html.startswith(("<!", "<?"), start):
                at = html.find(">", start) + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        if name in INLINE:
            if name == "a":
                depth = max(0, depth + (-1 if closing else 1))
                links += not closing
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        depth = 0
        if closing:
            if opened[name]:
                close(lambda e: e.name == name)
            continue
        while here.parent and name in CLOSED_BY.get(here.name, ()):
            close(lambda e: True)
        if name in ("article", "main") and any(opened[n] for n in LEFT_OPEN):
            close(lambda e: e.name in LEFT_OPEN)
        if name in VOID:
            continue
        marks = " ".join(a or b or c for a, b, c in _MARKS.findall(inner)) if inner else ""
        noise = name not in ("html", "body") and (here.noise or name in NOISE)
        if marks not in kinds:
            kinds[marks] = kind_of([marks])
        path = paths.setdefault((here.path, name, marks.lower()), len(paths) + 1)
        here = Element(name, here, path, noise, "" if name in ("html", "body", "main") else kinds[marks])
        elements.append(here)
        opened[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            close(lambda e: True)
    flush()
    return elements, nodes


def fused_ratios(nodes: list[Node]) -> np.ndarray:
    """For each node the ratio of its tag path, fused with its neighbourhood.

    A path's ratio is its text length over its number of nodes, times the same for
    punctuation, times its share of text outside links. Ratios are smoothed over
    the nodes in page order, and a node gets the geometric mean of both.
    """
    paths = {}
    of = np.array([paths.setdefault(n.element.path, len(paths)) for n in nodes])
    count = np.bincount(of)
    chars = np.array([len(n.text) for n in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(n.text)) for n in nodes], float)
    outside = np.array([max(0, len(n.text) - n.linked) for n in nodes], float)
    text = np.bincount(of, chars)
    ratio = text / count * np.sqrt(1 + np.bincount(of, marks) / count) * np.bincount(of, outside) / text
    by_node = ratio[of] * np.array([not n.element.noise for n in nodes])
    padded = np.pad(by_node, 2, mode="edge")
    smooth = np.convolve(padded, SMOOTHING / SMOOTHING.sum(), mode="valid")
    return np.sqrt(by_node * smooth)


def weigh(elements: list[Element], nodes: list[Node]) -> np.ndarray:
    """Which nodes are content; gives each element the length of the content within."""
    ratios = fused_ratios(nodes)
    content = (ratios > 0) & (ratios >= THRESHOLD * ratios.std())
    for element in elements:
        element.mass = 0.0
    for node, chosen in zip(nodes, content):
        node.element.mass += len(node.text) * chosen
    for element in reversed(elements[1:]):
        element.parent.mass += element.mass
    return content


def sum_up(elements: list[Element], nodes: list[Node]) -> None:
    """Gives each element the text and links within, and whether the best path is within.

    The best path of a page has the highest ratio, times the logarithm of its number of
    nodes, so that one long notice does not outdo an article.
    """
    ratios = fused_ratios(nodes)
    count: dict[int, int] = defaultdict(int)
    for node in nodes:
        count[node.element.path] += 1
    scores = [r * math.log2(1 + count[n.element.path]) for n, r in zip(nodes, ratios)]
    for node in nodes:
        node.element.chars += len(node.text)
        node.element.linked += node.linked
        node.element.links += node.links
    if max(scores) > 0:
        nodes[int(np.argmax(scores))].element.best = True
    for element in reversed(elements[1:]):
        parent = element.parent
        parent.chars += element.chars
        parent.linked += element.linked
        parent.links += element.links
        parent.best |= element.best


def spread_noise(elements: list[Element], is_noise: Callable[[Element], bool]) -> None:
    """Make noise of the elements that ``is_noise`` names and of all below them."""
    for element in elements[1:]:
        if element.name not in ("html", "body"):
            element.noise |= element.parent.noise or is_noise(element)


def apply_marks(elements: list[Element], nodes: list[Node]) -> None:
    """Make noise of elements that are marked as such, and of all below them.

    Comments, adverts, menus, sidebars, cookie and share boxes go whatever their size,
    unless they hold a main element; an article is only marked by names of comments.
    Headers, notices, searches, related parts and the like stay if the page's best path
    or an unmarked article is within and most of their text is not linked, and related
    parts of an article if most of their text is not linked.
    """
    holds_main: set[int] = set()
    for element in reversed(elements[1:]):
        if element.name == "main" or id(element) in holds_main:
            holds_main.add(id(element.parent))

    def sure(element: Element) -> bool:
        if element.name == "article":
            return element.kind == "comment" and element.parent.name != "main"
        return element.kind in ("sure", "comment") and id(element) not in holds_main

    spread_noise(elements, sure)
    if all(n.element.noise for n in nodes):
        return
    sum_up(elements, nodes)
    holds_article: set[int] = set()
    for element in reversed(elements[1:]):
        if (element.name == "article" and not element.noise and element.chars) or id(element) in holds_article:
            holds_article.add(id(element.parent))
    within: set[int] = set()
    for element in elements[1:]:
        if element.name in ("article", "main") or id(element.parent) in within:
            within.add(id(element))

    def opened(element: Element) -> bool:
        if element.kind not in ("open", "related") or element.name == "article":
            return False
        plain = 2 * element.linked < element.chars
        stays = element.best or id(element) in holds_article or id(element) in holds_main
        return not plain or not (stays or (element.kind == "related" and id(element) in within))

    spread_noise(elements, opened)


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks in page order with an empty line between.

    Nodes whose fused ratio passes the threshold are content. If article or main
    elements have content, all their text counts, and beside them blocks that have a
    path with content or are headings. Otherwise the main part is the innermost
    container of all nodes on paths with content, and every block in it counts but for
    parts that are nearly all links. Noise never counts; see :func:`apply_marks` for
    names of noise. Character references are decoded, white space becomes one space.
    Null and empty pages, and pages of noise only, give an empty text.
    """
    elements, nodes = parse(html or "")
    root = elements[0]
    if not nodes:
        return ""
    apply_marks(elements, nodes)
    content = weigh(elements, nodes)
    if not root.mass:
        return ""
    good = {n.element.path for n, chosen in zip(nodes, content) if chosen}
    for node in nodes:
        node.element.wanted += node.element.path in good and not node.element.noise
    for element in reversed(elements[1:]):
        element.parent.wanted += element.wanted
    # Elements with all content are a chain; the last is the innermost.
    part = [e for e in elements if e.wanted == root.wanted][-1]
    while part.parent and part.name not in CONTAINERS:
        part = part.parent
    for element in elements[1:]:
        main = element.name in ("article", "main") and element.mass > 0
        element.sure = element.parent.sure or main
    while part.sure and part.parent.sure:
        part = part.parent
    explicit = any(e.sure for e in elements)
    if not explicit:
        spread_noise(elements, lambda e: (
            not e.wanted and e.links >= MENU_LINKS and e.linked >= MENU_LINKED * e.chars
        ))
    blocks = []
    for element in elements:
        element.inside = element is part or bool(element.parent and element.parent.inside)
    for node in nodes:
        element = node.element
        known = not explicit or element.sure or element.path in good or re.fullmatch(r"h[1-6]", element.name)
        if element.inside and known and not element.noise:
            blocks.append(node.text)
    return "\n\n".join(blocks)


def extract_main_text(
    pages: DataFrame, id_cols: list[str], html_col: str = "html"
) -> DataFrame:
    """``id_cols, text, n_chars`` for each row of ``pages``.

    ``text`` is that of :func:`main_text`, whole, and ``n_chars`` counts its code
    points. Rows are independent: repeated rows and null or clashing ids do not
    matter, and other columns are not read.
    """
    ids = [pages.schema[c] for c in id_cols]
    names = [f"c{i}" for i in range(len(ids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=[*names, "text", "n_chars"],
            )

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, ids))
    narrow = pages.select(*(F.col(f.name).alias(n) for f, n in zip(ids, names)), F.col(html_col).alias("html"))
    out = narrow.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.toDF(*id_cols, "text", "n_chars")
