"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree of a page (implied end tags, void and raw-text
elements, unclosed and stray tags).  Elements that are never part of an article go: scripts,
styles, menus, footers, sidebars.  Forms, and what a class, id or role names as an advert, a
notice, a reader comment or a part of the page's frame, are marked.  Names of a state (has-sidebar,
comments-open) are no mark; a marked element stays, with a lower score, if it is an outer article,
holds most of the page's points or has a name of content beside the mark.  Every paragraph then passes points to its ancestors, one and one
more for every comma and every hundred characters (three at most), whole to the parent, half
to the grandparent, less above; a container's points are discounted by its share of linked
text.  The best container, widened to the article element around it, and those of its
siblings that score or read like it are kept, and every block of them becomes one line.

Character references are decoded, white space inside a block becomes one space, and a line
break element counts as white space.  Blocks without text give no line.

Results for unusual input: NULL and empty pages, and pages without text outside the removed
elements, give the empty text; cut-off pages end where they are cut; NULL ids and urls and
repeated rows pass through.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import in_batches, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead tr ul option optgroup select".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption tbody tfoot thead tr option optgroup select legend summary li dd dt".split()) | {"li", "dd", "dt"}
#: Start of one ends the nearest open other, unless one of the barriers stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NEVER = frozenset(
    "script style noscript template nav footer aside button select input textarea iframe svg canvas object "
    "embed dialog menu head title datalist map audio video noembed noframes search".split()
)
#: Words in class, id or role that mark what is not the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus discussion gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "notification notifications overlay paginate pagination pager paywall popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar "
    "complementary contentinfo hidden alert alerts announcement disclaimer".split()
)
#: These only count without a word that marks content beside them.
WEAK = frozenset("footer header meta widget tags tools bottom top links login search foot feedback".split())
CONTENT = frozenset("article body content entry main post story text page headline title".split())
#: Elements that such words cannot remove.
SAFE = frozenset("html body main".split())
#: Elements nested deeper become children of the one at this depth; their end tags still match.
DEEPEST = 512
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</[^a-zA-Z][^>]*+>?"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)([^>]*+)>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A marked word after or before one of these in a name tells a state of the element: no mark.
NEGATING = frozenset("has have with without no not non show shows hide hides is".split())
STATES = frozenset("open opened closed enabled disabled on off active inactive allowed".split())
#: Part of its score that a marked element keeps if it stays.
LOWERED = 0.5


def _read_name(name: str) -> tuple[list[str], bool]:
    """Words of one name, and whether one of them is a mark and tells no state."""
    words = [w.lower() for w in _TOKEN.findall(name)]
    return words, any(
        w in MARKED and not NEGATING.intersection(words[:i]) and not STATES.intersection(words[i + 1 :])
        for i, w in enumerate(words)
    )


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "text", "links", "commas", "score", "marked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag = tag
        self.parent = parent
        self.children: list[Node | str] = []
        self.attributes = attributes
        self.text = self.links = self.commas = 0
        self.score = 0.0
        #: None, or whether a name beside the mark protects the element.
        self.marked: bool | None = None


def parse(page: str) -> Node:
    """The element tree; its root has the tag ``html`` or what the page starts with below it."""
    root = Node("#root", None)
    stack = [root]
    beyond: list[str] = []  # open elements too deep for the stack
    at = 0
    while at < len(page):
        low = page.find("<", at)
        if low < 0:
            stack[-1].children.append(page[at:])
            break
        if low > at:
            stack[-1].children.append(page[at:low])
        found = _TAG.match(page, low)
        if not found:
            stack[-1].children.append("<")
            at = low + 1
            continue
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in beyond:
                del beyond[len(beyond) - 1 - beyond[::-1].index(tag) :]
            else:
                if tag in BLOCK or not beyond:
                    beyond.clear()
                    _close(stack, tag)
            continue
        if not beyond:
            _imply(stack, tag)
        node = Node(tag, stack[-1], found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (found[3].endswith("/") and tag in ("svg", "path", "g", "circle", "rect", "use", "line")):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                beyond.append(tag)
    return root


def _imply(stack: list[Node], tag: str) -> None:
    """End what the start of ``tag`` ends."""
    if tag in ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCK or stack[i].tag in ("td", "th", "button", "object"):
                break
    if tag in HEADINGS and stack[-1].tag in HEADINGS:
        stack.pop()
    if tag in SIBLINGS:
        ends, barriers = SIBLINGS[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in barriers:
                break
            if stack[i].tag in ends:
                del stack[i:]
                if tag != "tr":
                    break


def _close(stack: list[Node], tag: str) -> None:
    """End the nearest open ``tag``; inline elements do not end across a block."""
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag == tag or (tag in HEADINGS and open_tag in HEADINGS):
            del stack[i:]
            return
        if tag not in BLOCK and open_tag in BLOCK:
            return
        if open_tag in ("table", "td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "div", "article", "main", "section"):
            return


def _unwanted(node: Node) -> bool:
    """Whether the element goes in any case; notes on it whether its names mark it."""
    tag = node.tag
    if tag in NEVER:
        return True
    if tag == "header":
        return not _titles_article(node)
    if tag == "form":
        node.marked = False
    if not node.attributes or tag in SAFE:
        return False
    words: set[str] = set()
    marked = content = False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            for some, mark in map(_read_name, value.split()):
                words.update(some)
                marked |= mark
                content |= not mark and not CONTENT.isdisjoint(some)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    weak = bool(words & WEAK) and not words & CONTENT and tag not in HEADINGS and tag != "article"
    if marked or weak or tag == "form":
        node.marked = content
    return False


def _titles_article(node: Node) -> bool:
    """Whether a header element holds the heading of an article around it."""
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is None:
        return False
    todo = list(node.children)
    while todo:
        child = todo.pop()
        if isinstance(child, Node):
            if child.tag in HEADINGS:
                return True
            todo.extend(child.children)
    return False


def _prune(root: Node) -> list[Node]:
    """Drop unwanted elements and decode texts; returns the nodes, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(html.unescape(child) if "&" in child else child)
            elif not _unwanted(child):
                kept.append(child)
                todo.append(child)
        node.children = kept
    if not any(n.marked is False for n in order):
        return order
    _measure(order)
    points = {id(n): _points(n)[0] for n in order}
    for node in reversed(order):
        if node.parent is not None:
            points[id(node.parent)] += points[id(node)]
    left: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        left.append(node)
        node.text = node.links = node.commas = 0
        node.children = [
            c for c in node.children
            if isinstance(c, str) or c.marked is not False or _outer_article(c) or 2 * points[id(c)] > points[id(root)]
        ]
        todo.extend(c for c in node.children if isinstance(c, Node))
    return left


def _outer_article(node: Node) -> bool:
    """An article that stands in no other (one inside is a reader's comment or the like)."""
    if node.tag != "article":
        return False
    up = node.parent
    while up is not None and up.tag != "article":
        up = up.parent
    return up is None


def _measure(order: list[Node]) -> None:
    """Text and linked characters and commas below every node."""
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.text += size
                node.commas += child.count(",") + child.count("、") + child.count("，")
            else:
                node.text += child.text
                node.links += child.links
                node.commas += child.commas
        if node.tag == "a":
            node.links = node.text


def _density(node: Node) -> float:
    return node.links / node.text if node.text else 0.0


def _is_paragraph(node: Node) -> bool:
    if node.tag in ("p", "pre", "blockquote", "td", "li", "dd"):
        return True
    return node.tag in ("div", "section", "article", "main", "body", "#root") and any(
        isinstance(c, str) and c.strip() for c in node.children
    )


def _points(node: Node) -> tuple[float, Node | None]:
    """Points of a paragraph, or of the text that stands in a container itself, and who gets them whole."""
    if not node.text or not _is_paragraph(node):
        return 0.0, None
    if node.tag in ("p", "pre", "blockquote", "td", "li", "dd"):
        size, commas, up = node.text, node.commas, node.parent
    else:
        size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        commas, up = sum(c.count(",") for c in node.children if isinstance(c, str)), node
    return (1 + commas + min(size / 100, 3)) * (1 - _density(node)), up


def _score(order: list[Node]) -> Node | None:
    """Pass points up; the container with the most, None without any text."""
    for node in order:
        points, up = _points(node)
        level = 0
        while up is not None:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for node in order:
        if node.marked is not None:
            node.score *= LOWERED
    best, most = None, 0.0
    for node in order:
        if node.tag in ("article", "main", "div", "section", "td", "body", "#root", "blockquote", "center") and node.text:
            bonus = 1.25 if node.tag in ("article", "main") else 1.0
            value = node.score * (1 - _density(node)) * bonus
            if value > most:
                best, most = node, value
    if best is None:
        with_text = [n for n in order if n.text]
        return with_text[0] if with_text else None
    return best


def _widened(best: Node) -> list[Node]:
    """The container, or the article around it, with the siblings that belong to it."""
    up, around = best, None
    while up is not None:
        if up.tag == "article":
            around = up
            break
        if up.tag == "main" and around is None:
            around = up
        up = up.parent
    best = around or best
    if best.parent is None or best.tag in ("article", "main", "body", "td"):
        # further articles of the same parent that read like it are parts of a split article
        if best.tag != "article" or best.parent is None:
            return [best]
    limit = max(10.0, best.score * 0.2)
    kept = []
    siblings = [c for c in best.parent.children if isinstance(c, Node)]
    place = siblings.index(best)
    for i, node in enumerate(siblings):
        if node is best:
            kept.append(node)
        elif best.tag == "article":
            if node.tag == "article" and node.score >= best.score * 0.5 and _density(node) < 0.3:
                kept.append(node)
        elif not node.text:
            continue
        elif node.tag in HEADINGS:
            if i < place and all(s.tag in HEADINGS or not s.text for s in siblings[i:place]):
                kept.append(node)
        elif node.tag == "p":
            if _density(node) < 0.25 and (node.text > 80 or node.commas) or node.text and not node.links:
                kept.append(node)
        elif node.score >= limit and _density(node) < 0.3:
            kept.append(node)
    return kept


def _link_list(node: Node) -> bool:
    """A list or box of links inside a container that is no article."""
    if node.tag not in ("ul", "ol", "div", "section", "table") or not node.links:
        return False
    anchors, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node):
                anchors += child.tag == "a"
                todo.append(child)
    return anchors >= 2 and _density(node) > 0.7 and node.commas < anchors


def _lines(nodes: list[Node]) -> list[str]:
    lines: list[str] = []
    parts: list[str] = []

    def flush():
        line = " ".join("".join(parts).split())
        if line:
            lines.append(line)
        parts.clear()

    for top in nodes:
        article = top.tag in ("article", "main")
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                parts.append(item)
            elif item.tag in ("br", "wbr"):
                parts.append(" " if item.tag == "br" else "")
            elif item is not top and not article and _link_list(item):
                continue
            else:
                if item.tag in BLOCK:
                    flush()
                    todo.append(None)
                elif item.tag in ("td", "th"):
                    parts.append(" ")
                    todo.append(" ")
                todo.extend(reversed(item.children))
        flush()
    return lines


def main_text(page: str | None) -> str:
    """Blocks of the article of ``page``, one a line; empty if there is none."""
    if not page:
        return ""
    order = _prune(parse(page))
    _measure(order)
    best = _score(order)
    return "\n".join(_lines(_widened(best))) if best is not None else ""


def _extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(t.as_py()) for t in batch["html"]]
    return pa.RecordBatch.from_arrays(
        [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", F.col("url").cast("string"), text_of("html").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(in_batches(_extracted), f"page_id {kind}, url string, text string, n_chars long")
