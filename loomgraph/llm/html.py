"""HTML extraction: paragraphs pass points to their ancestors, and the best container and its good siblings are kept."""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import ship, slices, table

#: HTML element names by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript", "svg", "math", "template"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "dd", "dt"}
#: Never part of a main text; forms only if they aren't wrapped around it.
BARRED = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "option", "object", "embed", "canvas", "audio", "video", "map", "search", "head", "template"}
FORMS = {"form", "fieldset"}
SCORED = {"p", "pre", "blockquote", "td", "li", "dd", "figcaption"}
#: What a container passes on of its score to its parent, and how much more an ancestor has to hold to take its place.
DAMPING, MUCH_MORE = 0.5, 1.4
#: What a start tag closes if it is open, and the elements beyond which it isn't looked for.
_ENDS = {
    "p": (("p",), {"td", "th", "table", "article", "section", "div", "body", "html", "main"}),
    **{t: ((t,), {"ul", "ol", "dl", "table", "menu", "body", "html", "select"}) for t in ("li", "tr", "option")},
    **{t: (("dd", "dt"), {"ul", "ol", "dl", "table", "menu", "body", "html", "select"}) for t in ("dd", "dt")},
    **{t: (("td", "th"), {"ul", "ol", "dl", "table", "tr", "menu", "body", "html", "select"}) for t in ("td", "th")},
}
#: For each element: which of the searches above stop at it, and which find it.
_STOPS = {t: tuple(k for k, (_, stops) in _ENDS.items() if t in stops) for t in {t for _, stops in _ENDS.values() for t in stops}}
_FINDS = {t: tuple(k for k, (found, _) in _ENDS.items() if t in found) for t in _ENDS}
_CELLS = ("table", "td", "th")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|</[^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Parts of a class, id or role that mark what is no main text: menus, headers and footers, sidebars, notices, adverts, forms, comments.
#: What has one of the first kind is opened only if it holds the page's headline.
FIRM = frozenset(
    "breadcrumb breadcrumbs menu menubar nav navbar navigation pager paginate pagination toolbar skip toc "
    "banner contentinfo footer header masthead aside complementary related sidebar sidenav "
    "alert consent cookie cookies disclaimer gdpr notice notification overlay paywall popup toast "
    "ad ads advert advertisement adverts promo promoted promotion sponsor sponsored newsletter signup subscribe subscription".split()
)
#: What has one of the second kind isn't opened beside a headline with any text.
TALK = frozenset("comment commentlist comments disqus discussion feedback reactions replies reply respond responses reviews share sharing social".split())
BAD = FIRM | TALK | frozenset("advertising dialog form login modal search tabs tags widget".split())
#: Before a bad part these say that it is missing, or only stands beside: no-sidebar, has-sidebar.
_BESIDE = frozenset("has hide no non with without".split())
#: A token that begins with one of these names what the page is about, as category-advertising.
_ABOUT = frozenset("category categories format tag tax term topic type".split())
#: A header of one of these holds its headline.
_OWN_HEADER = frozenset("article entry post story".split())
GOOD = frozenset("article body content entry main page post story text".split())
#: Words that say nothing by themselves, and that others are glued to.
_FILL = frozenset("area bar block bottom box by container google inner item left links list listing module outer posts reader right section site slot thread top unit user wrap wrapper".split())
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Names and words by which a reader's comment is told.
_AUTHOR = frozenset("author avatar byline commenter user username vcard".split())
_TIME = frozenset("ago date datetime posted time timestamp".split())
_REPLY = frozenset("reply antworten répondre responder".split())
#: Characters of other text beside which nothing is opened, and the share of a group's text that it may be for a name that isn't plain.
OTHER_TEXT, OTHER_SHARE, LEAST_OPENED = 25, 0.1, 100


@lru_cache(4096)
def _words(part: str) -> tuple[str, ...]:
    """A part cut into known words, if all of it is such words: usercomments, adsbygoogle. The part itself otherwise."""
    known = BAD | GOOD | _FILL
    if part in known:
        return (part,)
    ways: dict[int, tuple[str, ...]] = {0: ()}
    for i in range(len(part)):
        if i in ways:
            for w in known:
                if len(w) > 1 and part.startswith(w, i):
                    ways.setdefault(i + len(w), (*ways[i], w))
    return ways.get(len(part), (part,))


@lru_cache(4096)
def _judged(token: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a class, id or role marks no main text, whether it marks a main text, whether a bad one is plain (all its words are
    known), whether it is firm, and whether it is of talk. Good words never lift a bad one."""
    words = [w for p in _PART.findall(token) for w in _words(p.lower())]
    if words and words[0] in _ABOUT:
        return False, False, False, False, False
    bad = [w for i, w in enumerate(words) if w in BAD and not (i and words[i - 1] in _BESIDE) and not (w == "header" and _OWN_HEADER.intersection(words)) and not (w == "widget" and i)]
    plain = all(w in BAD or w in GOOD or w in _FILL or w.isdigit() for w in words)
    return bool(bad), not bad and any(w in GOOD for w in words), plain, any(w in FIRM for w in bad), any(w in TALK for w in bad)


class Node:
    __slots__ = ("tag", "marks", "parent", "children", "near", "in_article", "good", "bad", "hard", "barred", "plain", "firm", "talk", "readable", "headed", "text", "links", "commas", "score", "mass")

    def __init__(self, tag: str, marks: str, parent: Node | None, hidden: bool = False):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        judged = [_judged(token) for token in marks.split()]
        whole = tag in ("body", "html", "article", "main")
        self.bad, self.good = any(x[0] for x in judged), any(x[1] for x in judged)
        self.plain, self.firm = tag in FORMS or any(x[0] and x[2] for x in judged), any(x[3] for x in judged)
        self.talk = any(x[2] and x[4] for x in judged)
        self.hard = hidden or tag in BARRED or tag in RAW or (tag == "header" and not self.in_article)
        self.barred = self.hard or tag in FORMS or (self.bad and not whole)
        self.near: dict[str, Node | None] = parent.near if parent is not None else {}
        if (tag in _STOPS and self.near) or tag in _FINDS:
            self.near = self.near | dict.fromkeys(_STOPS.get(tag, ())) | dict.fromkeys(_FINDS.get(tag, ()), self)
        self.readable = self.text = self.links = self.commas = 0
        self.headed = False
        self.score = self.mass = 0.0


def parse(html: str) -> Node:
    """A tree of elements and decoded strings; unclosed and crossed tags are tolerated, raw elements keep no text.

    No search walks up further than it closes: how many elements of a name are open is counted, for all and for those within the
    innermost cell, and each element knows the nearest one that a start tag in it would close.
    """
    root = here = Node("html", "", None)
    open_tags: Counter[str] = Counter()
    cells: list[Counter[str]] = [Counter()]

    def close(node: Node) -> None:
        """Leaves node and all that is open in it."""
        nonlocal here
        while here is not node.parent:
            open_tags[here.tag] -= 1
            if here.tag in _CELLS:
                cells.pop()
            else:
                cells[-1][here.tag] -= 1
            here = here.parent

    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.search(html, at)
        if not match:
            here.children.append(unescape(html[at:]))
            break
        if match.start() > at:
            here.children.append(unescape(html[at : match.start()]))
        at = max(match.end(), match.start() + 1)
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            node = here if (open_tags if tag in BLOCK else cells[-1])[tag] else None
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                close(node)
            continue
        if tag == "html":
            continue
        marks, hidden = "", False
        if match[3] and "=" in match[3] or "hidden" in (match[3] or ""):
            for name, a, b, c in _ATTRIBUTE.findall(match[3]):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    marks += " " + value
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    hidden = True
        if tag in CLOSES_P and (node := here.near.get("p")) is not None:
            close(node)
        if tag == "body" and here.tag == "head":
            close(here)
        if tag != "p" and tag in _ENDS and (node := here.near.get(tag)) is not None:
            close(node)
        node = Node(tag, marks, here, hidden)
        here.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not (match[3] or "").rstrip().endswith("/"):
            here = node
            open_tags[tag] += 1
            if tag in _CELLS:
                cells.append(Counter())
            else:
                cells[-1][tag] += 1
    return root


def _bar_comments(nodes: list[Node]) -> None:
    """Bars readers' comments that no name marks: two or more elements of one shape side by side, each with a link or button to reply
    and an author or a time. nodes: in the order of the page."""
    signs: dict[int, int] = defaultdict(int)
    for node in reversed(nodes):
        words = {p.lower() for p in _PART.findall(node.marks)}
        seen = signs[id(node)] | (1 if words & _AUTHOR else 0) | (2 if node.tag == "time" or words & _TIME else 0)
        if node.tag in ("a", "button") and (words & _REPLY or (len(node.children) == 1 and isinstance(node.children[0], str) and node.children[0].strip().lower() in _REPLY)):
            seen |= 4
        signs[id(node)] = seen | (8 if node.tag == "h1" else 0)
        if node.parent is not None:
            signs[id(node.parent)] |= signs[id(node)]
    for node in nodes:
        shapes: dict[tuple[str, str], list[Node]] = defaultdict(list)
        for c in node.children:
            if not isinstance(c, str) and c.tag in ("div", "li", "article", "section", "tr") and signs[id(c)] & 12 == 4 and signs[id(c)] & 3:
                shapes[c.tag, re.sub(r"\d+", "", c.marks)].append(c)
        for alike in shapes.values():
            if len(alike) > 1:
                for c in alike:
                    c.hard = c.barred = True


def _open_wrappers(root: Node) -> None:
    """Opens what is barred by a name or as a form but is wrapped around the main text.

    What is barred outermost is taken together by its name. A group is opened, largest first, if it has half of the text that isn't
    barred for good and, where it holds the first headline, more than all open text; else if there is hardly any open text beside it,
    and its name isn't a firm one. Then what it bars within is outermost. Time is proportional to the page, but for the heap.
    """
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and (not c.hard or c.tag == "button")]
    _bar_comments(nodes)
    for node in reversed(nodes):
        node.readable += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.parent is not None and node.tag != "a" and not node.hard:
            node.parent.readable += node.readable
    node = next((n for n in nodes if n.tag == "h1" and n.readable and not n.hard), None)
    while node is not None:
        node.headed, node = True, node.parent
    groups: dict[tuple[str, str], list[Node]] = defaultdict(list)
    sizes: Counter[tuple[str, str]] = Counter()
    heap: list[tuple[int, tuple[str, str]]] = []
    open_text = waiting = 0
    open_head = False

    def surface(starts: list[Node]) -> None:
        nonlocal open_text, waiting, open_head
        todo = [(n, True) for n in starts]
        touched = set()
        while todo:
            node, counts = todo.pop()
            counts = counts and node.tag not in ("a", "h1", "h2", "h3")
            open_head = open_head or (node.tag == "h1" and node.readable > 0)
            for c in node.children:
                if isinstance(c, str):
                    open_text += len(c.strip()) * counts
                elif c.hard:
                    continue
                elif c.barred:
                    key = (c.tag if c.tag in FORMS else "", re.sub(r"\d+", "", " ".join(sorted(t for t in c.marks.split() if _judged(t)[0]))))
                    groups[key].append(c)
                    sizes[key] += c.readable
                    waiting += c.readable
                    touched.add(key)
                else:
                    todo.append((c, counts))
        for key in touched:
            heapq.heappush(heap, (-sizes[key], key))

    surface([root])
    while heap:
        size, key = heapq.heappop(heap)
        if -size != sizes[key] or not size:
            continue
        group, size = groups.pop(key), -size
        headed, plain, firm = any(n.headed for n in group), any(n.plain for n in group), any(n.firm for n in group)
        enough = 2 * size >= open_text + waiting
        waiting -= size
        del sizes[key]
        if headed:
            opened = open_text < size and (not firm or size >= 2 * LEAST_OPENED)
        else:
            beside = 0 if open_head and any(n.talk for n in group) else OTHER_TEXT if plain else max(OTHER_TEXT, OTHER_SHARE * size)
            opened = not firm and size >= LEAST_OPENED and open_text <= beside
        if enough and opened:
            for n in group:
                n.barred = n.bad = False
            surface(group)


def _bottom_up(root: Node) -> list[Node]:
    """The nodes outside barred parts, each after all that it holds."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.barred:
            out.append(node)
            todo += [c for c in node.children if not isinstance(c, str)]
    return out[::-1]


def _add_up(nodes: list[Node]) -> None:
    """Characters of text, those in links, and commas, without barred parts: sums from the leaves to the root."""
    for node in nodes:
        for c in node.children:
            if isinstance(c, str):
                n = len(_SPACE.sub(" ", c).strip())
                node.text += n
                node.commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.barred:
                node.text, node.links, node.commas = node.text + c.text, node.links + c.links, node.commas + c.commas
        if node.tag == "a":
            node.links = node.text


def _blocks(nodes: list[Node | str]) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(parts)).strip()
        if line:
            out.append(line)
        parts.clear()

    todo: list[object] = [*reversed(nodes)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.barred:
            block = item.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return out


def _points(node: Node) -> float:
    """A paragraph's points: one, one a comma and one a hundred characters, less the share of its text in links.

    A paragraph is an element of a paragraph's name, of which only its own strings count if it holds others, or a
    container with strings of its own.
    """
    own = [c for c in node.children if isinstance(c, str)]
    if node.tag in SCORED and not any(not isinstance(c, str) and c.tag in SCORED for c in node.children):
        length, links, commas = node.text, node.links, node.commas
    elif node.tag in SCORED or (node.tag in ("div", "section", "article", "main", "body", "html") and any(c.strip() for c in own)):
        length, links, commas = sum(len(c.strip()) for c in own), 0, sum(c.count(",") for c in own)
    else:
        return 0.0
    return (1 + commas + length / 100) * (1 - links / length) if length else 0.0


def _density(node: Node) -> float:
    return node.links / node.text if node.text else 1.0


def _score(nodes: list[Node]) -> list[Node]:
    """Passes points up: all of a paragraph's to its parent (a container's own strings count for itself), then DAMPING of them at
    each level, to the root. mass is what a node's whole subtree earned. Returns the nodes with a score."""
    scored = []
    for node in nodes:
        points = _points(node)
        node.mass = points + sum(c.mass for c in node.children if not isinstance(c, str) and not c.barred)
        paragraph = node.tag in SCORED and node.parent is not None
        if not paragraph:
            node.score += points
        if node.score:
            node.score += 8.0 * (node.tag in ("article", "main")) + 5.0 * node.good - 5.0 * node.bad
            scored.append(node)
        if node.parent is not None:
            node.parent.score += DAMPING * max(node.score, 0.0) + points * paragraph
        node.score *= 1 - (_density(node) if node.text else 0)
    return scored


def _container(scored: list[Node]) -> Node:
    """The best node; an article or main that holds it, or else the nearest ancestor in which much more was earned."""
    best = max(reversed(scored), key=lambda n: n.score)
    chain = [best]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    for node in chain:
        if node.tag in ("article", "main"):
            return node
    for node in chain[1:]:
        if node.mass >= MUCH_MORE * best.mass and _density(node) < 0.3:
            best = node
    return best


def extract(html: str) -> str:
    """The main text's blocks, one a line; empty if no element has text of its own."""
    root = parse(html)
    _open_wrappers(root)
    nodes = _bottom_up(root)
    _add_up(nodes)
    scored = _score(nodes)
    if not scored:
        return ""
    best = _container(scored)
    least = max(10, 0.2 * best.score)
    if best.parent is None:
        return "\n".join(_blocks([best]))
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, str):
            if best.tag not in ("article", "main") and len(c.strip()) > 80:
                kept.append(c)
        elif not c.barred:
            if best.tag in ("article", "main"):
                good = c.tag == best.tag and c.score >= least
            else:
                heading = c.tag in ("h1", "h2", "h3") and best.tag != "body" and c.text and not c.links
                good = c.score >= least or (c.tag == "p" and _density(c) < 0.25 and c.text > 80) or heading
            if good:
                kept.append(c)
    return "\n".join(_blocks(kept))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row.

    A null or empty html, and a page without a text, gives an empty text; a null page_id or url is passed on. Malformed or cut-off
    markup is read as far as it goes. A page of any length or depth is read whole, without recursion and in time proportional to
    its length. Of equally good containers the first in the page wins. Repeated rows are read each, an empty table gives no rows,
    and other columns, whatever their names, are not read.
    """
    ship(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_pages over all `pages`; its docstring gives the results for nulls, empty and long pages, repeats and empty tables."""
    return extract_pages(table(spark, sf_dir, "pages"))


