"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text: runs between block-level tags, in page order. A small classifier scores each block
by its surroundings (tags, class and id names), link density and wording; the score becomes a capacity from the content
terminal or to the boilerplate terminal. Neighbouring blocks, and the nearest blocks of one parent, are joined by
smoothness edges, stronger the closer they stand in the DOM. The minimum cut, found by maximum flow, labels all blocks
of the page at once: a block that says little of itself (a short line, a caption, the heading of a list of links) goes
with those around it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)", re.S)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_PART = re.compile(r"[^>\"']+|\"[^\"]*\"|'[^']*'")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Tag names and the words by which class and id names tell what a container is for.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
SPACED = frozenset("br td th img input wbr".split()) - {"wbr"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # up to their end tag there are no other tags
SKIPPED = frozenset("noscript template svg object canvas audio video select button annotation annotation-xml".split())
NESTING = frozenset("template svg object annotation-xml".split())
# Unmistakable containers are boilerplate with all that they hold; other signs are a capacity, which fades inwards unless
# the container is called nothing else.
BAD_TAGS = frozenset("nav footer aside menu dialog search".split())
BAD_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog menu menubar".split())
BAD_NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsored comments commentlist disqus related recommended recommendations cookie cookies gdpr navbar breadcrumb breadcrumbs pagination newsletter tagcloud outbrain taboola".split())
WEAK_TAGS = {"header": 8.0, "form": 2.0, "fieldset": 2.0}
WEAK_ROLES = {"banner": 8.0, "alert": 8.0, "form": 2.0}
COMMENTS, NAMED, MENTIONED, AMBIGUOUS, FADE = 16.0, 8.0, 5.0, 2.5, 0.8
#: Words for what readers wrote, in the languages of the pages and some others; some of them name parts of a text as well.
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus respond response responses reply replies discussion discussions kommentar kommentare kommentaren leserkommentare commentaire commentaires comentario comentarios comentários commenti reacties komentarze yorumlar комментарии".split())
UNSURE_COMMENTS = frozenset("respond response responses reply replies discussion discussions".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Smoothness between neighbours and between siblings that stand apart, at the least distance; what a border leaves of it.
NEIGHBOURS, SIBLINGS, BORDER = 2.5, 1.0, 0.2
#: A name with one of these tells a state of the page, not what the container is for.
STATES = frozenset("has with without no is open opened closed enabled disabled active inactive visible collapsed".split())
BAD_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs foot footer masthead sidebar rail cookie cookies consent gdpr notice notices notification alert share sharing social related recommended recommendations widget subscribe subscription newsletter signup login popup modal overlay copyright pagination pager toolbar skip tagcloud teaser outbrain taboola".split()) | COMMENT_WORDS
PLACES = frozenset("header site page top global".split())
GOOD_WORDS = frozenset("article post entry content story main body text hentry blog prose".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "td", "th", "button"}}


@dataclass
class Node:
    tag: str
    parent: Node | None
    good: bool = False
    bad: bool = False
    weak: float = 0.0
    named: bool = False  # in a container that is called what it is
    skip: bool = False  # in an element whose text isn't read
    loose: bool = False  # such an element without an end tag: it ends with its parent or at the next block
    link: bool = False
    depth: int = 0
    block: Node | None = None  # itself or the nearest block-level element around it


@dataclass
class Block:
    node: Node
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _judge(tag: str, attrs: str, parent: Node) -> Node:
    node = Node(tag, parent, parent.good, parent.bad, parent.weak * (1.0 if parent.named else FADE), parent.named, parent.skip or tag in SKIPPED, False, parent.link or tag == "a", parent.depth + 1)
    good, bad = tag in ("article", "main"), tag in BAD_TAGS
    weak = 0.0 if tag == "header" and parent.good else NAMED if tag == "form" and parent.good else WEAK_TAGS.get(tag, 0.0)
    main, called = good, False
    if attrs and tag not in ("html", "body"):
        names: set[str] = set()
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "itemprop"):
                for token in re.split(r"\s+", value):
                    parts = {w.lower() for part in re.split(r"[_-]+", token) for w in (part, *_WORD.findall(part))}
                    if not parts & STATES:
                        names.add(token.lower())
                        words |= parts
                        own = {w for w in re.split(r"[_-]+", token.lower()) if w}
                        called |= bool(own & (BAD_WORDS | {"header"})) and own <= BAD_WORDS | PLACES
            elif name == "role":
                bad |= value.lower() in BAD_ROLES
                weak = max(weak, WEAK_ROLES.get(value.lower(), 0.0))
                good |= value.lower() in ("main", "article")
            elif (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value)) and tag not in ("article", "main"):
                bad = True  # an article that isn't shown yet is the page's article still
        main = good
        fine = bool(words & GOOD_WORDS)
        poor = bool(words & BAD_WORDS) or "header" in words and not fine and not parent.good  # inside the text it's the text's
        unclear = fine and poor and not words & {"related", "footer", "sidebar"} and not words & (COMMENT_WORDS - UNSURE_COMMENTS)
        good |= fine and not poor
        comments = words & COMMENT_WORDS - (UNSURE_COMMENTS if parent.good or tag in ("article", "main") else frozenset())
        if poor and not unclear and (comments or tag not in ("article", "main")):  # an article that is called a teaser is one
            bad |= bool(names & BAD_NAMES) and not main
            if not (parent.good and not words & (BAD_WORDS - UNSURE_COMMENTS)):  # a paper has a discussion, a letter a response
                weak = max(weak, COMMENTS if comments else AMBIGUOUS if fine else NAMED if called else MENTIONED)
    node.named |= weak >= NAMED
    if weak:  # a sign of its own outweighs what the container stands in
        node.weak, node.good = max(node.weak, weak), False
    elif main:
        node.weak, node.named = 0.0, False
    node.bad |= bad
    node.good |= good and not weak
    node.good &= not node.bad
    return node


def closed(html: str, tag: str) -> set[int]:
    """Where elements of this name start that have an end tag. One that can't hold another ends before the next."""
    open_at: list[int] = []
    out: set[int] = set()
    for m in re.finditer(rf"<(/?){tag}(?![^\s/>])", html, re.I):
        if not m[1]:
            if tag not in NESTING:
                open_at.clear()
            open_at.append(m.start())
        elif open_at:
            out.add(open_at.pop())
    return out


class Tags:
    """Where tags end. A quote without an end would make the scan for `>` run to the end of the page from every tag; what
    such scans passed is kept, so that no more than three of them are ever made, one for each state of quoting."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.failed: list[list[int]] = []  # where quoted text begins and ends in scans that found no end

    def attributes(self, at: int) -> tuple[str, int]:
        """Attributes of a tag whose name ends here, and where the tag ends. With a quote that never ends, the next `>`
        ends it; without one, the next `<` or the page."""
        if at > self.last:
            end = self.html.find("<", at)
            return "", end if end >= 0 else len(self.html)
        if not any(bisect_right(q, at) % 2 == 0 for q in self.failed):
            m = _REST.match(self.html, at)
            if m:
                return m[1], m.end()
            quoted: list[int] = []
            end = at
            for m in _PART.finditer(self.html, at):
                if m.start() != end:
                    break
                end = m.end()
                if self.html[m.start()] in "\"'":
                    quoted += m.span()
            self.failed.append([*quoted, end] if end < len(self.html) else quoted)
        close = self.html.index(">", at)
        return self.html[at:close], close + 1


def blocks(html: str) -> list[Block]:
    """Blocks with text, in page order; text is decoded and its white space single. Takes time in proportion to the page."""
    root = Node("", None)
    root.block = root
    stack, found, here = [root], [], Block(root)
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    loose_at: list[int] = []
    whole: dict[str, set[int]] = {}
    tags = Tags(html)
    at, end = 0, len(html)

    def text(s: str) -> None:
        if s and not stack[-1].skip:
            here.pieces.append(s)
            if stack[-1].link:
                here.linked += len(s.strip())

    def start_block() -> None:
        nonlocal here
        if here.pieces and (t := " ".join(entities.unescape("".join(here.pieces)).split())):
            here.text = t
            found.append(here)
        here = Block(stack[-1].block)

    def pop_to(i: int) -> None:
        for n in stack[i:]:
            open_at[n.tag].pop()
            if n.loose:
                loose_at.pop()
        del stack[i:]

    def last(names: Iterable[str]) -> int:
        return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

    while at < end:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attrs, at = tags.attributes(at)
        if m[1]:  # an end tag
            if open_at.get(tag):
                i = open_at[tag][-1]
                block = any(n.tag in BLOCKS and not n.skip for n in stack[i:])
                pop_to(i)
                if block:
                    start_block()
            elif tag in BLOCKS and not stack[-1].skip:
                start_block()
            if tag in SPACED:
                text(" ")
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
            text(" ")
            continue
        if stack[-1].skip and tag in BLOCKS and loose_at:
            pop_to(loose_at[0])
        if tag in SKIPPED:
            text(" ")
        for open_tag, closers in CLOSES.items():
            if open_at.get(open_tag) and tag in closers and (i := open_at[open_tag][-1]) > last(SKIPPED) and i > last(STOPS.get(open_tag, ())):
                pop_to(i)
        if tag in SPACED:
            text(" ")
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            node = _judge(tag, attrs, stack[-1])
            node.block = node if tag in BLOCKS else node.parent.block
            open_at.setdefault(tag, []).append(len(stack))
            if tag in SKIPPED:
                if tag not in whole:
                    whole[tag] = closed(html, tag)
                node.loose = m.start() not in whole[tag]
                if node.loose:
                    loose_at.append(len(stack))
            stack.append(node)
        if tag in BLOCKS and not stack[-1].skip:
            start_block()
    start_block()
    return found


def score(b: Block, marked: bool = True) -> float:
    """Above 0: reads like content. Surroundings weigh most, wording least. marked: whether the page says of any block
    that it's content; if not, a block that says nothing of itself is taken for content."""
    if b.node.bad:
        return -8.0
    share = min(1.0, b.linked / max(1, len(b.text)))
    words = b.text.count(" ") + 1
    z = 6.0 if b.node.good else -3.0 if marked else 0.3
    z += min(3.0, 0.12 * words) + (1.0 if b.node.tag in ("p", "blockquote", "pre") else 0.0)
    z += 0.5 if b.text[-1] in ".!?\"'”»:" else 0.0
    rich = words >= 15 and share < 0.25 and not b.node.named
    z -= b.node.weak * (0.5 if rich else 1.0)
    z -= (2.0 if b.node.good else 5.0) * share
    if not b.node.good and re.match(r"(©|\(c\)|copyright\b|all rights reserved)", b.text, re.I):
        z -= 6.0
    return z


def steps(a: Node, b: Node, most: int = 8) -> int:
    """Steps in the DOM from a to b, `most` if there are more."""
    n = 0
    while a is not b:
        n += 1
        if n >= most:
            return most
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return n


def within(a: Node, b: Node, most: int = 8) -> bool:
    for _ in range(most):
        if a is b:
            return True
        if a.parent is None:
            return False
        a = a.parent
    return False


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between a block and the last one before it of the same parent. They are
    stronger the closer two blocks stand in the DOM, and weak where a container of its own kind begins or ends. A heading
    stands next to the first block of what it heads."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}

    def join(i: int, j: int, most: float) -> None:
        a, b = found[i].node, found[j].node
        border = BORDER if a.bad != b.bad or abs(a.weak - b.weak) > 1 or a.good != b.good else 1.0
        headed = a.tag in HEADINGS and j == i + 1 and within(b, a.parent)
        out.append((i, j, most * border / (1 if headed else max(1, steps(a, b) - 1) ** 1.5)))

    for i, b in enumerate(found):
        up = id(b.node.parent or b.node)
        if i:
            join(i - 1, i, NEIGHBOURS)
        j = last.get(up)
        if j is not None and j < i - 1:
            join(j, i, SIBLINGS)
        last[up] = i
    return out


def minimum_cut(unary: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each block stays with the content terminal. unary > 0: capacity from it, < 0: to boilerplate."""
    n = len(unary)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: float, back: float) -> None:
        of[u].append(len(to))
        to.append(v)
        room.append(c)
        of[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            add(source, i, u, 0.0)
        elif u < 0:
            add(i, sink, -u, 0.0)
    for i, j, w in joined:
        add(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in of[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:  # a blocking flow of this level graph
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                back = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[back] ^ 1]
                del path[back:]
                continue
            while turn[u] < len(of[u]):
                e = of[u][turn[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(of[u]):
                path.append(of[u][turn[u]])
                u = to[path[-1]]
            elif not path:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def extract(html: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks and of those kept. Null or empty pages have none."""
    found = blocks(html) if html else []
    if not found:
        return "", 0, 0
    marked = any(b.node.good for b in found)
    unary = [score(b, marked) for b in found]
    keep = minimum_cut(unary, edges(found)) if min(unary) < 0 < max(unary) else [u > 0 for u in unary]
    kept = [b.text for b, k in zip(found, keep, strict=True) if k]
    return "\n".join(kept), len(found), len(kept)


def extract_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars, n_blocks, n_kept. The text is empty, never null, where there is none; rows
    pass one by one, so repeated rows and null keys stay; other columns aren't read."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [extract(h) for h in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), *(pa.array(c, pa.int64()) for c in ([len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got]))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "url", "text", "n_chars", "n_blocks", "n_kept"])

    out = pages.select(key, url, html).mapInArrow(run, f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long, n_blocks long, n_kept long")
    return out.toDF(key, url, "text", "n_chars", "n_blocks", "n_kept")
