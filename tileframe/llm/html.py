"""HTML extraction by consensus of a host's pages.

Each page's containers are scored by the text of their blocks, less what is in links, and by their names; the
page votes for the generalised path of its best container (tags and classes, digits as #). Spark adds the votes
of each host; the path with most votes wins, ties by name. Every page is then extracted again from the containers
on its host's path, or from its own best one if it has none there. Parts that are menus, headers, footers, side
bars, notices, adverts, forms, comments, scripts or styles are left out wherever they stand. A form, or a part that only its
class or id calls so, stays if it holds most of the page's text and hardly any is left without it: the page's own wrapper.

Blocks are what block tags bound; white space within one becomes one space, character references are decoded,
blocks are joined by two line feeds. A tag whose quotes don't match ends at its first >. Null or empty html gives an empty text. Null and odd urls share the host
''. Ids may be null or repeat; every row is extracted on its own. Tags that are never closed end with their parent. Equal
votes go to the greater path. An empty table gives an empty result. Time and memory are in proportion to a page's length,
however deep its tags are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, stored
from .urls import parts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOX = frozenset("article main section div td body center".split())
PLAIN_OUT = frozenset("nav footer aside form menu dialog button".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What names of classes, ids and roles say.
BAD = re.compile(r"(?:^|[-_\s])(ad|ads|advert\w*|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav\w*|breadcrumb\w*|footer|header|masthead|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comment\w*|disqus|respons\w*|form|login|search|pagination|pager|tags|toolbar|widget|copyright|legal|skip)(?:$|[-_\s])", re.I)
GOOD = re.compile(r"(?:^|[-_\s])(article\w*|content|main|post|entry|story|body|text|blog)(?:$|[-_\s])", re.I)


#: Of these, names of classes and ids that are never a page's wrapper, and tags that never are.
NEVER = re.compile(r"(?:^|[-_\s])(comment\w*|disqus|respons\w*|nav\w*|menu|footer|sidebar|ad|ads|advert\w*|cookie\w*|consent)(?:$|[-_\s])", re.I)
NEVER_TAGS = PLAIN_OUT - {"form"}
#: A wrapper holds at least half of the text; without it less than a twentieth of its own is left.
MOST, HARDLY = 0.5, 0.05


class Node:
    __slots__ = ("tag", "step", "parent", "block", "mark", "inside", "bad", "firm", "out", "good", "depth", "worth", "score", "text", "near")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.step = tag + ("." + ".".join(sorted({re.sub(r"\d+", "#", n) for n in names.lower().split()})) if names else "")
        self.block = self if tag not in INLINE or parent is None else parent.block
        self.mark = xxhash.xxh64_intdigest(self.step, parent.mark) if parent else 0  # names the path
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        by_tag = tag in PLAIN_OUT or (tag == "header" and not self.inside)
        self.bad = by_tag or (bool(names) and bool(BAD.search(names)) and tag not in ("html", "body", "article", "main"))
        self.firm = self.bad and (tag in NEVER_TAGS or tag == "header" or bool(names and NEVER.search(names)))
        self.good = 1.3 if tag in ("article", "main") or names and GOOD.search(names) else 1.0
        self.worth = self.score = 0.0
        self.text = 0
        self.out, self.near = False, None

    def path(self) -> str:
        steps, x = [], self
        while x.parent is not None:
            steps.append(x.step)
            x = x.parent
        return "/".join(["", *reversed(steps)])


def leave_out(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Sets which nodes are left out; nodes come with parents first, and each block counts by its text outside links."""
    own = Counter()
    for x in nodes:
        x.near = x if x.bad else x.parent.near if x.parent else None
        x.out = x.parent is not None and x.parent.out or x.firm  # for now: under what never is a wrapper
    for x, text, links in found:
        x.text += len(text) - links
        own[x.near] += len(text) - links
    for x in reversed(nodes):
        if x.parent is not None and not x.firm:
            x.parent.text += x.text
    left = own[None]
    for x in nodes:  # those that hold most of the text lie in one another, outer ones first
        if x.bad and not x.out and x.text >= MOST * nodes[0].text:
            if left >= HARDLY * x.text:
                break
            x.bad = False
            left += own[x]
    for x in nodes:
        x.out = x.bad or x.parent is not None and x.parent.out


def blocks(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, and each block's element, its text and how many of its characters are in links; only blocks that
    aren't left out."""
    root = Node("", "", None)
    stack, nodes, out = [root], [root], []
    opened: Counter = Counter()
    text: list[str] = []
    links = depth = 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal links
        if text:
            s = " ".join(unescape("".join(text)).split())
            if s:
                out.append((stack[-1].block, s, links))
            text.clear()
        links = 0

    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            text.append(piece)
            if depth:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            if tag not in INLINE:
                flush()
            if opened[tag]:
                if tag in INLINE:  # never beyond the block it stands in
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            pop_to(stack, i, opened)
                            break
                        if stack[i].tag not in INLINE:
                            break
                else:
                    while stack[-1].tag != tag:
                        opened[stack.pop().tag] -= 1
                    pop_to(stack, len(stack) - 1, opened)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if tag == "head" and not close:
                close = re.compile(r"(?=<body\b)", re.I).search(html, at)
            if tag not in INLINE:
                flush()
            at = close.end() if close else n
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                close_open(stack, opened, "p")
            elif tag == "li":
                close_open(stack, opened, "li", ("ul", "ol", "menu"))
            elif tag in ("td", "th"):
                close_open(stack, opened, "td", ("table",))
                close_open(stack, opened, "th", ("table",))
            elif tag == "tr":
                close_open(stack, opened, "tr", ("table",))
        if tag in VOID or m[3].endswith("/") and tag not in BOX:
            continue
        if tag == "a":
            depth += 1
        names = " ".join(next(g for g in x if g) for x in CLASS.findall(m[3]) if any(x)) if m[3] and "=" in m[3] else ""
        stack.append(Node(tag, names if tag not in INLINE else "", stack[-1]))
        nodes.append(stack[-1])
        opened[tag] += 1
    flush()
    leave_out(nodes, out)
    return nodes, [x for x in out if not x[0].out]


def pop_to(stack: list[Node], i: int, opened: Counter) -> None:
    opened.subtract(x.tag for x in stack[i:])
    del stack[i:]


def close_open(stack: list[Node], opened: Counter, tag: str, within: tuple[str, ...] = ()) -> None:
    if not opened[tag]:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            pop_to(stack, i, opened)
            return
        if stack[i].tag in within or stack[i].tag in BOX or stack[i].tag == "table":
            return


def best_box(nodes: list[Node], found: list[tuple[Node, str, int]]) -> Node | None:
    """The container with the best score: its own blocks' text in full, that of inner ones in shares; the deepest of equals."""
    if not found:
        return None
    for node, text, links in found:
        node.worth += max(0, len(text) - 2 * links) + (min(text.count(",") + text.count("."), 20) if len(text) > 40 else 0)
    best = nodes[0]
    for x in reversed(nodes):
        if x.tag in BOX or x.parent is None:
            x.score = x.worth * x.good
            if (x.score, x.depth) > (best.score, best.depth):
                best = x
        if x.parent is not None:
            x.parent.worth += x.worth * (1.0 if x.tag not in BOX else 0.6 if x.tag == "td" else 0.8)
    return best


def main_text(html: str | None, mark: int | None) -> str:
    """The text of the containers on the path of that mark (0: none), or if the page has none of its own best one, or of what remains."""
    if not html:
        return ""
    nodes, found = blocks(html)
    own: list[str] = []
    if mark:
        held = under(nodes, lambda x: x.mark == mark)
        own = [t for n, t, _ in found if n in held]
    if not own:
        box = best_box(nodes, found)
        held = under(nodes, lambda x: x is box)
        own = [t for n, t, _ in found if n in held]
    return "\n\n".join(own)


def under(nodes: list[Node], test: Callable[[Node], bool]) -> set[Node]:
    """The nodes that test holds for, and all below them."""
    held: set[Node] = set()
    for x in nodes:
        if x.parent in held or test(x):
            held.add(x)
    return held


def signed(mark: int) -> int:
    return mark - (mark >> 63 << 64)


def extracted(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars of each page, and the path its host agreed on."""
    bounded_batches(pages.sparkSession)
    host, _ = parts(F.col(url).cast("string"))
    rows = pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.col(html).cast("string").alias(html), F.coalesce(host, F.lit("")).alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = [best_box(*blocks(h)) if h else None for h in b.column(1).to_pylist()]
            cols = (pa.array([signed(x.mark) if x else None for x in boxes], pa.int64()), pa.array([x.path() if x else None for x in boxes], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["host", "mark", "path"])

    votes = rows.select("host", html).mapInArrow(vote, "host string, mark long, path string").where("path is not null")
    # The winners are a table before they are joined, so Spark knows their size: small, they are broadcast and no page is
    # shuffled; large, both sides are plain exchanges, and a host that holds a third of all pages is split.
    winners = votes.groupBy("host", "mark", "path").count().groupBy("host").agg(F.max(F.struct("count", "path", "mark")).alias("m")).select("host", "m.path", "m.mark")
    winners = stored(winners, f"{shared_dir(pages.sparkSession)}/winners")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, m if m is None else m & (1 << 64) - 1) for h, m in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column(3)], [key, url, "text", "n_chars", "path"])

    placed = rows.join(winners, "host", "left").select(key, url, html, "path", "mark")
    return placed.mapInArrow(extract, f"`{key}` long, `{url}` string, text string, n_chars long, path string")
