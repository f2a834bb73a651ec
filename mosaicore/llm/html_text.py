"""Main text of web pages by composite text density.

A page becomes a tree; subtrees that are never article text (menus, scripts, forms, notices,
comments and the like, told by tag, role, class or id) are cut off first.  A name alone does not
cut what holds the page's article or main element or most of its text outside links (`spare`), nor
a heading, nor a section of an article whose name may be its topic.  Every node then has a
density: its characters per tag, adjusted for how much of them lies in links.  A node's density
sum is that of its children, and the node with the largest sum holds the article.  The least
density on the way from the body to it is the threshold: beside that way, what is as dense as
the threshold, and more text than links, belongs to the text too.  That goes for elements and for
bare text with its inline elements, which has the density of an element with nothing else in it.
Where the densest node lies in an article or main element, that element is taken whole, and of
the elements beside it only other articles and main elements compete by density.  Where it is
the body itself, all stays but elements (other than paragraphs and headings) of links alone.

Blocks keep page order.  Inside a block white space, line breaks included, becomes one space;
character references are decoded; blocks are joined by an empty line.  Nothing else is dropped.

Edge cases: null and empty pages give an empty text; broken markup (unclosed, misnested or cut
off tags, nesting of any depth) never fails; very long pages are read whole; repeated pages are
read each; of nodes with equal sums the first, outermost one counts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.common import as_strings, pick, tidied

MARKUP = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text, not markup, up to the end tag.
RAW = frozenset("script style textarea title noframes iframe xmp noembed plaintext".split())
#: Never article text.
DROP = RAW | frozenset("head nav footer aside form noscript template button select option svg math canvas audio video object applet dialog menu input label datalist map".split())
BLOCK = frozenset("address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Words of class, id or role that mark menus, sidebars, notices, adverts and readers' comments.
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted promotion
nav navbar navigation navi menu menubar breadcrumb breadcrumbs pager pagination toc sidebar sidebars rail complementary aside
footer foot colophon contentinfo masthead topbar toolbar header siteheader pageheader cookie cookies consent gdpr notice notices
alert notification popup modal overlay newsletter subscribe subscription signup login register search searchbox comment comments commentlist disqus respond
reply replies discussion share sharing social related recommended recommendations widget copyright legal disclaimer""".split())
#: Those of readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Those that a section of an article may have for its topic.
TOPICS = frozenset("""ads adverts advertisement advertising banner sponsor sponsored promotion navigation footer header rail cookie cookies consent gdpr notice
notices alert notification subscription login register search respond reply replies discussion share sharing social related recommended recommendations
copyright legal disclaimer""".split())
#: Names that say what a page has or lacks, not what the element is.
STATE = re.compile(r"(?<!\S)(?:no|not|has|have|with|without)[-_]\S+")
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Grades of noise: cut always; by a name; by one of readers' comments; by one that may be a section's topic.
ALWAYS, NAME, COMMENT, TOPIC = 1, 2, 3, 4
#: What is named as noise stays if it has so many times the other text: beside an article, or readers' comments.
FAR_MORE = 9
#: What an open element of the name closes when it starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote aside nav header footer form".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "core", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0, core: bool = False):
        self.tag, self.parent, self.noise, self.core = tag, parent, noise, core
        self.parts: list[Node | str] = []  # children and pieces of text, in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noise_of(tag: str, rest: str, within: bool) -> int:
    """The grade of noise; within: an article or main element is open, whose own header belongs to it."""
    if tag in DROP or tag == "header" and not within:
        return ALWAYS
    if "=" not in rest and "hidden" not in rest.lower():
        return 0
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return ALWAYS
        if name in ("class", "id", "role", "aria-label"):
            words.update(WORD.findall(STATE.sub(" ", value)))
    words &= NOISE
    if within:
        words.discard("header")
    if not words or tag in HEADINGS:
        return 0
    if within and tag == "section" and words <= TOPICS:
        return TOPIC
    return NAME if words.isdisjoint(COMMENTS) else COMMENT


def parse(page: str) -> Node:
    """The tree of a page; text is still encoded."""
    root = at = Node("body", None)
    within = 0
    low = None
    pos, size = 0, len(page)
    while pos < size:
        m = MARKUP.search(page, pos)
        if m is None:
            at.parts.append(page[pos:])
            break
        if m.start() > pos:
            at.parts.append(page[pos : m.start()])
        pos = m.end()
        if not (tag := m["name"]):
            continue
        tag = tag.lower()
        if m["close"]:
            node = at
            while node is not root and node.tag != tag and not (node.tag in SCOPE and tag not in SCOPE and tag not in BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                while at is not node.parent:
                    within -= at.tag in ("article", "main")
                    at = at.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:  # skip to its end tag
            low = low or page.lower()
            end = low.find(f"</{tag}", pos)
            pos = size if end < 0 else end
            if end >= 0:
                pos = (page.find(">", end) + 1) or size
            continue
        shut = ("p",) if tag in BLOCK else ()
        shut += CLOSES.get(tag, ())
        if shut:
            node = at
            while node is not root and node.tag not in shut and node.tag not in SCOPE - set(shut):
                node = node.parent
            if node is not root and node.tag in shut:
                at = node.parent
        if at.tag == "head" and tag in BLOCK:
            at = at.parent
        noise = noise_of(tag, m["rest"], within > 0)
        if tag in ("article", "main"):  # never cut; one named as noise, such as a reader's comment, saves nothing else
            node = Node(tag, at, 0, tag == "main" or not noise)
        else:
            node = Node(tag, at, noise)
        at.parts.append(node)
        if tag not in VOID and not m["rest"].endswith("/>") or tag in BLOCK and tag != "hr":
            at = node
            within += tag in ("article", "main")
    return root


def spare(root: Node) -> None:
    """Takes the noise off what is named as noise, but holds the text of the page or is a section with a topic.

    The largest first: one with an article or main element stays if the text of these is more than what articles and
    main elements outside noise have (a tenth of the page's at least if they have none); one without stays if its text is more than all text outside noise, and far more
    if it is of readers' comments or stands in an article that has text.  Text is what is not in links.
    """
    order, stack = [], [(root, False, False)]
    some = False
    while stack:
        node, link, inside = stack.pop()
        link, core = link or node.tag == "a", inside or node.core
        order.append((node, link, inside))
        for p in node.parts:
            if not isinstance(p, str) and p.noise != ALWAYS:
                some |= p.noise > 0
                stack.append((p, link, core))
    if not some:
        return
    # of each subtree: text, text in its core elements, the same without noise in it, text of links, the topmost noise in it
    seen: dict[int, tuple[int, int, int, int, int, list[Node]]] = {}
    within = {}
    for node, link, inside in reversed(order):
        own = sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace())
        plain, linked = (0, own) if link else (own, 0)
        clean, core, clean_core = plain, 0, 0
        tops: list[Node] = []
        for p in node.parts:
            if isinstance(p, str) or p.noise == ALWAYS:
                continue
            x = seen[id(p)]
            if p.noise == TOPIC and x[0] > x[4]:
                p.noise = 0
            plain, core, linked = plain + x[0], core + x[1], linked + x[4]
            if p.noise:
                tops.append(p)
            else:
                clean, clean_core = clean + x[2], clean_core + x[3]
                tops, less = (x[5], tops) if len(x[5]) > len(tops) else (tops, x[5])
                tops.extend(less)
        if node.core:
            core, clean_core = plain, clean
        seen[id(node)] = (plain, core, clean, clean_core, linked, tops)
        within[id(node)] = inside
    every, _, clean, clean_core, _, tops = seen[id(root)]
    count = 0
    heap: list[tuple[int, int, int, Node]] = []
    while True:
        for p in tops:
            heapq.heappush(heap, (-seen[id(p)][1], -seen[id(p)][0], count, p))
            count += 1
        tops = []
        if not heap:
            return
        first, _, _, node = heapq.heappop(heap)
        plain, core, own, own_core, _, below = seen[id(node)]
        if core > clean_core and (clean_core or core * (1 + FAR_MORE) > every):
            stays = True
        elif first and not clean_core:  # too little: by all its text, after those with more
            heapq.heappush(heap, (0, -plain, count, node))
            count += 1
            continue
        elif clean_core and (core or not within[id(node)]):
            stays = False
        else:
            stays = plain > clean * (FAR_MORE if clean_core or node.noise == COMMENT else 1)
        if stays:
            node.noise = 0
            clean, tops = clean + own, below
            clean_core += own if within[id(node)] else own_core


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for those in links; share: that of the page's characters that are in links."""
    if not chars:
        return 0.0
    plain, links, tags = max(1, chars - link_chars), max(1, link_chars), max(1, tags)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    adjust = max(1.0, chars / links * tags / max(1, link_tags))
    return chars / tags * math.log(adjust + 1) / math.log(base + math.e - 1)


def counted(node: Node) -> None:
    """Fills in the counts of a node from those of its parts."""
    for p in node.parts:
        if isinstance(p, str):
            node.chars += len(p) if not p.isspace() else 0
        else:
            node.chars += p.chars
            node.tags += p.tags + 1
            node.link_chars += p.link_chars
            node.link_tags += p.link_tags + (p.tag == "a")
    if node.tag == "a":
        node.link_chars = node.chars


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and sums, children before parents; the nodes that are not noise."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.noise]
        stack.extend(p for p in node.parts if not isinstance(p, str))
    for node in reversed(order):
        counted(node)
    share = root.link_chars / max(1, root.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def laid_out(node: Node, on_way: set[int], share: float) -> list[Node]:
    """The elements of a node on the way, in order; bare text that outweighs the inline elements in it becomes an element with them."""
    out: list[Node] = []
    run: list[Node | str] = []

    def close() -> None:
        bare = sum(len(x) for x in run if isinstance(x, str) and not x.isspace())
        own = Node("span", None)
        own.parts = run.copy()
        counted(own)
        if bare and 2 * bare >= own.chars:
            own.density = density(own.chars, own.tags, own.link_chars, own.link_tags, share)
            out.append(own)
        else:
            out.extend(x for x in run if not isinstance(x, str))
        run.clear()

    for p in node.parts:
        if isinstance(p, str) or p.tag not in BLOCK and id(p) not in on_way:
            run.append(p)
        else:
            close()
            out.append(p)
    close()
    return out


def chosen(root: Node) -> list[Node]:
    """The nodes whose whole subtrees are the text, in page order."""
    spare(root)
    order = measure(root)
    best = max(order, key=lambda n: n.total)  # the first, outermost, of equals
    if best.total <= 0:
        return [root]
    way = []
    node = best
    while node is not None:
        way.append(node)
        node = node.parent
    least, share = min(n.density for n in way), root.link_chars / max(1, root.chars)
    outer = next((n for n in reversed(way) if n.tag in ARTICLES), None)
    if best is root:  # the text has no element of its own: all of the body but what has nothing outside links
        return [p for p in laid_out(root, set(), share) if p.chars > p.link_chars or p.tag == "p" or p.tag in HEADINGS]
    on_way = set(map(id, way))
    out: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        dense = node.density >= least and node.chars > node.link_chars
        if node is (outer or best):
            out.append(node)
        elif id(node) in on_way:
            stack.extend(reversed(laid_out(node, on_way, share)))
        elif outer is None or node.parent is None or node.tag in ARTICLES:
            if dense and (outer is None or node.parent is None or node.core):
                out.append(node)
        else:  # beside an article, only others and bare text count
            stack.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    return out


def block_texts(nodes: list[Node]) -> Iterator[str]:
    """The texts of the blocks of the subtrees, in page order."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                yield text

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            part = stack.pop()
            if part is None:
                yield from flush()
            elif isinstance(part, str):
                held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif part.tag in BLOCK:
                yield from flush()
                stack.append(None)
                stack.extend(reversed(part.parts))
            else:
                stack.extend(reversed(part.parts))
        yield from flush()


def main_text(page: str) -> str:
    return "\n\n".join(block_texts(chosen(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in as_strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pick(pages, page_id="page_id", url="url", html="html")
    return rows.mapInArrow(tidied(each), rows.select("page_id", "url", F.col("html").alias("text")).schema)
