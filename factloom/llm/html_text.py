"""Main text of web pages by composite text density.

Every block element of a page has its characters, link characters, tags (blocks
and links, itself among them) and link tags; inline elements belong to their
block.  Its density is characters per tag, scaled by how little of it is links;
its sum is that of its child blocks' densities.  The element of the largest sum
is the core.  The threshold is the least density on the way from the core up to
the body, the body counted with all that it holds.  The core is taken, and what
stands beside it and its ancestors, if it reaches the threshold: running text
there (paragraphs, headings, lists, tables) as one group for each ancestor,
containers one by one.  The names article and main play no part.

Left out everywhere are elements that are never prose (menus, scripts and the
like) and hidden ones.  Forms, roles of menus and dialogs, and containers whose
class or id names adverts, reader comments, cookie notices and the like are left
out too, unless the page is in them: of such elements the one that has more than
``WRAPS`` times the prose outside all of them is a wrapper, and counts as any
other element.  A name that denies or only announces its word (no-sidebar,
ad-free, comments-open) names nothing.  Class words that prose may have too, and
page headers, halve a container's density; outside the core such a container is
never taken, and inside it only if it is not mostly links and reaches half the
threshold, or is a header with a heading.

Marks are searched one after the other and none twice, so the time is linear in
the page however broken it is.  A quote opens a value only behind an equals sign.

Defined cases: null html is empty; plain text without tags is one block; broken
markup is closed as browsers do for paragraphs, items and cells; whole pages
are read, at any length; every row is a page, repeated rows and ids included; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.shipping import ship

# Element names and class words.
RAW = "script|style|noscript|template|textarea|iframe|title"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside button menu dialog object canvas audio video map svg select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside center details div fieldset figure footer header main nav section span table ul ol".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure address hr".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus nav navbar navigation "
    "newsletter popup respond sidebar sponsor sponsored subscribe subscription".split()
)
DOUBTFUL = frozenset("banner footer header menu modal notice notices promo promoted related share sharing skip social toolbar widget widgets".split())
DENYING = frozenset("no non not without free has have with off open closed hide hides disabled enabled count".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

WRAPS = 9

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile(r">|=\s*[\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("block", "chars", "density", "doubtful", "kids", "likely", "link_chars", "link_tags", "noise", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, likely: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.noise, self.likely, self.doubtful, self.kids = tag, parent, noise, likely, doubtful, []
        self.block = tag in BLOCK
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Is the element noise; is it likely to be; is it doubtful."""
    if tag in NEVER:
        return True, False, False
    likely, doubtful = tag == "form", tag == "header"
    if not attributes or tag in ("html", "body"):
        return False, likely, doubtful
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDING.search(value)):
            return True, likely, doubtful
        if name == "role" and value in ROLES:
            likely = True
        if name in ("class", "id") and tag in CONTAINERS:
            for one in value.split():
                words = _WORDS.findall(one)
                if not DENYING.intersection(words):
                    likely = likely or bool(NOISE.intersection(words))
                    doubtful = doubtful or bool(DOUBTFUL.intersection(words))
    return False, likely, doubtful


def _marks(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, tag, attributes) of every mark; comments and elements of raw text are one mark without a tag."""
    at, last, quoted = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)) < last or (start >= 0 and page.startswith("<!--", start)):
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            yield start, at, False, None, ""
            continue
        found = _OPEN.match(page, start)
        if found is None:
            at = start + 1
            continue
        end = _tag_end(page, found.end()) if quoted else page.find(">", found.end())
        if end < 0:  # some quote or tag is never closed: from here on a tag ends at the next bracket
            quoted, end = False, page.find(">", found.end())
            if end < 0:
                return
        tag, at = found.group(2).lower(), end + 1
        if tag in _RAW_ENDS and not found.group(1):
            close = _RAW_ENDS[tag].search(page, at)
            at = len(page) if close is None else close.end()
            yield start, at, False, None, ""
        else:
            yield start, at, bool(found.group(1)), tag, page[found.end() : end]


def _tag_end(page: str, at: int) -> int:
    """The bracket that ends a tag, brackets in quoted values passed over; -1 if none does."""
    while (stop := _STOP.search(page, at)) is not None:
        if stop.group() == ">":
            return stop.start()
        close = page.find(stop.group()[-1], stop.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def parse(page: str) -> Node:
    """The tree of elements; a kid is a Node or a text, its references decoded."""
    root = Node("html", None)
    here, at = root, 0
    for start, end, closing, tag, attributes in _marks(page):
        if start > at:
            here.kids.append(entities.unescape(page[at:start]))
        at = end
        if tag is None:
            continue
        if closing:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body") and tag != "body":
            continue
        if tag in BLOCK:
            node, drawing = here, None
            while node is not None and node.tag != "p" and (node.tag not in BLOCK) and node.tag != "foreignobject":
                drawing = node if node.tag == "svg" else drawing
                node = node.parent
            if node is not None and node.tag == "p":
                here = node.parent
            elif drawing is not None:
                here = drawing.parent
        if tag in CLOSES:
            same, within = CLOSES[tag]
            node, last = here, None
            while node is not None and node.tag not in within:
                last = node if node.tag in same else last
                node = node.parent
            if last is not None:
                here = last.parent
        made = Node(tag, here, *_kind(tag, attributes))
        here.kids.append(made)
        if tag not in VOID and not attributes.endswith("/"):
            here = made
    if at < len(page):
        here.kids.append(entities.unescape(page[at:]))
    return root


def density(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Composite text density; share is that of links in the whole page."""
    if not chars:
        return 0.0
    links, link_tags = max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars * links / max(chars - link_chars, 1) + share * chars + math.e)
    return max(chars / tags * math.log(chars * tags / (links * link_tags) + 1e-9) / max(math.log(base), 1e-4), 0.0)


def _walk(root: Node, all_of_it: bool) -> list[Node]:
    """The nodes in page order, their counts filled in; noise has none unless ``all_of_it``."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        node.chars = node.link_chars = node.link_tags = 0
        node.tags = 1 if node.block or node.tag == "a" else 0
        link = link or node.tag in ("a", "button")
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(kid.strip())
                node.chars += n
                node.link_chars += n if link else 0
        stack += [(kid, link) for kid in reversed(node.kids) if isinstance(kid, Node) and (all_of_it or not kid.noise)]
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, Node) and (all_of_it or not kid.noise):
                node.chars += kid.chars
                node.link_chars += kid.link_chars
                node.tags += kid.tags
                node.link_tags += kid.link_tags + (kid.tag == "a")
    return order


def _unwrap(root: Node) -> None:
    """Of the elements that are likely noise, those that wrap the page are none; the others are."""
    order = _walk(root, False)
    prose = {id(n): n.chars - n.link_chars for n in order}

    def outer() -> list[Node]:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.likely:
                found.append(node)
            else:
                stack += [k for k in node.kids if isinstance(k, Node) and not k.noise]
        return found

    likely = outer() if any(n.likely for n in order) else []
    while likely:
        rest = prose[id(root)] - sum(prose[id(n)] for n in likely)
        widest = max(likely, key=lambda n: prose[id(n)])
        if prose[id(widest)] <= WRAPS * rest:
            break
        widest.likely = False
        likely = outer()
    for node in likely:
        node.noise = True


def _measure(root: Node) -> tuple[list[Node], float]:
    """The nodes in page order with counts, densities and sums, and the body's density with all that it holds."""
    body = next((n for n in _walk(root, True) if n.tag == "body"), root)
    share = root.link_chars / max(root.chars, 1)
    whole = density(body.chars, body.link_chars, max(body.tags, 1), body.link_tags, share)
    order = _walk(root, False)
    holder: dict[int, Node] = {}
    for node in order:
        above = node.parent
        if above is not None:
            holder[id(node)] = above if above.block or above.parent is None else holder[id(above)]
        if node.block or above is None:
            node.density = density(node.chars, node.link_chars, max(node.tags, 1), node.link_tags, share) / (2 if node.doubtful else 1)
            if above is not None:
                holder[id(node)].total += node.density
    return order, whole


def _blocks(chosen: set[int], root: Node) -> list[str]:
    """Texts of the blocks under the chosen nodes, in page order."""
    out, piece = [], []

    def close() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            out.append(text)

    stack: list = [(root, False)]
    while stack:
        item, on = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if on:
                piece.append(item)
        elif not item.noise:
            on = on or id(item) in chosen
            block = item.tag in BLOCK
            if block:
                close()
                stack.append((None, on))
            elif item.tag == "br":
                piece.append(" ")
            stack += [(kid, on) for kid in reversed(item.kids)]
    close()
    return out


def _chosen(root: Node) -> tuple[set[int], list[Node]]:
    """The ids of the nodes whose text is the page's, and the way from the core up to the body."""
    _unwrap(root)
    order, whole = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    blocks = [n for n in order if n.block and (n is not root or body is root)]
    core = max(reversed(blocks), key=lambda n: n.total)
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min([whole, *(n.density for n in path[:-1] if n.block)])
    share = root.link_chars / max(root.chars, 1)
    way = set(map(id, path))
    for node in order:  # containers of doubtful names stay in the core if they read like prose
        titled = node.tag == "header" and any(isinstance(k, Node) and k.tag in HEADINGS for k in node.kids)
        if node.doubtful and id(node) not in way and (core is body or 4 * node.link_chars > node.chars or (2 * node.density < threshold / 2 and not titled)):
            node.noise = True
    chosen, taken = {id(core)}, core
    for above in path[1:]:
        beside = [k for k in above.kids if isinstance(k, Node) and k is not taken and k.chars and not k.noise and not k.doubtful and 2 * k.link_chars <= k.chars]
        running = [k for k in beside if k.tag in RUNNING]
        if running:
            sums = [sum(getattr(k, name) for k in running) for name in ("chars", "link_chars", "tags", "link_tags")]
            if density(*sums, share) >= threshold:
                chosen.update(map(id, running))
        chosen |= {id(k) for k in beside if k.tag not in RUNNING and k.block and k.density >= threshold}
        taken = above
    return chosen, path


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    return "\n\n".join(_blocks(_chosen(root)[0], root))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
