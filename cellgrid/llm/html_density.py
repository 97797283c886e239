"""Main text of web pages by composite text density.

Each block node has characters (C), tags (T), link characters (LC) and link tags (LT). Its density is
C/T, damped where links take much of it: times log of (C/LC x T/LT) to the base
ln(C x LC / (C - LC) + LCbody x C / Cbody + e). A node's density sum adds those of its children. The
subtree of the greatest sum is the article's core; the least density on the path from it to the
body is the threshold at which blocks beside that path count as content too.
Elements that by their tag or role are no article (menus, forms, asides ...) go first. Words in class or id only
make a node suspect: suspects are left out unless density says that the article lies in them.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import record_batch, row_batches

# Elements and words in class, id or role that mark what is not the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr output".split()
)
_DROPPED = frozenset(
    "nav aside footer form script style textarea title noscript iframe template head button select option object svg "
    "canvas audio video dialog menu input xmp noembed noframes fieldset map math applet".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Of the words in class and id, these are rarely wrong; the article is sought below them only where the rest of the page holds next to nothing.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "footnav comment comments commentlist respond replies disqus cookie cookies consent gdpr newsletter subscribe subscription "
    "pagination pager login masthead hidden skip outbrain taboola".split()
)
_WEAK = frozenset(
    "banner sponsor sponsored promo promotion sidebar notice notices popup modal overlay signup share sharing social related recommended "
    "recommendations widget widgets toolbar copyright legal disclaimer topbar aside teaser header".split()
)
_DENIED_BY = frozenset("has no with without non not".split())  # before a word, as in has-sidebar
_DENIED_AFTER = frozenset("free less off".split())  # after it, as in ad-free
_ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p li a span td th tr dt dd".split())  # their ids name places in the text
_KEPT = frozenset("html body article main".split())
_CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
_P_SCOPE = frozenset("html body article main section div td th li table blockquote button caption object dd dt header".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)\b", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "own", "density", "total", "suspect")

    def __init__(self, tag: str, parent: Node | None, suspect: int = 0):
        self.tag, self.parent, self.suspect = tag, parent, suspect  # suspect: 1 weakly, 2 strongly
        self.items: list[Node | str] = []  # child blocks, texts, and "\n" for a line break
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own: tuple[int, int, int, int] | None = None  # the four counts without those of children
        self.density = self.total = 0.0


def _suspicion(value: str, in_article: bool) -> int:
    """0, 1 or 2 by the words of a class or id; each blank-separated name is looked at for itself."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for i, w in enumerate(words):
            if w not in _STRONG and w not in _WEAK or w == "header" and in_article:
                continue
            if not _DENIED_BY.intersection(words[:i]) and not _DENIED_AFTER.intersection(words[i + 1 : i + 2]):
                found = max(found, 2 if w in _STRONG else 1)
    return found


GONE = 3


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """0 for what may be the article, 1 and 2 for suspects, ``GONE`` for what is none by its tag, role or style."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return GONE
    if not attributes or tag in _KEPT:
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m[5]:
            return GONE
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return GONE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
        if name == "class" or name == "id" and tag not in _ANCHORS:
            found = max(found, _suspicion(value, in_article))
    return found


def parse(html: str) -> Node:
    """Tree of block nodes with own counts; inline tags only count. Unclosed and stray tags are tolerated."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements, inline ones with their block
    links = articles = at = 0
    dropped: int | None = None  # the place in the stack of the element that is gone with all below it

    def text(raw: str) -> None:
        if dropped is not None or not raw:
            return
        raw = unescape(raw) if "&" in raw else raw
        node = stack[-1][1]
        n = len("".join(raw.split()))
        node.items.append(raw)
        node.chars += n
        if links:
            node.link_chars += n

    def close(depth: int) -> None:
        nonlocal links, dropped, articles
        while len(stack) > depth:
            tag, _ = stack.pop()
            links -= tag == "a"
            articles -= tag in ("article", "main")
        if dropped is not None and dropped >= depth:
            dropped = None

    def find(tags: str, barriers) -> int | None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags.split():
                return i
            if stack[i][0] in barriers:
                return None
        return None

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            return root
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag == "br" or tag == "hr":
            stack[-1][1].items.append("\n")
        if tag in _VOID:
            if dropped is None:
                stack[-1][1].tags += 1
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack):
            continue
        if tag in _CLOSES:
            tags, barriers = _CLOSES[tag]
            if (i := find(tags, barriers.split())) is not None:
                close(i)
        if tag not in _INLINE and (i := find("p", _P_SCOPE)) is not None:
            close(i)
        parent = stack[-1][1]
        kind = 0 if dropped is not None else _kind(tag, attributes, articles > 0)
        if tag in _INLINE and not kind:
            if dropped is None:
                parent.tags += 1
                parent.link_tags += tag == "a"
            links += tag == "a"
            stack.append((tag, parent))
            continue
        node = Node(tag, parent, kind)
        if kind == GONE:
            dropped = len(stack)
        elif dropped is None:
            parent.items.append(node)
            node.tags = 1
            node.link_tags = int(tag == "a")
        links += tag == "a"
        articles += tag in ("article", "main")
        stack.append((tag, node))


def _blocks(root: Node, out_of: int) -> list[Node]:
    """Nodes, parents before children, without what is at least ``out_of`` suspect."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.items if isinstance(c, Node) and c.suspect < out_of]
    return out


def score(root: Node, out_of: int = 1) -> list[Node]:
    """Add up counts and fill ``density`` and ``total`` (the density sum) of every node that is less than ``out_of`` suspect."""
    nodes = _blocks(root, out_of)
    for node in nodes:
        if node.own is None:
            node.own = node.chars, node.tags, node.link_chars, node.link_tags
        node.chars, node.tags, node.link_chars, node.link_tags = node.own
        node.density = node.total = 0.0
    for node in reversed(nodes):
        if node.parent is not None:
            for name in ("chars", "tags", "link_chars", "link_tags"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
            links = max(math.e, c / max(1, lc) * t / max(1, lt)) if c > lc else 1.0
            node.density = c / t * math.log(links) / max(1.0, math.log(base)) if links > 1 else 0.0
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _is_link_list(node: Node) -> bool:
    return node.link_tags >= 3 and node.link_chars > 0.6 * node.chars


def _lines(node: Node, chosen: set[int] | None, out: list[str]) -> None:
    """Text blocks of ``node`` in page order; with ``chosen``, only below chosen nodes."""
    todo: list[tuple[Node | str, bool]] = [(node, chosen is None)]
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            out.append(line)
        run.clear()

    while todo:
        item, inside = todo.pop()
        if item == "":  # the end of a block
            flush()
        elif isinstance(item, str):
            if item == "\n":
                flush()
            elif inside:
                run.append(item)
        elif not item.suspect:
            flush()
            within = inside or (chosen is not None and id(item) in chosen)
            if inside and _is_link_list(item):
                continue
            todo.append(("", within))
            todo += [(c, within) for c in reversed(item.items)]
    flush()


LITTLE = 0.02  # of a strong suspect's characters: a page that holds less besides has its article in there


def _core(nodes: list[Node]) -> Node | None:
    """The node of the greatest density sum: the first, outermost, of equals."""
    return max((n for n in nodes if n.chars), key=lambda n: (n.total, n.chars), default=None)


def _outer_suspect(node: Node | None) -> Node | None:
    found = None
    while node is not None:
        found, node = (node if node.suspect else found), node.parent
    return found


def _trust(root: Node) -> list[Node]:
    """Clears suspects that hold the article, and returns the scored nodes without the others."""
    suspects = [n for n in _blocks(root, GONE) if n.suspect]
    weak, strong = any(n.suspect == 1 for n in suspects), any(n.suspect == 2 for n in suspects)
    while True:
        if weak:
            outer = _outer_suspect(_core(score(root, 2)))
            if outer is not None:
                outer.suspect = 0
                continue
        clean = _core(score(root, 1))
        if strong:
            size = clean.chars if clean else 0
            core = _core(score(root, GONE))
            outer = _outer_suspect(core)
            if outer is not None and size <= LITTLE * core.chars:
                outer.suspect = 0
                continue
        return score(root, 1)


def main_text(html: str | None) -> str:
    """The article's blocks joined by ``\n``; empty for null or where nothing is left."""
    if not html:
        return ""
    root = parse(html)
    nodes = _trust(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    within = [n for n in nodes if n.chars]
    if not within:
        return ""
    best = _core(within)
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    threshold = min(n.density for n in path)
    top = best
    for node in path:  # an article element around the core is the article
        if node.tag in ("article", "main"):
            top = node
    chosen = {id(top)}
    if top.tag not in ("article", "main"):
        for node in path[path.index(top) + 1 :]:
            chosen |= {id(c) for c in node.items if isinstance(c, Node) and not c.suspect and c.density >= threshold > 0 and not _is_link_list(c)}
    out: list[str] = []
    _lines(root, chosen, out)
    return "\n".join(out)


def extract_pages(
    df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from the whole html.

    Null or empty html, and pages without an article, give an empty text. Repeated rows give
    repeated rows; other columns are left out; an empty table gives no rows.
    """

    def run(batches):
        for batch in row_batches(batches, 128):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield record_batch({
                "page_id": (batch.column(0), None), "url": (batch.column(1), None), "text": (texts, pa.string()),
                "n_chars": ([len(t) for t in texts], pa.int64()),
            })

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
