"""Main text of web pages by scores on the element tree.

Paragraphs give points for their length and commas to the elements above them,
less the share of their text that is links.  The element with the most points
holds the article; siblings of it with enough points, or with long text and few
links, belong to it, as do headings, lists and short paragraphs beside a section.

Names of elements (class, id, role) count after the scores.  An element named for
what is no article gives its points at a discount, is left out where the rest
has more, and is kept where the best text is inside it.  A name that only
mentions such a thing (``has-sidebar``, ``related-work``) does not mark an element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav header footer aside form button select option datalist input svg object canvas audio video dialog menu map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body".split())
#: Elements that end an open element of the same kind.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words in class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices alert overlay pager pagination popup promo promotion related reply replies respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription tags toolbar tooltip widget widgets complementary contentinfo dialog".split()
)
#: Words beside those by which a name still is that of a part of the page.
STRUCTURE = frozenset(
    "a all area aside b bar block bottom box btn button buttons c center class col column container content count cta desktop div el element empty entry field fixed float footer form global grid group head heading icon icons id inline inner input item items js large layout left level line link links list main mobile module more name nav new note number outer page pane panel part post posts prev next primary region right row s section secondary set signup site size slot small sm md lg xl span sticky strip sub text thread title top unit up user view wide wrap wrapper x".split()
)
#: Words that say how an element is, not what it is.
STATES = frozenset("has have with without no not is enabled disabled".split())
#: What the points of a paragraph in an element with a noise name are worth, against those of others.
DISCOUNT = 0.2
#: Beside a section these belong to the article even when short.
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table section".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none))""", re.I)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """noise: the element is no part of any article; named: its name says that it is none."""

    __slots__ = ("tag", "up", "kids", "noise", "named", "score", "size", "linked")

    def __init__(self, tag: str, up: "Node | None", noise: bool = False, named: bool = False):
        self.tag, self.up, self.noise, self.named = tag, up, noise, named
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = 0


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    return bool(attributes) and tag not in ("body", "html", "article", "main") and _HIDDEN.search(attributes) is not None


def _is_named(tag: str, attributes: str) -> bool:
    """Some name of the element is of words for what is no article, and of words for parts of a page only."""
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [p.lower() for p in _PARTS.split(name) if p]
            if not any(w in NOISE for w in words) or any(w in STATES for w in words):
                continue
            if all(w in NOISE or w in STRUCTURE for w in words):
                return True
    return False


def parse(source: str) -> Node:
    """The tree of a page, however broken.  Every element knows whether it is no part of an article."""
    root = top = Node("#root", None)
    at, end = 0, len(source)

    def text(s: str) -> None:
        if s:
            top.kids.append(html.unescape(s) if "&" in s else s)

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            node = top
            while node is not root and node.tag != tag:
                node = None if tag not in BLOCKS and node.tag in BLOCKS else node.up
                if node is None:
                    break
            if node is not None and node is not root:
                top = node.up
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            node = top
            while node is not root and node.tag != "p" and node.tag not in ("td", "th", "button", "table", "object"):
                node = node.up
            if node.tag == "p":
                top = node.up
        if tag in ENDS_SAME:
            node, last = top, None
            while node is not root and node.tag not in LIMITS[tag]:
                if node.tag in ENDS_SAME[tag]:
                    last = node
                node = node.up
            if last is not None:
                top = last.up
        noise = _is_noise(tag, attributes)
        node = Node(tag, top, noise, not noise and _is_named(tag, attributes))
        top.kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            top = node
        elif attributes.endswith("/") and tag not in VOID:
            top = node  # the slash means nothing outside void elements
    return root


def _children(node: Node) -> Iterator["Node | str"]:
    return (k for k in node.kids if isinstance(k, str) or not (k.noise or k.named))


def _measure(root: Node) -> list[Node]:
    """Sizes of text and link text of every element; elements in an order in which children come first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in _children(node) if not isinstance(k, str)]
    order.reverse()
    for node in order:
        node.size += sum(len(k) for k in node.kids if isinstance(k, str) and not k.isspace())
        if node.tag == "a":
            node.linked = node.size
        if node.up is not None:
            node.up.size += node.size
            node.up.linked += node.linked
    return order


def _has_block(node: Node) -> bool:
    return any(not isinstance(k, str) and k.tag in BLOCKS for k in _children(node))


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _own_text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(list(_children(x)))
    return "".join(out)


def _blocks(nodes: "list[Node | str]") -> list[str]:
    """The text of each block below ``nodes`` in page order, white space as one space."""
    out, now = [], []

    def flush() -> None:
        s = " ".join("".join(now).split())
        now.clear()
        if s:
            out.append(s)

    for node in nodes:
        stack: list = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag == "br":
                now.append(" ")
            else:
                block = x.tag in BLOCKS
                if block:
                    flush()
                    stack.append(None)
                stack += reversed(list(_children(x)))
        flush()
    return out


def _score(root: Node) -> Node:
    """Sets the scores of all elements; the best of them."""
    order = _measure(root)
    for node in order:
        if node.tag in PARAGRAPHS and node.size and not _has_block(node):
            s = _own_text(node)
            points = (1 + len(s.strip()) / 100 + sum(map(s.count, ",،、，"))) * (1 - _density(node))
            up, share = node.up, 1.0
            while up is not None and share >= 0.25:
                up.score += points * share
                up, share = up.up, share / 2
    for node in order:
        node.score *= 1 - _density(node)
        if node.tag in ("article", "main"):
            node.score = node.score * 2 + 1
    return max(reversed(order), key=lambda n: n.score, default=root)


def _named(root: Node) -> list[Node]:
    """The topmost elements with a noise name."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        for k in node.kids:
            if not isinstance(k, str) and not k.noise:
                (out if k.named else stack).append(k)
    return out


def _best(root: Node) -> Node:
    """The container of the article, found without elements of a noise name unless there is much more inside one of them."""
    best = _score(root)
    while named := _named(root):
        inside = []
        for top in named:
            top.named = False
            inside.append((_score(top).score * DISCOUNT, top))
            top.named = True
        most, top = max(inside, key=lambda x: x[0])
        if most <= best.score:
            break
        top.named = False  # it goes round the article
        stack = [root]
        while stack:  # all anew
            node = stack.pop()
            node.score, node.size, node.linked = 0.0, 0, 0
            stack += [k for k in node.kids if not isinstance(k, str)]
        best = _score(root)
    return best


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, joined by a space; empty for an empty page."""
    if not source:
        return ""
    root = parse(source)
    best = _best(root)
    if best.score <= 0 or best.tag in ("#root", "html"):
        return " ".join(_blocks([root]))
    kept: list[Node | str] = [best]
    if best.up is not None and best.tag not in ("body", "html"):
        kept = []
        one_of_some = best.tag in SMALL or best.up.tag not in ("body", "html", "#root") and best.tag == "div"
        for k in _children(best.up):
            if isinstance(k, str):  # text beside the container
                kept.append(k)
                continue
            few = _density(k) < 0.25
            if k is best or few and (k.score >= max(1.0, 0.2 * best.score) or (k.tag == "p" and k.size >= 80 or k.tag not in BLOCKS) or one_of_some and k.tag in SMALL):
                kept.append(k)
    return " ".join(_blocks(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``.

    Null html counts as empty and gives an empty text.  Every page is read whole;
    repeated rows are extracted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
