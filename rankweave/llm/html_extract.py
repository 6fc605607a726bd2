"""Main text of web pages by consensus host paths.

First pass: each page is parsed into its containers and boilerplate (by element,
role and class words) is left out.  Class words are a hint: on a page without text in
an article or main, a container with more than half of the text stays in spite of
them, unless they are about comments; and where they mark all text and no container
has that much, elements and roles alone decide.  From the container of all text that remains
one goes down as long as one child holds most of it; articles, mains and containers
with text of their own are not entered.  The generalised path of where that ends -
tags and classes from the root, with digits generalised - is the page's vote; what
was passed by is told too, with a digest of its text.  Spark adds up for each host:
the path with most votes wins, and a path beside it is a box of the host if the same
text stands there on most of the pages that have it.  Second pass: boxes of the host
go, and all other text stays.  It is taken from the elements at the winning path if
they hold all of the page's text, and else from the lowest container that does.

On a host whose pages are mostly copies of one page, a container beside the main one
counts as a box.

Only the winner and the boxes of each host are joined back.  Pages are dealt by host, those of a
host with very many in as many parts as their number wants, and its winner to each part.

A block that is mostly a link counts as no text, unless a page has nothing else.  A notice
by its class inside an article goes, as notices do.

Defined results: null html counts as empty; a page without text gives an empty
string; a null or malformed url counts as one host of its own; broken markup is
read to the end as far as it goes.  Every row gives one row, repeated rows equal ones; a
page is parsed as a whole, so memory is a few times its own size; an empty table gives an
empty one, and other columns are not read, whatever their names.  Of paths with equal
votes the one with more text wins, then the greater by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankweave.llm.skew import join_spread, sizes
from rankweave.llm.storage import written

# Elements and class words, by what they are for.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address center hgroup figcaption caption legend summary th tr thead tbody tfoot option".split())
_SILENT = frozenset("head title nav footer aside form button select textarea noscript template iframe object svg math canvas audio video dialog menu fieldset".split())
_MAIN = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer "
    "sidebar aside rail widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay "
    "comment comments commentlist disqus respond reply replies "
    "share sharing social follow subscribe subscription newsletter signup login search form copyright".split()
)

#: Words of what can outweigh the article, and words before the name of a part that a layout has or has not.
_TALK = frozenset("comment comments commentlist disqus respond reply replies".split())
_LAYOUT = frozenset("with without has have no not".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    parent: int
    quiet: bool  # boilerplate for certain
    talk: bool  # comments by its class, unless it turns out to hold the article
    hint: bool  # boilerplate by its class, unless it holds the article or most of the text
    size: int = 0  # characters of text of its own that count
    holds: bool = False


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", "", -1, False, False, False)])
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)  # container, text, in a link


def parse(html: str) -> Page:
    """Containers and text blocks of a page, in page order."""
    page = Page()
    nodes, stack, parts, at, links, linked = page.nodes, [0], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[-1], text, 2 * linked > len(text)))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if m[2] else 1
        if name in _INLINE:
            continue
        flush()
        if name in _LEAF or name in _VOID:
            if name == "h1" and not m[2]:
                _mark(nodes, stack[-1])
            continue
        links = 0
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    del stack[k:]
                    break
            continue
        if m[4].endswith("/") and name in ("svg", "iframe", "template"):
            continue
        stack.append(_open(nodes, stack[-1], name, m[4]))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return page


def _mark(nodes: list[Node], k: int) -> None:
    while k > 0 and not nodes[k].holds:
        nodes[k].holds = True
        k = nodes[k].parent


def _open(nodes: list[Node], parent: int, name: str, raw: str) -> int:
    up, classes, words, quiet = nodes[parent], "", [], name in _SILENT
    if "=" in raw or "hidden" in raw:
        for key, a, b, c in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), (a or b or c).lower()
            if key == "class":
                classes = ".".join(sorted(set(_DIGITS.sub("#", value).split())))
            if key in ("class", "id"):
                words += [w for token in value.split() for w in _named(token)]
            elif key == "role":
                quiet |= value in _ROLES
    if name in ("article", "main"):
        _mark(nodes, parent)
    path = f"{up.path}/{name}.{classes}" if classes else f"{up.path}/{name}"
    nodes.append(Node(name, path, parent, up.quiet or quiet, not _TALK.isdisjoint(words), not _WORDS.isdisjoint(words)))
    return len(nodes) - 1


def _named(token: str) -> list[str]:
    """Words of a class or id, as far as they name the container itself (not with-sidebar)."""
    words = _SPLIT.split(token)
    return words[: next((k for k, w in enumerate(words) if w in _LAYOUT), len(words))]


def settle(page: Page) -> None:
    """Decide which containers are boilerplate, and add up the text of the others."""
    nodes = page.nodes
    for k in range(1, len(nodes)):
        nodes[k].quiet |= nodes[nodes[k].parent].quiet or (nodes[k].tag == "header" and not nodes[k].holds)
    weigh(page)
    sure = [node.quiet for node in nodes]
    marked = _below(page, lambda k: (nodes[k].talk or nodes[k].hint) and _open_to_doubt(nodes[k]))
    clear = any(not (marked[k] or sure[k] or link) for k, _, link in page.blocks)
    clear |= any(node.hint and not node.talk and 2 * node.size > nodes[0].size for node in nodes)
    if clear:
        for k in range(1, len(nodes)):
            nodes[k].quiet |= nodes[nodes[k].parent].quiet or (nodes[k].talk and _open_to_doubt(nodes[k]))
        weigh(page)
        named = any(node.tag in _MAIN and node.size for node in nodes)
        half = nodes[0].size / 2
        for k in range(1, len(nodes)):
            node = nodes[k]
            node.quiet |= nodes[node.parent].quiet or (node.hint and _open_to_doubt(node) and (named or node.size <= half))
        weigh(page)
    if not nodes[0].size:
        for node, quiet in zip(nodes, sure, strict=True):
            node.quiet = quiet
        weigh(page)
    if not nodes[0].size:  # all that is left are links: then they are the text
        page.blocks = [(k, text, False) for k, text, _ in page.blocks]
        weigh(page)


def _open_to_doubt(node: Node) -> bool:
    return not node.holds and node.tag not in ("html", "body", "article", "main")


def weigh(page: Page) -> None:
    """Add up the text of the containers that are not boilerplate."""
    nodes = page.nodes
    for node in nodes:
        node.size = 0
    for k, text, link in page.blocks:
        if not nodes[k].quiet and not link:
            nodes[k].size += len(text)
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].size += nodes[k].size


def lowest(page: Page) -> int:
    """The lowest container of all text that counts; an article or main is not entered."""
    nodes, best = page.nodes, 0
    for k in range(1, len(nodes)):
        if nodes[best].tag in _MAIN:
            break
        if nodes[k].parent == best and nodes[k].size == nodes[0].size:
            best = k
    return best


def vote(page: Page, share: float = 0.6) -> tuple[str, list[tuple[str, int]]] | None:
    """Path of the container with most text, and path and digest of each one passed by."""
    nodes, beside = page.nodes, []
    if not nodes[0].size:
        return None
    children: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        if nodes[k].size:
            children.setdefault(nodes[k].parent, []).append(k)
    best = lowest(page)
    while nodes[best].tag not in _MAIN and (below := children.get(best)):
        top = max(below, key=lambda k: nodes[k].size)
        others = [k for k in below if k != top]
        if nodes[top].size < share * nodes[0].size or sum(nodes[k].size for k in below) < nodes[best].size:
            break
        if any(nodes[k].holds or nodes[k].tag in _MAIN for k in others):
            break
        beside += others
        best = top
    return nodes[best].path, [(nodes[k].path, _digest(page, k)) for k in beside]


def _digest(page: Page, top: int) -> int:
    inside = _below(page, lambda k: k == top)
    text = " ".join(text for k, text, link in page.blocks if inside[k] and not page.nodes[k].quiet and not link)
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _below(page: Page, hit: Callable[[int], bool]) -> list[bool]:
    """Whether each container is one of those that are hit, or below it."""
    inside = [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):
        inside[k] = hit(k) or (k > 0 and inside[node.parent])
    return inside


def leave_out(page: Page, boxes: Iterable[str]) -> None:
    """Leave out the boxes of the host, unless they are all that the page has."""
    nodes, paths = page.nodes, frozenset(boxes)
    inside = _below(page, lambda k: nodes[k].path in paths and not nodes[k].holds and nodes[k].tag not in _MAIN)
    if any(not (inside[k] or nodes[k].quiet or link) for k, _, link in page.blocks):
        for k, node in enumerate(nodes):
            node.quiet |= inside[k]
        weigh(page)


def text_at(page: Page, path: str) -> str:
    """Text of the blocks below the elements at `path`, without boilerplate."""
    nodes = page.nodes
    inside = _below(page, lambda k: nodes[k].path == path)
    return " ".join(text for k, text, _ in page.blocks if inside[k] and not nodes[k].quiet)


def covers(page: Page, path: str) -> bool:
    """Whether all text that counts is below the elements at `path`."""
    inside = _below(page, lambda k: page.nodes[k].path == path)
    return all(inside[k] or link or page.nodes[k].quiet for k, _, link in page.blocks)


def extract(html: str, winner: str | None, boxes: Iterable[str] = ()) -> str:
    page = parse(html)
    settle(page)
    if boxes:
        leave_out(page, boxes)
    if not page.nodes[0].size:
        return "" if winner is None else text_at(page, winner)
    return text_at(page, winner if winner is not None and covers(page, winner) else page.nodes[lowest(page)].path)


def host(url):
    """Lower-case host of a url column, without user and port; empty for no url."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, winner: the generalised path with most votes of each host's pages; boxes: paths
    beside it where most pages that have them have the same text."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(value.as_py() or "")
                settle(page)
                if (found := vote(page)) is not None:
                    rows.append((name, found[0], None, page.nodes[0].size))
                    rows += [(name, path, digest, 0) for path, digest in found[1]]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "digest", "size"])

    told = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(votes, "host string, path string, digest long, size long")
    counted = told.groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = F.col("digest").isNull()
    by_path = counted.groupBy("host", "path").agg(F.sum(F.when(main, F.col("n"))).alias("votes"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.when(~main, F.col("n"))).alias("same"))
    winner = F.max(F.when(F.col("votes").isNotNull(), F.struct("votes", "size", "path")))["path"]
    boxes = F.collect_list(F.when((F.col("same") > 1) & (2 * F.col("same") > F.col("n")), F.col("path")))
    return by_path.groupBy("host").agg(winner.alias("winner"), boxes.alias("boxes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", w.as_py(), b.as_py() or ()) for h, w, b in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    winners = written(winning_paths(pages), "winners")
    counts = given.groupBy("host").agg(F.count("*").alias("n"))
    joined = join_spread(given, winners, "host", counts, *sizes(counts), "page_id, url", "left").select("page_id", "url", "html", "winner", "boxes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
