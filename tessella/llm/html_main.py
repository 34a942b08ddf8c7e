"""Main text of web pages, with each site's template found by repeated subtrees.

A page is parsed to a tree that tolerates what browsers tolerate: missing end
tags, stray ones, raw script text, unknown entities. Then come two steps:

1. Template. The subtrees of the page as it came are hashed (tags and text), and
   Spark counts, for each host, under how many differing articles a subtree stands.
   Outside the article a subtree that ``MIN_PAGES`` share is the site's template and
   is deleted; so menus, headers, footers, notices and adverts go whatever they are
   called. On pages without an article long blocks are not, nor are blocks that make up
   most of a page, for then the page is a copy. Inside the article prose may repeat, so recurrence alone decides nothing
   there: only block-level boxes without prose and link lists that
   ``MIN_INSIDE`` articles share are deleted, never inline elements.
2. Names. What does not recur is dropped by its tag, role, class or id.

The text is that of the article (or ``main``, or what is left of the body), a
line for each block in page order, white space inside a block turned into one
space. Nothing else is dropped or cut.

Where the templates are few they go to the workers as they are; else the pages'
subtrees are joined with them by host and hash, and the pages with their lists by a
digest of the page, hot keys broadcast.

Defined cases: a null or empty page has an empty text; a page without a host in
its url (or a null url) belongs to the host ''; a page of any length is read whole;
repeated and null ids keep one row each; equal pages count once; extra columns are
ignored or carried whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bound_batches, cut, join_unique, map_texts

#: A template subtree stands under this many differing articles of its host.
MIN_PAGES = 2
#: The same for one inside the article.
MIN_INSIDE = 10
#: Characters outside links from which a block of a page without an article is text of its own, and
#: from which a page of mostly recurring blocks is a copy rather than a template.
LONG_TEXT = 400
#: Template rows (host, subtree) that may be broadcast; beyond it they are joined by host.
BROADCAST_ROWS = 200_000

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>)", re.S
)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
DROPPED = frozenset(
    "head script style nav footer aside form noscript template iframe button select textarea title svg "
    "dialog object canvas menu option fieldset xmp noframes math audio video".split()
)
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote table li td th dd dt figcaption".split())
#: Block-level elements that inside an article may be a list of links or a box.
BOX = frozenset("address center details div dl figure nav ol section table ul".split())
#: Words of a class, an id or a role that mark an element as no main text.
MARKED = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs footer "
    "header masthead comment comments reply replies disqus share sharing social related recommended newsletter "
    "subscribe subscription signup login search pagination pager widget toolbar complementary contentinfo".split()
)
#: Of these, words that inside an article name parts of it as well.
AMBIGUOUS = frozenset("header masthead alert side widget search toolbar overlay modal".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
#: What a start tag closes: nearest open element of the first set, unless one of the second is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_BARRIER = frozenset("td th li dd dt blockquote article section div main body button table figure".split())


class Node:
    """An element with its children: nodes and texts."""

    __slots__ = ("tag", "words", "children")

    def __init__(self, tag: str, words: frozenset[str] = frozenset()):
        self.tag, self.words, self.children = tag, words, []


def _words(attributes: str) -> frozenset[str]:
    if not attributes or "=" not in attributes:
        return frozenset()
    out: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            out.update(_SPLIT.split((a or b or c).lower()))
    out.discard("")
    return frozenset(out)


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(page)

    def close_until(depth: int) -> None:
        del stack[depth:]

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            stack[-1].children.append(page[at:begin])
        if begin == size:
            break
        match = _TAG.match(page, begin) or _LOOSE_TAG.match(page, begin)
        if not match:
            stack[-1].children.append("<")
            at = begin + 1
            continue
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_until(depth)
                    break
                # an inline end tag never closes the block it stands in
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_until(depth)
                    break
                if stack[depth].tag in _P_BARRIER:
                    break
        if tag in CLOSES:
            closed, barrier = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closed:
                    close_until(depth)
                    break
                if stack[depth].tag in barrier:
                    break
        node = Node(tag, _words(match[3]))
        stack[-1].children.append(node)
        if tag in VOID or match[3].rstrip().endswith("/") and tag not in BLOCK | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def _unwanted(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not inside:
        return True
    marked = node.words & (MARKED - AMBIGUOUS if inside or node.tag == "article" else MARKED)
    return bool(marked) and node.tag not in ("body", "html", "main")


def prune(node: Node, inside: bool = False) -> None:
    """Drops what is no main text by tag, class, id or role."""
    pending = [(node, inside)]
    while pending:
        node, inside = pending.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c, inside)]
        pending += [(c, inside or c.tag in ("article", "main")) for c in node.children if isinstance(c, Node)]


def content_roots(root: Node) -> list[Node]:
    """The outermost articles, or else the outermost main elements, or else the page."""
    for wanted in ("article", "main"):
        found, pending = [], [root]
        while pending:
            node = pending.pop()
            if node.tag == wanted:
                found.append(node)
            else:
                pending += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


#: What a subtree is or holds: an article, main or body; below its top, an element of prose.
MAIN, HAS_PROSE = 1, 2


def subtree_hashes(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """By ``id`` of each node: hash of its subtree, text characters, characters inside links, what it holds."""
    from xxhash import xxh64_intdigest

    done: dict[int, tuple[int, int, int, int]] = {}
    pending = [(root, False)]
    while pending:
        node, ready = pending.pop()
        if not ready:
            pending.append((node, True))
            pending += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        parts, size, linked = [node.tag], 0, 0
        holds = MAIN if node.tag in ("article", "main", "body") else 0
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                parts.append(f"'{text}")
                size += len(text)
            else:
                h, s, k, f = done[id(child)]
                parts.append(f"<{h:x}")
                size, linked = size + s, linked + k
                holds |= f | (HAS_PROSE if child.tag in PROSE else 0)
        if node.tag == "a":
            linked = size
        digest = xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        done[id(node)] = (digest - (1 << 63), size, linked, holds)
    return done


def eligible(root: Node, hashes: dict[int, tuple[int, int, int, int]]) -> tuple[list[Node], list[Node]]:
    """Elements that may be template, those outside the article and those inside it.

    Outside any block that does not hold the article, on pages without one any but
    prose; inside boxes without prose and link lists. What stands inside prose is
    part of it: nothing there is eligible inside the article, no inline element
    outside it.
    """
    mains = {id(r) for r in content_roots(root)} - {id(root)}
    out: tuple[list[Node], list[Node]] = ([], [])
    pending = [(root, False, False)]
    while pending:
        node, inside, prose = pending.pop()
        for child in node.children:
            if not isinstance(child, Node) or child.tag == "head":
                continue
            _, size, linked, holds = hashes[id(child)]
            within = inside or id(child) in mains
            if inside:
                # items of prose with a link each are no list of links
                fit = child.tag in BOX and (linked * 4 >= size * 3 or not holds & HAS_PROSE)
                deeper = child.tag not in PROSE
            else:
                block = child.tag in BLOCK or child.tag in DROPPED
                if mains:
                    fit = block
                else:
                    short = size - linked < LONG_TEXT or child.tag in DROPPED
                    fit = linked * 2 >= size or (short and not (child.tag in PROSE or holds & HAS_PROSE))
                    fit = fit and (block or not prose)
                fit, deeper = fit and not holds & MAIN, True
            if size and fit:
                out[inside].append(child)
            if deeper:
                pending.append((child, within, prose or child.tag in PROSE))
    return out


def _own_text(root: Node, hashes: dict[int, tuple[int, int, int, int]], gone: set[int] | frozenset[int]) -> int:
    """Characters outside links, scripts and the like, and outside the nodes in ``gone``."""
    total, pending = 0, [root]
    while pending:
        for child in pending.pop().children:
            if isinstance(child, str):
                total += len(" ".join(child.split()))
            elif child.tag != "a" and child.tag not in DROPPED and id(child) not in gone:
                pending.append(child)
    return total


def drop_template(root: Node, template: frozenset[int] | set[int]) -> int:
    """Deletes the template subtrees of a page, given their hashes; how many were deleted.

    Where a page without an article would lose four fifths of its text, ``LONG_TEXT`` characters
    or more, that is no template but a text that other pages have too: only link lists go.
    """
    hashes = subtree_hashes(root)
    nodes = [n for found in eligible(root, hashes) for n in found if hashes[id(n)][0] in template]
    gone = {id(n) for n in nodes}
    if gone and content_roots(root) == [root]:
        whole, lost = _own_text(root, hashes, frozenset()), _own_text(root, hashes, gone)
        if whole - lost >= LONG_TEXT and lost * 5 < whole:
            gone = {id(n) for n in nodes if hashes[id(n)][2] * 2 >= hashes[id(n)][1]}
    deleted = 0
    pending = [root] if gone else []
    while pending:
        node = pending.pop()
        kept = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
        deleted += len(node.children) - len(kept)
        node.children = kept
        pending += [c for c in kept if isinstance(c, Node)]
    return deleted


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page, given the template hashes of its host."""
    if not page:
        return ""
    root = parse(page)
    if template:
        drop_template(root, template)
    prune(root)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(text)

    for top in content_roots(root):
        pending: list = [top]
        while pending:
            item = pending.pop()
            if isinstance(item, str):
                held.append(item)
            elif item is None:
                flush()
            elif item.tag in VOID and item.tag != "hr":
                if item.tag == "br":
                    held.append(" ")
            else:
                if item.tag in BLOCK:
                    flush()
                    pending.append(None)
                pending += reversed(item.children)
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    """The lower-case host of a url, '' if it has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _with_host(pages: DataFrame, url_col: str, html_col: str, carry: list[str]) -> DataFrame:
    host = F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST")), F.lit("")))
    return pages.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
        host.alias("host"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )


def page_marks(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page: ``host``, ``digest`` of the page, ``article`` (a hash), ``outside`` and ``inside`` (eligible hashes)."""
    with_digest = _with_host(pages, url_col, html_col, [url_col]).withColumn("digest", F.md5("html"))
    longs = T.ArrayType(T.LongType())
    result = T.StructType(
        [T.StructField("article", T.LongType()), T.StructField("outside", longs), T.StructField("inside", longs)]
    )

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            articles, lists = [], ([], [])
            for page in texts:
                root = parse(page)
                hashes = subtree_hashes(root)
                articles.append(hash(tuple(hashes[id(r)][0] for r in content_roots(root))))
                for out, nodes in zip(lists, eligible(root, hashes), strict=True):
                    out.append(sorted({hashes[id(n)][0] for n in nodes}))
            return [pa.array(articles, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]

        return work

    seen = map_texts(with_digest, ["host", "digest"], "html", result, make)
    return seen.select("row.host", "row.digest", "res.*")


def site_templates(marks: DataFrame, min_pages: int = MIN_PAGES, min_inside: int = MIN_INSIDE) -> DataFrame:
    """``host``, ``hash``, ``n`` (pages) of every template subtree of :func:`page_marks`."""
    def weighed(column: str, least: int):
        return F.transform(column, lambda h: F.struct(h.alias("hash"), F.lit(least).alias("least")))

    each = marks.select(
        "host", "article", F.explode(F.concat(weighed("outside", min_pages), weighed("inside", min_inside))).alias("m")
    ).select("host", "article", "m.*")
    counted = each.groupBy("host", "hash", "least").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("n"))
    return counted.filter(F.col("articles") >= F.col("least")).groupBy("host", "hash").agg(F.sum("n").alias("n"))


def extract(
    pages: DataFrame,
    carry: list[str],
    url_col: str = "url",
    html_col: str = "html",
    broadcast_rows: int = BROADCAST_ROWS,
    min_pages: int = MIN_PAGES,
    min_inside: int = MIN_INSIDE,
) -> DataFrame:
    """``row`` (the ``carry`` columns) and ``res.text``: the main text of every page."""
    bound_batches(pages.sparkSession)
    marks = page_marks(pages, url_col, html_col)
    templates = cut(site_templates(marks, min_pages, min_inside))
    source = _with_host(pages, url_col, html_col, carry)
    result = T.StructType([T.StructField("text", T.StringType())])
    size = templates.count()
    if size <= broadcast_rows:
        sites: dict[str, set[int]] = {}
        for r in templates.select("host", "hash").collect():  # broadcast_rows rows at most
            sites.setdefault(r.host, set()).add(r.hash)
        joined = source.withColumn("template", F.lit(None).cast("array<bigint>"))
    else:
        sites = {}
        joined = _with_templates(source, cut(marks), templates)
    schema = T.StructType([T.StructField("row", joined.schema["carried"].dataType), T.StructField("res", result)])

    def run(batches):
        for batch in batches:
            hosts, texts, lists = (batch.column(k).to_pylist() for k in (1, 2, 3))
            out = [
                main_text(t, sites.get(h, frozenset()) if own is None else frozenset(own))
                for h, t, own in zip(hosts, texts, lists, strict=True)
            ]
            res = pa.StructArray.from_arrays([pa.array(out, pa.string())], names=["text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), res], names=["row", "res"])

    return joined.select("carried", "host", "html", "template").mapInArrow(run, schema)


def _with_templates(source: DataFrame, marks: DataFrame, templates: DataFrame) -> DataFrame:
    """``source`` with each page's own template hashes, joined without a hot host."""
    each = marks.select("host", "digest", F.explode(F.array_union("outside", "inside")).alias("hash")).distinct()
    each = each.withColumn("key", F.struct("host", "hash"))
    total = templates.agg(F.sum("n")).first()[0] or 0
    keyed = templates.select(F.struct("host", "hash").alias("key"), "n")
    found = join_unique(each, keyed, "key", "n", total, []).groupBy("host", "digest").agg(F.collect_list("hash").alias("template"))
    # every page has a row here, with as many pages as are equal to it
    pages = marks.groupBy("host", "digest").agg(F.count("*").alias("n")).join(found, ["host", "digest"], "left")
    pages = pages.select(F.struct("host", "digest").alias("page"), "n", F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))
    wanted = source.withColumn("page", F.struct("host", F.md5("html").alias("digest")))
    return join_unique(wanted, cut(pages), "page", "n", marks.count(), ["template"])
