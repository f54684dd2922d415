"""Main text of web pages after removing the template of their site.

1. Every page becomes a tree; every element outside plain prose gets a hash of its whole
   subtree, and each different page of a host sends its distinct hashes once (rows and mirrors
   of one page count as one). Spark counts them per host.
2. Subtrees that recur on at least ``SHARE`` of a host's pages (and on ``LEAST_PAGES``)
   are template: they are deleted wherever they stand. Inside an article the plain text
   blocks are spared, so that repeated sentences of articles survive. On pages that mark no
   article, a list or section that recurs word for word goes even between blocks of text.
3. Elements that are no main text by their tag, role, class or id go, too, which also
   serves hosts with few pages, but never those around ``main``, an article or the main
   heading. If a page marks its article (``main``, or ``article`` if it holds most of
   ``main``), that is the text; otherwise the whole rest of the body is.

Counted hashes are short. If a host's template hashes fit a measured bound
(``NEAR_HASHES``) they go to the tasks that read the pages; beyond it pages and hashes
meet by salted host.

Defined cases: null and empty html give an empty text; a null or odd url counts as one
host without template (never by recurrence); comments, scripts and unclosed or broken
tags give no text; a tag cut off by the end of the page is dropped; ``br`` is white
space; rows that repeat a page_id are handled each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.storage import materialise

SHARE = 0.3
LEAST_PAGES = 4
NEAR_HASHES = 500_000
SALTS = 16

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong span a u s code small sub sup mark q cite td th li dt dd br".split())
CLOSES_P = BLOCKS - frozenset("caption tbody td tfoot th thead tr li dd dt option optgroup legend summary body html".split())
# An opening tag that ends an open element of the same set, up to one of the stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NO_TEXT = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button "
    "input select textarea label fieldset dialog menu title noembed noframes".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_TEXT_NAMES = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar "
    "banner cookie cookies consent gdpr notice notices notification alert ad ads adv advert adverts advertisement "
    "advertising adsense adslot sponsor sponsored promo promotion promoted comment comments discussion disqus respond "
    "replies share sharing social follow related recommended recommendations teaser teasers newsletter subscribe "
    "subscription signup login popup modal overlay paywall pagination pager toolbar skip hidden tags toc widget widgets".split()
)
# Elements without main text, unless they stand around the article.
HOLDERS = frozenset("form fieldset label".split())
CLOSED = NO_TEXT - HOLDERS
# First parts of the names of articles that are cards or comments, and parts that tell a state.
CARD_NAMES = frozenset("ad advert comment promo promoted recommended related sponsor sponsored teaser widget".split())
STATES = frozenset("no not none without with has is open opened closed enabled disabled on off".split())
# Articles are the text of ``main`` if they hold at least this share of it.
ARTICLE_SHARE = 0.6
SPACE = re.compile(r"[\s]+")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME_PARTS = re.compile(r"[^a-z0-9]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Element:
    __slots__ = ("tag", "attributes", "children", "holds")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.holds = tag, attributes, [], False


def parsed(page: str) -> Element:
    """A tree of elements and strings; unclosed elements end where the standard's rules end them."""
    root = Element("#page", "")
    stack, at, size = [root], 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if not found:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        name = found[2]
        if not name or not found[4]:
            continue
        tag = name.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in stops:
                    break
                if stack[depth].tag in ends:
                    del stack[depth:]
                    break
        element = Element(tag, found[3])
        stack[-1].children.append(element)
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            continue
        stack.append(element)
    _mark_holders(root)
    return root


def _mark_holders(root: Element) -> None:
    """Tell the elements that stand around the main heading, ``main`` or an article that is no card."""
    order, stack = [], [root]
    while stack:
        top = stack.pop()
        order.append(top)
        stack += [c for c in top.children if isinstance(c, Element)]
    for top in reversed(order):
        for child in top.children:
            if isinstance(child, str) or child.tag in CLOSED:
                continue
            if child.holds or child.tag in ("main", "h1") or child.tag == "article" and not excluded(child):
                top.holds = True
                break


def _names_no_text(words: list[str], tag: str) -> bool:
    """Whether names in class or id mark an element that is no main text.

    A name with a part such as ``no`` or ``open`` tells a state, not what the element is. Prose and
    articles are judged by whole names; of other elements a part suffices, as in ``site-footer``.
    """
    for word in words:
        if word in NO_TEXT_NAMES:
            return True
        parts = NAME_PARTS.split(word)
        if tag == "article":
            if parts[0] in CARD_NAMES and STATES.isdisjoint(parts):
                return True
        elif tag not in PROSE and not NO_TEXT_NAMES.isdisjoint(parts) and STATES.isdisjoint(parts):
            return True
    return False


def excluded(element: Element) -> bool:
    """Whether the element is no main text by its tag, role, class or id.

    The page, its body and ``main`` are never judged by name, and nothing around the article is.
    """
    if element.tag in CLOSED:
        return True
    holds = element.tag in ("#page", "html", "body", "main") or element.holds and element.tag != "article" and element.tag not in PROSE
    if element.tag in HOLDERS and not holds:
        return True
    for name, *values in ATTRIBUTE.findall(element.attributes) if element.attributes else ():
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if holds:
            continue
        if name == "role" and value in NO_TEXT_ROLES:
            return True
        if name in ("class", "id") and _names_no_text(value.split(), element.tag):
            return True
    return False


def text_mass(element: Element) -> int:
    """Characters of text in the element, without white space at the ends of its pieces."""
    mass, stack = 0, [element]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            mass += len(node.strip())
        elif node is element or not excluded(node):
            stack += node.children
    return mass


def _hash_into(element: Element, found: dict[int, int]) -> bytes:
    """Digest of a subtree; ``found`` gets the digest of each element that holds text."""
    order, stack = [], [element]
    while stack:
        top = stack.pop()
        order.append(top)
        stack += [c for c in top.children if isinstance(c, Element)]
    digests: dict[int, bytes] = {}
    for top in reversed(order):
        parts = [top.tag.encode()]
        for child in top.children:
            parts.append(digests[id(child)] if isinstance(child, Element) else SPACE.sub(" ", child).strip().encode("utf-8", "replace"))
        digests[id(top)] = digest = hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()
        found[id(top)] = int.from_bytes(digest, "little", signed=True)
    return digests[id(element)]


def subtree_hashes(root: Element) -> dict[int, int]:
    found: dict[int, int] = {}
    _hash_into(root, found)
    return found


def _elements(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements in page order, with whether they stand inside an article."""
    stack = [(root, False)]
    while stack:
        element, inside = stack.pop()
        yield element, inside
        inside = inside or element.tag in ("article", "main")
        stack += [(c, inside) for c in reversed(element.children) if isinstance(c, Element)]


def template_candidates(page: str) -> set[int]:
    """Hashes of the page's subtrees that may be part of a template."""
    root = parsed(page)
    hashes = subtree_hashes(root)
    return {
        hashes[id(e)]
        for e, inside in _elements(root)
        if e.tag not in ("#page", "html", "head", "body", "article", "main", "br") and not (inside and e.tag in PROSE)
    }


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text, one a line."""
    if not page:
        return ""
    root = parsed(page)
    hashes = subtree_hashes(root) if template else {}

    def dropped(element: Element, inside: bool) -> bool:
        if element.tag == "header" and not inside or excluded(element):
            return True
        return bool(template) and not (inside and element.tag in PROSE) and hashes[id(element)] in template

    def marked(tag: str) -> list[Element]:
        out, stack = [], [(root, False)]
        while stack:
            element, inside = stack.pop()
            if dropped(element, inside):
                continue
            if element.tag == tag:
                out.append(element)
                continue
            stack += [(c, inside or element.tag in ("article", "main")) for c in reversed(element.children) if isinstance(c, Element)]
        return out

    roots = marked("main") or marked("article")
    inside = bool(roots)
    if inside and roots[0].tag == "main":
        articles = marked("article")
        # A card among the text of main is no article.
        if articles and sum(map(text_mass, articles)) >= ARTICLE_SHARE * sum(map(text_mass, roots)):
            roots = articles
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    for top in roots or [root]:
        # (element or text, leaving)
        stack: list[tuple] = [(top, False)]
        while stack:
            node, leaving = stack.pop()
            if isinstance(node, str):
                line.append(entities.unescape(node))
                continue
            block = node.tag in BLOCKS
            if leaving:
                flush()
                continue
            if node is not top and dropped(node, inside):
                if block:
                    flush()
                continue
            if node.tag == "br":
                line.append(" ")
            if block:
                flush()
                stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children)]
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str | None:
    found = HOST.match(url or "")
    return found[1].lower() if found else None


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST.pattern, 1))


def template_hashes(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """host, hash of the subtrees that recur across the different pages of a host."""

    def candidates(batches):
        for batch in batches:
            hosts, hashes = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = template_candidates(page.as_py() or "")
                hosts += [host] * (len(found) + 1)
                hashes += [None, *found]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "hash"])

    # Rows and mirrors of one page count once.
    known = pages.select(_host(F.col("url")).alias("host"), F.sha2("html", 256).alias("digest"), "html").where("host <> ''")
    different = known.groupBy("host", "digest").agg(F.first("html").alias("html"))
    counted = (
        different.select("host", "html")
        .mapInArrow(candidates, "host string, hash long")
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("hash").isNull() | (F.col("n") >= least))
    )
    counted = materialise(counted, "subtrees")
    sizes = counted.where("hash is null").select("host", F.col("n").alias("pages"))
    return counted.where("hash is not null").join(sizes, "host").where(F.col("n") >= F.col("pages") * share).select("host", "hash")


RESULT = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, share: float = SHARE, near_hashes: int = NEAR_HASHES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    known = materialise(template_hashes(pages, share), "template")
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def batch_of(ids, urls, texts):
        return pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    if known.count() <= near_hashes:
        by_host: dict[str, set[int]] = {}
        for row in known.toLocalIterator():
            by_host.setdefault(row.host, set()).add(row.hash)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def near(batches):
            for batch in batches:
                urls = batch.column(1).to_pylist()
                texts = [main_text(p.as_py(), shared.value.get(host_of(u), frozenset())) for u, p in zip(urls, batch.column(2))]
                yield batch_of(batch.column(0), batch.column(1), texts)

        return wanted.mapInArrow(near, RESULT)

    # A host's hashes are at most 1 / share times the elements of a page.
    salted = wanted.select("*", _host(F.col("url")).alias("host"), (F.xxhash64("page_id", "url") % SALTS).alias("salt"))
    lists = known.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    lists = lists.select("host", "hashes", F.explode(F.sequence(F.lit(1 - SALTS).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))

    def far(batches):
        for batch in batches:
            lists = batch.column("hashes").to_pylist()
            texts = [main_text(p.as_py(), set(h or ())) for p, h in zip(batch.column("html"), lists)]
            yield batch_of(batch.column("page_id"), batch.column("url"), texts)

    return salted.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "hashes").mapInArrow(far, RESULT)
