"""Main text of web pages: site templates go by recurrence, page furniture by its role.

Every element subtree of a page has a hash over its tag, class and text. Spark counts the hashes by host, over pages of
different content: those with the same main text before templates go count once. A subtree that recurs on many of
them is part of that site's template and is deleted. What stays is the main container
(``article`` or ``main``, else the body) without the elements whose tag, role or class says that they are menus,
headers, footers, sidebars, notices, adverts, forms, scripts or reader comments. Inside an article, paragraphs,
headings, list items, cells and what holds them are never taken for a template: copies of a page on one host keep
their text.

The recurring subtrees go to the executors by broadcast only while there are at most ``BROADCAST_ROWS`` of them;
beyond that they are joined, the pages of a hot host dealt out by page.

Defined cases: null or empty html gives the empty text; a null url is a host of its own; unclosed, cut-off and stray
tags are read as browsers do; pages of any length are read whole; repeated rows give repeated result rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import column, stored

LEAST_PAGES, LEAST_SHARE = 5, 0.2
BROADCAST_ROWS = 200_000
SALTS = 32

# Element names of HTML, and words that classes and ids use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas audio video textarea title xmp".split())
#: Of these, elements of other languages, which may close themselves.
FOREIGN = frozenset(("svg", "math"))
DROPPED = frozenset("head nav footer aside form button select option dialog menu label fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th tr dd dt figcaption b i em strong a span code u s small sub sup br q cite".split())
#: Of these, what keeps the elements around it too.
KEPT_WITH_PARENTS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs sidebar widget menu nav navbar navigation footer masthead "
    "comment comments commentlist disqus respond reply replies pagination pager toolbar login search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)"


@dataclass
class Node:
    tag: str
    label: str = ""
    furniture: bool = False
    children: list = field(default_factory=list)
    digest: int = 0


def _attributes(raw: str, whole: bool = False) -> tuple[str, bool]:
    """(class and id, whether they, the role or a style say that this is no content).

    whole: only whole class names count, as for paragraphs and their like; else also their words.
    """
    if not raw or raw.isspace():
        return "", False
    label, furniture = [], False
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            label.append(value)
            furniture = furniture or any(w.lower() in FURNITURE for w in (value.split() if whole else WORD.findall(value)))
        elif name == "role":
            furniture = furniture or value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            furniture = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            furniture = True
    return " ".join(label), furniture


def parse(page: str) -> Node:
    """The tree of a page; every element carries the digest of its subtree."""
    root = Node("#root")
    stack, at, opened = [root], 0, Counter()

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            opened[node.tag] -= 1
            body = "\x1f".join(c if isinstance(c, str) else f"\x1e{c.digest:x}" for c in node.children)
            node.digest = xxhash.xxh64_intdigest(f"{node.tag}\x1d{node.label}\x1d{' '.join(body.split())}")

    def leave(tags: frozenset | set, barrier: frozenset) -> None:
        if not any(opened[t] > 0 for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in barrier:
                return

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or m[5] and not m[0].endswith(">"):
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        if m[1] or m[4]:
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        if tag in RAW:
            if tag in FOREIGN and m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            leave({"p"}, frozenset({"td", "th", "table", "li", "article", "section", "div", "body"}))
            if tag in HEADINGS:
                leave(set(HEADINGS), frozenset({"article", "section", "div", "body", "td"}))
        if tag == "li":
            leave({"li"}, frozenset({"ul", "ol", "menu"}))
        elif tag in ("dd", "dt"):
            leave({"dd", "dt"}, frozenset({"dl"}))
        elif tag in ("td", "th"):
            leave({"td", "th"}, frozenset({"tr", "table"}))
        elif tag == "tr":
            leave({"tr"}, frozenset({"table"}))
        node = Node(tag, *_attributes(m[3] or m[6] or "", tag in KEPT_WITH_PARENTS))
        stack[-1].children.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            stack.append(node)
            opened[tag] += 1
    close(0)
    return root


def _elements(node: Node) -> Iterator[Node]:
    pending = [node]
    while pending:
        here = pending.pop()
        yield here
        pending += [c for c in here.children if isinstance(c, Node)]


def mains(root: Node) -> list[Node]:
    """The outermost articles, or main elements, that are no furniture; else the body, else all."""
    for tag in ("article", "main"):
        found, pending = [], [root]
        while pending:
            here = pending.pop()
            if here.tag == tag and not here.furniture:
                found.append(here)
            elif not (here.tag in DROPPED or here.furniture and here.tag not in ("html", "body")):
                pending += [c for c in reversed(here.children) if isinstance(c, Node)]
        if found:
            return found
    return [n for n in _elements(root) if n.tag == "body"][:1] or [root]


def spared(top: Node) -> set[int]:
    """The elements (by id()) of an article or main element that no template takes: its text and what holds it."""
    out: set[int] = set()
    if top.tag not in ("article", "main"):
        return out
    holding: set[int] = set()
    above: dict[int, Node] = {}
    pending = [top]
    while pending:
        here = pending.pop()
        if here is not top and (here.tag in DROPPED or here.furniture):
            continue
        if here.tag in KEPT_IN_ARTICLE:
            out.add(id(here))
        if here.tag in KEPT_WITH_PARENTS:
            node = above.get(id(here))
            while node is not None and id(node) not in holding:
                holding.add(id(node))
                node = above.get(id(node))
        for c in here.children:
            if isinstance(c, Node):
                above[id(c)] = here
                pending.append(c)
    return out | holding


def template_candidates(root: Node) -> set[int]:
    """Digests of the subtrees that may belong to a site's template."""
    chosen = mains(root)
    kept = {id(m) for m in chosen}.union(*map(spared, chosen))
    return {n.digest for n in _elements(root) if n.tag not in ("#root", "html", "body", "head") and id(n) not in kept}


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return text_of(parse(page), templates)


def text_of(root: Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        words = " ".join("".join(held).split())
        if words:
            blocks.append(words)
        held.clear()

    for top in mains(root):
        article = top.tag in ("article", "main")
        kept = spared(top) if templates else ()
        pending: list = [("open", top, False)]
        while pending:
            what, node, heading_only = pending.pop()
            if what == "text":
                if not heading_only:
                    held.append(node)
                continue
            block = node.tag in BLOCKS
            if what == "close":
                flush()
                continue
            if node is not top:
                if node.tag in DROPPED or node.furniture and node.tag not in ("html", "body") or node.tag == "header" and not article:
                    if block:
                        flush()
                    continue
                if node.digest in templates and id(node) not in kept:
                    if block:
                        flush()
                    continue
            if node.tag == "br":
                held.append(" ")
                continue
            if block:
                flush()
                pending.append(("close", node, False))
            only = heading_only and node.tag not in HEADINGS or node.tag == "header"
            for child in reversed(node.children):
                pending.append(("text" if isinstance(child, str) else "open", child, only))
        flush()
    return "\n".join(blocks)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def recurring(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, digest): the subtrees on at least ``least_pages`` and ``least_share`` of the different pages of a host.

    Of pages with the same content, the one with the smallest digest of its html counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], tuple[int, list[int]]] = {}
            for host, page in zip(column(batch, "host"), column(batch, "html"), strict=True):
                root, name = parse(page), _signed(xxhash.xxh64_intdigest(page))
                content = _signed(xxhash.xxh64_intdigest(text_of(root)))
                if (host, content) not in seen or name < seen[host, content][0]:
                    seen[host, content] = name, [_signed(d) for d in template_candidates(root)]
            names, digests = zip(*seen.values(), strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64()), pa.array(names, pa.int64()), pa.array(digests, pa.list_(pa.int64()))], ["host", "content", "name", "digests"])

    found = pages.mapInArrow(run, "host string, content long, name long, digests array<long>")
    different = stored(found.groupBy("host", "content").agg(F.min_by("digests", "name").alias("digests")), "different-pages")
    sizes = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    often = different.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return often.join(sizes, "host").where(F.col("n") >= least_share * F.col("pages")).select("host", "digest")


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = stored(recurring(rows), "templates")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    schema = "page_id long, url string, text string, n_chars long"

    def give(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column(batch, "page_id"), pa.int64()), pa.array(column(batch, "url"), pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=arrow)

    found = templates.collect() if templates.count() <= broadcast_rows else None
    if found is not None:
        by_host: dict[str, set[int]] = {}
        for r in found:
            by_host.setdefault(r["host"], set()).add(r["digest"] % (1 << 64))
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def by_broadcast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none: set[int] = set()
            for batch in batches:
                yield give(batch, [main_text(p, sent.value.get(h, none)) for h, p in zip(column(batch, "host"), column(batch, "html"), strict=True)])

        return rows.mapInArrow(by_broadcast, schema)

    # Few or many templates of a host stand in one row for it, repeated for each salt, so hot hosts spread.
    lists = templates.groupBy("host").agg(F.collect_list("digest").alias("digests")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def by_join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = (column(batch, "digests"), column(batch, "html"))
            yield give(batch, [main_text(p, {d % (1 << 64) for d in ds or ()}) for ds, p in zip(*names, strict=True)])

    return salted.join(lists, ["host", "salt"], "left").mapInArrow(by_join, schema)
