"""Main text of web pages by site template removal.

Pages are parsed to a tree of elements (open paragraphs, list items and cells end where HTML ends them), in time linear in their length. Every element has two
hashes: ``exact``, of its subtree's tags and texts, and ``loose``, of its tag, class and id and those of the elements below it, without any text, with
equal neighbours counted once, so that a menu or an advert whose words change, or a list that grows, keeps its hash. Spark counts on how many distinct pages of
a host each hash stands; pages of the same content are one. Exact hashes on ``share`` of a host's pages, loose ones on ``loose_share``, and both on ``least``
pages or more, are its template. Where nothing marks the article, the place (path of tags, classes and ids) that holds over half of the
text on ``loose_share`` of the host's pages is its content.

A page's content is its article or main element, else the host's content place, else the innermost container with over half of the page's text. An
exact template subtree goes wherever it stands, but for plain text blocks (paragraphs, headings, items, cells) of a marked article or the host's content place,
which keep a paragraph that many pages share. Inside a marked article it also needs a name that supports it, or to hold no paragraph or heading, be no list, table or figure, and have
its structure on ``loose_share`` of the pages: a table that a tenth of the articles share is theirs. A loose template subtree goes outside of the content, and inside it if a name supports it or, where nothing marks
the article, if it has a class or id, and no paragraph or heading. The content itself and what it stands in never go. What an element says about itself decides the rest: scripts, styles and
forms never count; navigation, side and foot elements, roles and plain names ("comments", "cookie") go; names that may mean other things ("related", "notice") go outside of
the content, and inside only with the template's support or on a host without template; a name never removes half of the content. Outside of a marked article, a
host with a template keeps paragraphs and headings that are not template, a host without one keeps nothing.

Templates are at most (subtrees a page / share) hashes a host; pages are joined to them by host: broadcast if the written table holds at most ``BROADCAST`` hashes, else merged with
skewed hosts split. Of pages of one content, the one of least hash of its html counts. Defined results: null or empty html has the empty text; pages without a host, and hosts of fewer than ``least`` distinct pages, have no template;
an empty table has no rows; an own column of the name ``out`` is replaced.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked, written

#: HTML's elements by what they mean for the text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template form iframe svg math button select option textarea canvas object head title xmp noembed noframes audio video".split())
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
TEXT_BLOCKS = PROSE | frozenset("li dt dd td th figcaption".split()) | INLINE
NO_CONTAINERS = TEXT_BLOCKS | frozenset("ul ol dl table thead tbody tfoot tr figure hgroup header".split())
WHOLE = frozenset("# html body article main".split())
#: A start tag ends an open one of these, unless an element of the second set stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names that say what an element is, and those that may say it; words that may stand beside them.
PLAIN_NAMES = frozenset("navbar navigation footer sidebar ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs comment comments commentlist respond disqus pagination pager masthead".split())
VAGUE_NAMES = frozenset("nav menu aside promo promotion sponsor banner notice notices notification popup modal overlay subscribe subscription signup share sharing social related recommended recommendations reply replies discussion widget login toolbar".split())
BESIDE = frozenset("site page main global top bottom left right upper lower box block list area wrap wrapper container inner outer section item items bar links link slot unit group header footer body form panel thread primary secondary".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"[\s\xa0]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How sure it is that an element is no content, by its tag or role, by a plain name, by a vague name.
SURE, PLAIN, VAGUE, NO = 3, 2, 1, 0


class Node:
    __slots__ = ("article", "exact", "index", "label", "loose", "main", "marked", "never", "own", "parts", "prose", "said", "shape", "size", "tag", "up")

    def __init__(self, tag: str, index: int, up: int, label: str, never: bool, said: int, article: bool, main: bool):
        self.tag, self.index, self.up, self.label, self.never, self.said, self.article, self.main = tag, index, up, label, never, said, article, main
        self.parts: list[str] = []
        self.shape: list[str] = []
        self.own = self.size = self.exact = self.loose = 0
        self.marked = len(label) > len(tag)
        self.prose = tag in PROSE


def named(value: str) -> int:
    """What a class or id says: whole names only, of which every word is one of the known ones."""
    said = NO
    for token in value.split():
        parts = [x.lower() for x in NAME.findall(token)]
        if parts and all(x in PLAIN_NAMES or x in VAGUE_NAMES or x in BESIDE for x in parts):
            said = max(said, PLAIN if any(x in PLAIN_NAMES for x in parts) else VAGUE if any(x in VAGUE_NAMES for x in parts) else NO)
    return said


def read_attributes(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """(label: tag with class and id, numbers of several digits left out; how sure it says that it is no content)."""
    said = SURE if tag in BOILERPLATE or tag == "header" and not in_article else NO
    if not attributes or attributes.isspace():
        return tag, said
    label = tag
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            label += "." + " ".join(sorted(re.sub(r"\d\d+", "", value).split()))
            said = max(said, named(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            said = SURE
    return label, NO if tag in WHOLE else said


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(elements in page order, (innermost element, text) or (-1 for a block's edge, "") in page order)."""
    nodes, flow = [Node("#", 0, 0, "#", False, NO, False, False)], []
    stack = [nodes[0]]
    open_at: dict[str, list[int]] = {}
    blocks = [0]
    out_from: list[int] = []  # places in the stack of elements that aren't content

    def close(upto: int) -> None:
        while len(stack) > upto:
            n = stack.pop()
            open_at[n.tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            if out_from and out_from[-1] == len(stack):
                out_from.pop()
            n.size += n.own
            up = stack[-1]
            if not n.never:
                n.exact = xxhash.xxh64_intdigest("\0".join([n.tag, *n.parts])) - (1 << 63)
                n.loose = xxhash.xxh64_intdigest("\0".join([n.label, *n.shape]), 1) - (1 << 63)
                up.parts.append(str(n.exact))
                up.size += n.size
                up.prose = up.prose or n.prose and bool(n.size)
                if n.size and n.tag not in INLINE and (not up.shape or up.shape[-1] != str(n.loose)):
                    up.shape.append(str(n.loose))
            if n.tag not in INLINE:
                flow.append((-1, ""))

    def text(raw: str) -> None:
        if raw:
            body = entities.unescape(raw)
            flow.append((stack[-1].index, body))
            if tidy := SPACE.sub(" ", body).strip():
                stack[-1].parts.append(tidy)
                stack[-1].own += len(tidy)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_at[tag][-1] if open_at.get(tag) else 0
            if depth and not (tag in INLINE and blocks[-1] > depth):
                close(depth)
            elif tag not in INLINE:
                flow.append((-1, ""))
            continue
        if tag in ("article", "main") and out_from:  # an element left open before the article doesn't hold it
            close(out_from[0])
        if tag in ENDS_P and open_at.get("p") and open_at["p"][-1] == blocks[-1]:
            close(blocks[-1])
        if tag in IMPLIED:
            ended, edge = IMPLIED[tag]
            floor = max((open_at[t][-1] for t in edge if open_at.get(t)), default=0)
            above = [open_at[t][i] for t in ended if open_at.get(t) and (i := bisect_right(open_at[t], floor)) < len(open_at[t])]
            if above:
                close(min(above))
        if tag not in INLINE:
            flow.append((-1, ""))
        elif tag == "br":
            flow.append((stack[-1].index, "\n"))
        if tag in VOID:
            continue
        up = stack[-1]
        label, said = read_attributes(tag, m[3], up.article or up.main)
        n = Node(tag, len(nodes), up.index, label, up.never or tag in NEVER, said, up.article or tag == "article", up.main or tag == "main")
        nodes.append(n)
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        if said == SURE or n.never and not up.never:
            out_from.append(len(stack))
        stack.append(n)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    close(1)
    nodes[0].size += nodes[0].own
    return nodes, flow


def in_marked(n: Node) -> bool:
    return n.article or n.main


def heaviest(nodes: list[Node], gone: list[bool]) -> int:
    """The innermost container with over half of the text that isn't gone; the root where none has."""
    weight = [0 if g else n.own for n, g in zip(nodes, gone, strict=True)]
    for n in reversed(nodes[1:]):
        weight[n.up] += weight[n.index]
    at = 0
    for n in nodes[1:]:
        if n.up == at and n.tag not in NO_CONTAINERS and not gone[n.index] and 2 * weight[n.index] > weight[0]:
            at = n.index
    return at


def places(nodes: list[Node]) -> list[int]:
    """A hash of each element's path of labels."""
    out = [0]
    for n in nodes[1:]:
        out.append(xxhash.xxh64_intdigest(f"{out[n.up]}\0{n.label}", 2) - (1 << 63))
    return out


def dropped(nodes: list[Node], least: int) -> list[bool]:
    """Elements that never count or that say so with certainty ``least`` (a name not for over half of the text), and what is below them."""
    gone = [False] * len(nodes)
    for n in nodes[1:]:
        gone[n.index] = gone[n.up] or n.never or n.said == SURE or n.said >= least and 2 * n.size <= nodes[0].size
    return gone


def subtrees(page: str) -> tuple[int, set[int], set[int]]:
    """(hash of the content; exact hashes of subtrees that may be template; loose ones, and the place of the content where nothing marks it)."""
    nodes, _ = parse(page)
    gone = dropped(nodes, PLAIN)
    roots = [n for n in nodes[1:] if in_marked(n) and not in_marked(nodes[n.up]) and not gone[n.index]]
    exact, loose = set(), set()
    if roots:
        content = xxhash.xxh64_intdigest("\0".join(str(n.exact) for n in roots)) - (1 << 63)
    else:
        i = heaviest(nodes, gone)
        content = nodes[i].exact if i else xxhash.xxh64_intdigest("\0".join(nodes[0].parts)) - (1 << 63)
        if nodes[i].tag not in WHOLE:
            loose.add(places(nodes)[i])
    for n in nodes[1:]:
        if n.size and not n.never and n.tag not in WHOLE:
            if not (in_marked(n) and n.tag in TEXT_BLOCKS):
                exact.add(n.exact)
            if n.marked or n.tag not in TEXT_BLOCKS:
                loose.add(n.loose)
    return content, exact, loose


def removal(nodes: list[Node], template: frozenset[int]) -> tuple[list[bool], bool, list[bool]]:
    """(elements without their text; whether an article or main element marks the content; elements inside the content)."""
    out = dropped(nodes, PLAIN)
    held = [in_marked(n) and not out[n.index] for n in nodes]
    marked, at = any(held), []
    if not marked and template:
        at = [p in template for p in places(nodes)]
        for n in nodes[1:]:
            held[n.index] = held[n.up] or at[n.index] and not out[n.index]
    gone = [False] * len(nodes)
    for n in nodes[1:]:
        mine = n.exact in template and n.tag not in WHOLE and not (n.tag in TEXT_BLOCKS and held[n.index]) and not (at and at[n.index])
        if mine and marked and held[n.index]:
            mine = n.said > NO or n.loose in template and not n.prose and n.tag not in NO_CONTAINERS
        gone[n.index] = gone[n.up] or n.never or mine
    out = [a or b for a, b in zip(out, gone, strict=True)]
    free = [n for n in nodes[1:] if not out[n.index]]
    if marked:
        roots = [n.index for n in free if n.tag == "article" and not nodes[n.up].article] or [n.index for n in free if n.tag == "main" and not nodes[n.up].main]
        marked = bool(roots)
    else:
        roots = [n.index for n in free if at and at[n.index]]
    roots = roots or [heaviest(nodes, out)]
    inside, around = [False] * len(nodes), [False] * len(nodes)
    for i in roots:
        inside[i] = True
        while i and not around[i]:
            around[i] = True
            i = nodes[i].up
    around[0] = True
    inside[0] = 0 in roots
    for n in nodes[1:]:
        inside[n.index] = inside[n.index] or inside[n.up]
    whole = sum(nodes[i].size for i in roots)
    for n in nodes[1:]:
        i = n.index
        if gone[n.up]:
            gone[i] = True
        if gone[i] or around[i] or n.tag in WHOLE:
            continue
        recurs = n.loose in template and (n.marked or n.tag not in TEXT_BLOCKS)
        if inside[i]:
            small = 2 * n.size <= whole
            unnamed = recurs and not marked and n.marked and not n.prose and n.tag not in NO_CONTAINERS
            gone[i] = n.said == SURE or small and (n.said == PLAIN or n.said == VAGUE and (recurs or not template) or unnamed)
        else:
            gone[i] = n.said > NO or recurs or marked and not template
    return gone, marked, inside


def main_text(page: str, template: frozenset[int]) -> str:
    """The blocks of the page that are its text, one a line."""
    nodes, flow = parse(page)
    gone, marked, inside = removal(nodes, template)
    keep = [False] * len(nodes)
    prose = [False] * len(nodes)
    for n in nodes:
        prose[n.index] = n.tag in PROSE or n.tag in INLINE and prose[n.up]
        keep[n.index] = not gone[n.index] and (inside[n.index] or not marked or prose[n.index] and bool(template))
    blocks, run = [], []
    for i, body in [*flow, (-1, "")]:
        if i < 0:
            if run and (block := SPACE.sub(" ", "".join(run)).strip()):
                blocks.append(block)
            run = []
        elif keep[i]:
            run.append(body)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: The hash under which each page counts itself, and the most hashes of templates that are broadcast (32 MB).
PAGE, BROADCAST = 0, 4_000_000


def subtree_counts(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hash, is_loose, n): distinct pages of the host with the hash; under PAGE all of them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda sets: pa.ListArray.from_arrays(pa.array([0, *_running(map(len, sets))], pa.int32()), pa.array([h for s in sets for h in s], pa.int64()))
        for b in batches:
            found = [subtrees(x or "") for x in b.column(1).to_pylist()]
            own = [b.column(0), b.column(2), pa.array([f[0] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, lists([[PAGE, *sorted(f[1])] for f in found]), lists([sorted(f[2]) for f in found])], ["host", "page", "content", "exact", "loose"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"), F.xxhash64(html).alias("page")).where(F.col("host").isNotNull())
    rows = rows.mapInArrow(hashes, "host string, page bigint, content bigint, exact array<bigint>, loose array<bigint>")
    distinct = rows.groupBy("host", "content").agg(F.min_by(F.struct("exact", "loose"), "page").alias("s")).select("host", "s.exact", "s.loose")
    one = lambda c, flag: F.transform(c, lambda h: F.struct(h.alias("hash"), F.lit(flag).alias("is_loose")))
    each = distinct.select("host", F.explode(F.concat(one("exact", False), one("loose", True))).alias("x")).select("host", "x.*")
    return each.groupBy("host", "hash", "is_loose").agg(F.count("*").alias("n"))


def _running(sizes: Iterator[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def site_templates(pages: DataFrame, *, url: str = "url", html: str = "html", share: float = 0.1, loose_share: float = 0.5, least: int = 3) -> DataFrame:
    """(host, template array<bigint>): the hashes on ``share`` (loose ones: ``loose_share``) of a host's distinct pages, and ``least`` pages, or more."""
    counts = written(subtree_counts(pages, url=url, html=html).where(F.col("n") >= least), "subtrees")
    sizes = counts.where((F.col("hash") == PAGE) & ~F.col("is_loose")).select("host", F.col("n").alias("pages"))
    enough = F.col("n") >= F.when(F.col("is_loose"), loose_share).otherwise(share) * F.col("pages")
    return counts.where((F.col("hash") != PAGE) | F.col("is_loose")).join(sizes, "host").where(enough).groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("template"))


def with_main_text(pages: DataFrame, *, url: str = "url", html: str = "html", out: str = "main_text", share: float = 0.1, loose_share: float = 0.5, least: int = 3, broadcast: int = BROADCAST) -> DataFrame:
    """pages with their main text in column ``out``."""
    templates = written(site_templates(pages, url=url, html=html, share=share, loose_share=loose_share, least=least), "templates")
    held = templates.agg(F.coalesce(F.sum(F.size("template") + 8), F.lit(0)).alias("n")).collect()[0]["n"]
    templates = templates.hint("broadcast" if held <= broadcast else "merge")

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, frozenset[int]] = {}
        for texts, lists in batches:
            result = []
            for x, t in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                key = tuple(t or ())
                if key not in known:
                    known.clear() if len(known) > 1000 else None
                    known[key] = frozenset(key)
                result.append(main_text(x, known[key]) if x else "")
            yield pa.array(result, pa.string())

    rows = pages.select(F.struct("*").alias("page"), host_of(F.col(url)).alias("at"))
    joined = rows.join(templates, F.col("at") == F.col("host"), "left")
    return unpacked(joined.withColumn("found", extract(F.col("page").getField(html), F.col("template"))), "page", pages.columns, {out: F.col("found")})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return with_main_text(pages.select("page_id", "url", "html"), out="text").select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
