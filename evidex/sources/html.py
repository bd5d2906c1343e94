"""HTML pages: title, description, author, thumbnail, language, JSON-LD scripts and main text, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.urls import public_url
from evidex.shared import in_slices

from . import jsonld

#: Elements, roles and names that aren't part of the main text.
HIDDEN_TAGS = frozenset("script style noscript nav header footer aside form svg iframe".split())
HIDDEN_ROLES = frozenset(("navigation", "banner", "complementary"))
HIDDEN_NAMES = re.compile(r"(?:^|[\s_-])(ads?|advertisement|advert|menu|cookie|social-share)(?:$|[\s_-])", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FIELDS = [("title", pa.string()), ("description", pa.string()), ("author", pa.string()), ("thumbnail", pa.string()), ("language", pa.string()), ("scripts", pa.list_(pa.string())), ("main_text", pa.string())]
SCHEMA = "struct<title:string,description:string,author:string,thumbnail:string,language:string,scripts:array<string>,main_text:string>"


class Page(HTMLParser):
    """Collects metadata, JSON-LD and text pieces; ``open`` has the tags that are open, ``hidden`` how many of them hide their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.count: dict[str, int] = {}
        self.hidden = 0
        self.meta: dict[tuple[str, str], str] = {}
        self.language: str | None = None
        self.title: list[str] | None = None
        self.scripts: list[str] = []
        self.pieces: dict[str, list[str]] = {"main": [], "article": [], "body": [], "": []}
        self.json_ld = False
        #: Of each kind of element that may hold the main text, the depth of the first one while it is open; those that were seen.
        self.inside: dict[str, int] = {}
        self.seen: set[str] = set()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and self.language is None and a.get("lang", "").strip():
            self.language = a["lang"].strip()
        if tag == "meta":
            for kind in ("property", "name"):
                if a.get(kind):
                    self.meta.setdefault((kind, a[kind]), a.get("content", ""))
        if tag == "script":
            self.json_ld = a.get("type", "").lower().startswith("application/ld+json")
            if self.json_ld:
                self.scripts.append("")
        if tag in VOID:
            return
        hides = tag in HIDDEN_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in HIDDEN_ROLES or bool(HIDDEN_NAMES.search(a.get("class", "") + " " + a.get("id", "")))
        if tag == "title" and self.title is None:
            self.title = []
            self.inside["title"] = len(self.open)
        if tag in ("main", "article", "body") and tag not in self.seen and not hides and not self.hidden:
            self.seen.add(tag)
            self.inside[tag] = len(self.open)
        self.open.append((tag, hides))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += hides

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        while True:
            name, hides = self.open.pop()
            self.count[name] -= 1
            self.hidden -= hides
            if name == tag:
                break
        for kind in [k for k, depth in self.inside.items() if len(self.open) <= depth]:
            del self.inside[kind]

    def handle_data(self, data):
        if self.json_ld and self.open and self.open[-1][0] == "script":
            self.scripts[-1] += data
        text = data.strip()
        if not text:
            return
        if "title" in self.inside:
            self.title.append(text)
        if self.hidden:
            return
        for kind in ("main", "article", "body"):
            if kind in self.inside:
                self.pieces[kind].append(text)
        self.pieces[""].append(text)

    def named(self, *names: str) -> str | None:
        """The content of the first name that has one; the first tag by property goes before those by name."""
        for name in names:
            value = self.meta.get(("property", name), self.meta.get(("name", name)))
            if value and value.strip():
                return value
        return None

    def result(self) -> dict:
        kind = next((k for k in ("main", "article", "body") if k in self.seen), "")
        return {
            "title": self.named("og:title") or " ".join(self.title or ()) or None,
            "description": self.named("og:description", "description"),
            "author": self.named("author", "article:author"),
            "thumbnail": self.named("og:image"),
            "language": self.language,
            "scripts": self.scripts,
            "main_text": "\n".join(self.pieces[kind]) or None,
        }


#: Elements whose text holds no references, whole, and ampersands outside of them with the reference that they begin, if its semicolon is there.
AMPERSAND = re.compile(r"(?is)<(script|style|xmp|iframe|noembed|noframes)\b.*?(?:</\1\b|\Z)|&(?:(#[0-9]+;|#x[0-9a-f]+;)|([a-z][a-z0-9]*;))?")


def closed_references(html: str) -> str:
    """A page in which an ampersand without a known reference and its semicolon stands for itself, as in XML; HTML reads some old names without one."""
    return AMPERSAND.sub(lambda m: m[0] if m[1] or m[2] or m[3] in html5 else "&amp;" + m[0][1:], html)


def read_page(html: str | None, closed: bool = False) -> dict:
    page = Page()
    page.feed(closed_references(html or "") if closed else html or "")
    page.close()
    return page.result()


def extract(pages: DataFrame, *, html: str = "html", out: str = "page", closed: bool = False) -> DataFrame:
    """pages with a struct ``out``: SCHEMA, the main element's text being that of main, else article, else body, else all; thumbnails keep their public form only. ``closed``: only references with a semicolon count."""

    @F.arrow_udf(SCHEMA)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield in_slices(texts, lambda x: read_page(x, closed), pa.struct(FIELDS))

    return pages.withColumn(out, parse(F.col(html))).withColumn(out, F.col(out).withField("thumbnail", public_url(F.col(f"{out}.thumbnail"))))


def evidence(pages: DataFrame, *, html: str = "html", out: str = "page") -> DataFrame:
    """pages with ``out`` as ``extract`` gives it and recipes, warnings and status (partial where a script couldn't be read) beside it."""
    rows = extract(pages, html=html, out=out).withColumn("_read", jsonld.found(F.col(f"{out}.scripts")))
    read = F.col("_read")
    more = F.struct(F.col(f"{out}.*"), read["recipes"].alias("recipes"), jsonld.page_warnings(read).alias("warnings"), jsonld.page_status(read).alias("status"))
    return rows.withColumn(out, more).drop("_read")
