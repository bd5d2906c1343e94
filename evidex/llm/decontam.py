"""Benchmark decontamination with suffix arrays over the training words.

Tasks read the training texts in blocks ("shards") of at most ``SHARD`` words and sort each shard's word suffixes by prefix doubling, as deep as the
longest benchmark item. Every suffix of every item is binary-searched in every shard: the interval of equal first words narrows
word by word until it is empty, which gives the suffix's longest verbatim match and where it lies; the intervals at the window's length
hold all places of that window. Documents never cross: each ends in a symbol of its own, and a document longer than a shard is cut
with an overlap of the longest item. The benchmark reaches the tasks in chunks of about ``CHUNK`` bytes at most (or one longer item), dealt by a hash of the
item, and the driver and the tasks hold one chunk at a time: each is one pass over the texts whose hits are written by text hash, and a last pass joins them to the rows.
A benchmark of one chunk, which is the usual case, takes one pass and no shuffle.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters above U+007F, compared by 64-bit hashes. A window is ``window``
consecutive words of an item; a shorter item, unless empty, is one window. Defined results: null or wordless texts have no words
and are clean; items without words never occur; items of equal id count once, a null id as one; repeated rows get equal results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_bytes, unpacked, written

WINDOW, SHARD, CHUNK, SEGMENT = 10, 400_000, 4 << 20, 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols of words lie below ENDS; above are the ends of up to 2^20 documents of a shard.
ENDS = (1 << 32) - (1 << 20)
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, one for each byte of a segment."""
    if not _POWERS:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(SEGMENT + 1, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def hash_segment(raw: np.ndarray, is_start: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of the words of at most SEGMENT bytes, given where words start and end."""
    up, down = powers()
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return starts, h ^ (h >> np.uint64(29))


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text) of the texts at offsets ``at`` of body."""
    lo, hi = int(at[0]), int(at[-1])
    raw = body[lo:hi]
    inside = IS_WORD[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at - lo] = True
    is_start, is_end = inside.copy(), inside.copy()
    is_start[1:] &= ~inside[:-1] | cut[1:-1]
    is_end[:-1] &= ~inside[1:] | cut[1:-1]
    found, place = [], []
    begin = 0
    while begin < len(raw):
        end = min(begin + SEGMENT, len(raw))
        if end < len(raw) and inside[end - 1] and not is_end[end - 1]:  # a word goes on: end before it
            back = np.flatnonzero(is_end[begin:end])
            if len(back):
                end = begin + int(back[-1]) + 1
            else:
                first = begin + int(np.flatnonzero(is_start[begin:end])[0])
                stop = first + int(np.flatnonzero(is_end[first:])[0]) + 1
                if stop - first > SEGMENT:  # such a word has a hash of its own kind wherever it stands
                    place.append(np.array([first]))
                    found.append(np.array([long_hash(bytes(LOWER[raw[first:stop]]))], np.uint64))
                    first = stop
                begin = first
                continue
        s, h = hash_segment(raw[begin:end], is_start[begin:end], is_end[begin:end])
        place.append(s + begin)
        found.append(h)
        begin = end
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    s = np.concatenate(place) if place else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(s, at - lo))


def long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def symbols(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(ENDS)).astype(np.uint64)


@dataclass(frozen=True)
class Items:
    """Benchmark words one after another: full hashes, symbols, each word's item and the words from it to its item's end."""

    ids: list
    full: np.ndarray
    symbol: np.ndarray
    item: np.ndarray
    left: np.ndarray
    whole: np.ndarray
    #: Chunks of the benchmark in all.
    chunks: int = 1

    @classmethod
    def of(cls, ids: list, texts: list[str | None], chunks: int = 1) -> Items:
        body, at = text_bytes(pa.array(texts, pa.large_string()))
        h, n = words(body, at)
        item = np.repeat(np.arange(len(ids)), n)
        left = np.concatenate([np.arange(k, 0, -1) for k in n]) if len(h) else np.zeros(0, np.int64)
        return cls(ids, h, symbols(h), item, left.astype(np.int64), np.repeat(n, n), chunks)

    @property
    def longest(self) -> int:
        return int(self.left.max(initial=1))


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes of s by their first ``depth`` symbols at least, sorted keys of their first two)."""
    n = len(s)
    following = np.append(s[1:], np.uint64((1 << 32) - 1))
    key = (s << np.uint64(32)) | following
    order = np.argsort(key)
    first = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = first[1:] != first[:-1]
    heads = np.flatnonzero(fresh)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[n] = n
    reach = 2
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places in order that still share their key
    while reach < depth and len(open_):
        at = order[open_]
        second = rank[np.minimum(at + reach, n)]
        by = np.argsort((rank[at] << 32) | second)
        at, keys = at[by], ((rank[at] << 32) | second)[by]
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(fresh)
        rank[at] = np.repeat(open_[heads], np.diff(np.append(heads, len(at))))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        reach *= 2
    return order, first


def narrow(s: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the intervals whose suffixes have ``symbol`` after ``depth`` equal ones, all by one binary search in step."""

    def edge(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) // 2
            at = order[mid] + depth
            seen = s[np.minimum(at, len(s) - 1)]
            less = seen <= symbol[live] if right else seen < symbol[live]
            less &= at < len(s)
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)

    return edge(False), edge(True)


def search(s: np.ndarray, full: np.ndarray, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: (order, item word, lo, hi) of all windows that occur, and each item word's longest match and one place of it, as rows (length, place)."""
    order, first = suffix_array(s, items.longest)
    shift = np.uint64(32)
    two = items.left > 1
    following = np.append(items.symbol[1:], np.uint64(0))
    low = items.symbol << shift
    lo = np.searchsorted(first, np.where(two, low | following, low), side="left")
    hi = np.where(two, np.searchsorted(first, low | following, side="right"), np.searchsorted(first, low + (np.uint64(1) << shift), side="left"))
    need = np.where(items.whole < window, items.whole, window)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.zeros((len(lo), 2), np.int64)
    live = np.flatnonzero(lo < hi)
    lo, hi = lo[live], hi[live]
    depth = 2
    while len(live):
        reached = np.minimum(items.left[live], depth)
        best[live, 0], best[live, 1] = reached, order[lo]
        done = (need[live] == reached) & (items.left[live] >= need[live])
        found.append((live[done], lo[done], hi[done]))
        more = items.left[live] > depth
        live, lo, hi = live[more], lo[more], hi[more]
        if len(live):
            lo, hi = narrow(s, order, lo, hi, depth, items.symbol[live + depth])
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
        depth += 1
    w, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return order, w, a, b, best


@dataclass
class Found:
    n_words: np.ndarray
    hit: np.ndarray
    pairs: list[np.ndarray]
    best: list[np.ndarray]


def scan_unit(h: np.ndarray, n: np.ndarray, items: Items, window: int) -> Found:
    """Searches a run of whole documents with n words each; one longer than SHARD words is cut with an overlap."""
    doc = np.repeat(np.arange(len(n)), n)
    hit = np.zeros(len(h), bool)
    first = np.cumsum(n) - n
    pairs, longest = [], []
    step = max(SHARD, 4 * items.longest)
    for begin in range(0, max(len(h), 1), step):
        end = min(len(h), begin + step + items.longest)
        if begin == end or not len(items.symbol):
            break
        d = doc[begin:end]
        # Each document's words and then its own end symbol.
        place = np.arange(end - begin) + (d - d[0])
        s = np.empty(len(d) + int(d[-1] - d[0]) + 1, np.uint64)
        ends = np.ones(len(s), bool)
        ends[place] = False
        s[place] = symbols(h[begin:end])
        s[ends] = np.uint64(ENDS) + (np.arange(int(ends.sum())) % (1 << 20)).astype(np.uint64)
        back = np.full(len(s), -1, np.int64)
        back[place] = np.arange(begin, end)
        order, w, lo, hi, best = search(s, h[begin:end], items, window)
        size = np.where(items.whole[w] < window, items.whole[w], window)
        for chunk in _chunks(hi - lo):
            which = np.repeat(chunk, (hi - lo)[chunk])
            at = back[order[np.arange(len(which)) - np.repeat(np.cumsum((hi - lo)[chunk]) - (hi - lo)[chunk], (hi - lo)[chunk]) + lo[which]]]
            same = np.ones(len(at), bool)
            for k in range(int(size[which].max(initial=0))):  # the exact check, by full hashes
                inside = k < size[which]
                same &= ~inside | (h[np.minimum(at + k, len(h) - 1)] == items.full[np.minimum(w[which] + k, len(items.full) - 1)])
            at, which = at[same], which[same]
            mark = np.zeros(end - begin + 1, np.int64)
            np.add.at(mark, at - begin, 1)
            np.add.at(mark, at - begin + size[which], -1)
            hit[begin:end] |= np.cumsum(mark[:-1]) > 0
            pairs.append(np.unique(doc[at] * len(items.ids) + items.item[w[which]]))
        matched = np.flatnonzero(best[:, 0] > 0)
        at = back[best[matched, 1]]
        longest.append(np.stack([matched, best[matched, 0], doc[at], at - first[doc[at]]], 1))
    return Found(n, hit, pairs, longest)


def _chunks(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Runs of indices whose sizes sum to ``most`` or little more."""
    if len(sizes):
        yield from (x for x in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1) if len(x))


def units(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a shard's bytes, or one longer text."""
    begin = 0
    while begin < len(at) - 1:
        end = int(np.searchsorted(at, at[begin] + 6 * SHARD, side="right")) - 1
        end = min(len(at) - 1, max(begin + 1, end), begin + (1 << 19))
        yield begin, end
        begin = end


def scan_texts(texts: pa.Array, items: Items, window: int) -> pa.Array:
    """RESULT of every text: its words, its maximal runs of hit words, and the positions in ``items`` of the items with occurring windows."""
    body, at = text_bytes(texts)
    out = []
    for begin, end in units(at):
        h, n = words(body, at[begin : end + 1])
        f = scan_unit(h, n, items, window)
        first = np.cumsum(n) - n
        edge = np.diff(np.concatenate([[0], f.hit.astype(np.int8), [0]]))
        owner = np.repeat(np.arange(len(n)), n)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: dict[int, list[dict]] = {}
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            while a < b:  # a run may go over a document's end
                d = int(owner[a])
                stop = min(b, int(first[d] + n[d]))
                spans.setdefault(d, []).append({"start": a - int(first[d]), "stop": stop - int(first[d])})
                a = stop
        names: dict[int, list[int]] = {}
        for p in np.unique(np.concatenate(f.pairs)).tolist() if f.pairs else []:
            names.setdefault(p // len(items.ids), []).append(p % len(items.ids))
        out += [{"n_words": k, "spans": spans.get(d, []), "items": names.get(d, [])} for d, k in enumerate(n.tolist())]
    return pa.array(out, ARROW)


ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.int32()))])


def item_chunks(benchmark: DataFrame, *, text: str, key: str, limit: int = CHUNK) -> Iterator[Items]:
    """The distinct items in chunks of about ``limit`` bytes at most (or one longer item), one after another; each in the order of their ids and texts."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    chunks = 1 if size <= limit else -(-2 * size // limit)  # twice as many as needed, so that no chunk of hashed items grows much over the limit
    for c in range(chunks):
        found = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(chunks)) == c).orderBy("k", "t").collect()
        yield Items.of([r["k"] for r in found], [r["t"] for r in found], chunks)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, item_start, words, doc, start): the longest verbatim match of every item suffix that has one, and one place of it (the least document, then start)."""
    kinds = [benchmark.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()]
    parts = []
    for items in item_chunks(benchmark, text=item_text, key=item_key):

        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                body, at = text_bytes(b.column(1))
                for lo, hi in units(at):
                    for rows in scan_unit(*words(body, at[lo : hi + 1]), items, WINDOW).best:
                        word, size, doc, start = rows.T
                        ids = pa.array([items.ids[i] for i in items.item[word]])
                        yield pa.RecordBatch.from_arrays([ids, pa.array(items.whole[word] - items.left[word]), pa.array(size), b.column(0).take(pa.array(doc + lo)), pa.array(start)], ["item", "item_start", "words", "doc", "start"])

        rows = docs.select(key, text).mapInArrow(find, f"item {kinds[0]}, item_start bigint, words bigint, doc {kinds[1]}, start bigint")
        best = rows.groupBy("item", "item_start").agg(F.min_by(F.struct("words", "doc", "start"), F.struct(-F.col("words"), "doc", "start")).alias("m")).select("item", "item_start", "m.*")
        parts.append(written(best, "longest"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _finder(items: Items, window: int, item_type: T.DataType) -> Callable[[Column], Column]:
    """A text's n_words, spans of hit words, and the ids of the items with occurring windows."""
    kind = to_arrow_type(item_type)

    @F.arrow_udf(f"struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<{item_type.simpleString()}>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = pa.array(items.ids, kind)
        for texts in batches:
            found = scan_texts(texts, items, window)
            places = found.field(2)
            yield pa.StructArray.from_arrays([found.field(0), found.field(1), pa.ListArray.from_arrays(places.offsets, ids.take(places.values))], ["n_words", "spans", "items"])

    return find


def _merged(spans: Column) -> Column:
    """Words in the union of spans of several chunks."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["upto"], s["start"]))).alias("n"), F.greatest(acc["upto"], s["stop"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def search_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_key: str = "item_id", item_text: str = "text", out: str = "found") -> DataFrame:
    """docs with a struct ``out``: n_words, n_hit, spans of hit words, item ids with occurring windows (distinct). An own column of that name is replaced."""
    kind = benchmark.schema[item_key].dataType
    rows = docs.select(F.struct("*").alias("row"))
    body = F.col("row").getField(text)
    parts: list[DataFrame] = []
    for items in item_chunks(benchmark, text=item_text, key=item_key):
        found = _finder(items, window, kind)(body)
        if items.chunks == 1:
            rows = rows.withColumn("f", found)
            break
        hits = rows.select(F.md5(F.coalesce(body, F.lit(""))).alias("h"), found.alias("f")).where(F.size("f.items") > 0)
        parts.append(written(hits.select("h", "f.spans", "f.items").dropDuplicates(["h"]), "hits"))
    if parts:
        hits = parts[0]
        for more in parts[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row a chunk at most
        counted = rows.withColumn("n", _finder(Items.of([], []), window, kind)(body)["n_words"]).withColumn("h", F.md5(F.coalesce(body, F.lit(""))))
        empty = [F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")]
        rows = counted.join(hits, "h", "left").select("row", F.struct(F.col("n").alias("n_words"), *empty).alias("f"))
    found = F.struct(F.col("f.n_words").alias("n_words"), _merged(F.col("f.spans")).alias("n_hit"), F.col("f.spans").alias("spans"), F.array_distinct("f.items").alias("items"))
    return unpacked(rows, "row", docs.columns, {out: found})


def decontaminate_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    rows = search_documents(docs.select("doc_id", "text"), benchmark).select("doc_id", "found")
    names = F.array_join(F.array_sort(F.transform("found.items", lambda i: F.coalesce(i.cast("string"), F.lit("null")))), ",")
    return rows.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without any word inside a benchmark window."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return search_documents(docs, benchmark, out=name).where(F.col(f"{name}.n_hit") == 0).drop(name)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS v
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win), spot AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS v
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
), hits AS (SELECT DISTINCT doc_id, i, size FROM spot SEMI JOIN win USING (v, size)
), marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS t(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM spot JOIN win USING (v, size)) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
