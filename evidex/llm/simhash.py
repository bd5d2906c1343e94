"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint takes each bit that is set in over half of its shingles' 64-bit hashes. Distinct fingerprints (copies of a text share one,
so a group of copies is one node) are linked where at most ``bits`` bits differ. The 64 bits form a ring of 8 segments. By the pigeonring
principle, two linked fingerprints have a start on the ring from which every run of l segments differs in at most l * bits / 8 bits; so the
leading segments are equal, and of the others, cut into one more group than may differ, one group is equal too. Each fingerprint is indexed under
these equal segments from each start; pairs that share a key must keep all of the chain's budgets before the full Hamming check.

A key shared by more than ``dense`` distinct fingerprints isn't paired up: its members emit their neighbours at half the distance, and two members are
within ``bits`` exactly if they share one (bits up to 2), so work grows with the members, not with their pairs. Components of links are found
by alternating star contraction over tables in the shared folder; nothing per document reaches the driver.

Defined results: null, empty or blank texts have fingerprint zero and link like any other; equal rows link; with fewer words than a shingle the whole
sequence is one; a component is named by its least doc_id (nulls last: a component of null ids only is null); an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes, unpacked, written

SEGMENTS, WIDTH = 8, 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LANES = np.uint64(0x0001000100010001)


def shingle_hashes(raw: np.ndarray, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased text's shingles of words, joined by single spaces."""
    word = ~IS_SPACE[raw]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    keep = word.copy()
    keep[ends[:-1]] = True  # one separator after each word but the last
    low = LOWER[raw[keep]]
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    low[(at[1:] - 1).astype(np.int64)] = 32
    body, stop = low.tobytes(), at + size
    k = min(shingle, len(at))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b], 42) for a, b in zip(at[: len(at) - k + 1].tolist(), stop[k - 1 :].tolist(), strict=True)), np.uint64, len(at) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero without any."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_535):
        part = hashes[lo : lo + 65_535]
        for i in range(16):
            packed = int(((part >> np.uint64(i)) & LANES).sum(dtype=np.uint64))
            for lane in range(4):
                count[16 * lane + i] += (packed >> (16 * lane)) & 0xFFFF
    return sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist())


def with_fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """docs with the SimHash of each whole text as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            body, at = text_bytes(texts)
            yield pa.array(np.array([fingerprint(shingle_hashes(body[a:b], shingle)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text)))


def budget(length: int, bits: int) -> int:
    """Bits that may differ in a viable run of so many segments."""
    return length * bits // SEGMENTS


def segment(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def key_masks(bits: int) -> list[tuple[int, int]]:
    """(start, mask of the bits that a viable chain from there has equal) of every key."""
    length = SEGMENTS - 1
    lead = next((n for n in range(length, 0, -1) if budget(n, bits) == 0), 0)
    groups = np.array_split(np.arange(lead, length), budget(length, bits) + 1) if budget(length, bits) else [np.arange(lead, length)]
    out = []
    for start in range(SEGMENTS):
        for g in groups:
            out.append((start, sum(255 << (WIDTH * ((start + i) % SEGMENTS)) for i in (*range(lead), *g.tolist()))))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def viable(a: Column, b: Column, start: Column, bits: int) -> Column:
    """Whether every run of segments from ``start`` keeps its budget."""
    x = a.bitwiseXOR(b)
    turned = F.shiftrightunsigned(x, 0)
    for s in range(1, SEGMENTS):
        turned = F.when(start == s, F.shiftrightunsigned(x, WIDTH * s).bitwiseOR(F.shiftleft(x, 64 - WIDTH * s))).otherwise(turned)
    ok = F.lit(True)
    for length in range(1, SEGMENTS):
        ok = ok & (F.bit_count(turned.bitwiseAND(F.lit(_signed((1 << (WIDTH * length)) - 1)))) <= budget(length, bits))
    return ok


def links(prints: DataFrame, *, bits: int = 2, dense: int = 32) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints of column ``fp`` that connect all those at most ``bits`` apart."""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    masks = key_masks(bits)
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for n, (_, m) in enumerate(masks)])
    indexed = prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.n", "x.k")
    sizes = indexed.groupBy("n", "k").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = written(indexed.join(sizes, ["n", "k"]), "simhash-keys")

    members = shared.where(F.col("size") <= dense).groupBy("n", "k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    first = members.select("n", "m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("n", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    start = F.get(F.array(*[F.lit(s) for s, _ in masks]), F.col("n"))
    checked = pairs.where(viable(F.col("a"), F.col("b"), start, bits)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")

    crowded = shared.where(F.col("size") > dense).select("fp").distinct()
    ball = F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))
    near = crowded.select("fp", F.explode(ball).alias("x"))
    if bits == 1:  # only neighbours that occur themselves
        near = near.join(crowded.select(F.col("fp").alias("x")), "x", "left_semi").withColumn("hub", F.col("x"))
        near = near.where(F.col("hub") != F.col("fp"))
    else:
        near = near.withColumn("hub", F.min("fp").over(Window.partitionBy("x"))).where(F.col("hub") < F.col("fp"))
    return checked.unionByName(near.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of every linked node's component, by alternating large-star and small-star contraction.

    Every star is a table of its own: in one plan with the next it would be planned, and its text kept by the driver, four times.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        near = e.select(F.inline(ends)) if large else e.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.where(F.col("v") > F.col("u")) if large else near
        joined = moved.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            joined = joined.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return joined.where("a < b").distinct()

    sign = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    edges = written(edges, "links")
    last = sign(edges)
    while last["n"]:
        edges = written(star(written(star(edges, True), "stars"), False), "links")
        now = sign(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(key, text_hash, fingerprint bigint, component, first): a component is the least key that links reach, ``first`` whether a row is that one (by key, then text hash)."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    rows = written(with_fingerprint(named, text="t", out="fp", shingle=shingle).select("id", F.xxhash64("t").alias("h"), "fp"), "simhash")
    prints = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h")).alias("least"))
    roots = components(links(prints, bits=bits))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    named = written(named.join(least, "root").select("fp", "first"), "simhash-components")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    return rows.join(named, "fp").select(F.col("id").alias(key), F.col("h").alias("text_hash"), F.col("fp").alias("fingerprint"), F.col("first.id").alias("component"), own.alias("first"))


def component_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row of docs of each component: the one with the least key, then the least text hash; of equal ones that with the least hash of its columns."""
    return keep_first(docs, near_duplicates(docs, key=key, text=text, shingle=shingle, bits=bits), key=key, text=text)


def keep_first(docs: DataFrame, found: DataFrame, *, key: str, text: str) -> DataFrame:
    """The rows of docs that ``found`` (key, text_hash, first) has as first, each once. Rows of equal key and text are told apart by their columns' hash."""
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    named = found.select(F.col(key).alias("id2"), F.col("text_hash").alias("h2"), "first")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    left = rows.join(named.where(~F.col("first")).drop("first").distinct(), same, "left_anti")
    again = written(named.where("first").groupBy("id2", "h2").count().where("count > 1").drop("count"), "simhash-again")
    if not again.isEmpty():
        one = left.join(again, same, "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        left = left.join(again, same, "left_anti").select("row").unionByName(one.select("row"))
    return unpacked(left, "row", docs.columns, {})
