"""Near copies: documents whose sets of five-word shingles have a Jaccard likeness of 0.8 or more, and those that SimHash links.

Documents of equal shingle sets are one node. A node's 80 min-hashes make 20 bands of four, and nodes that share a band are candidates: a pair of likeness
0.8 shares one with a chance of 1 - (1 - 0.8^4)^20, over 0.9999. Every candidate is checked on the whole sets. First each node is checked against
``HUBS`` drawn nodes of its bucket, in a crowded one also against about ``dense`` that share the next band; then every pair of a bucket that still isn't in one component, however large the bucket is, unless a bound shows
that it is no link: sets as unlike as that tell themselves from a hub by members of their own, so an index of these finds the others without pairing up the bucket. Rows grow with the members; pairs only where many sets share what the hub lacks, or lack the same of it.
Links of simhash.links join the same graph.

Defined results: as in simhash; texts without a word are one node; with fewer words than a shingle the whole sequence is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import text_bytes, written

BANDS, ROWS, HUBS, DRAWN, CELLS = 20, 4, 5, 16, 1024
_RNG = np.random.default_rng(7)
TURNS, FACTORS = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
WEIGHTS = _RNG.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
#: Bytes of text whose shingle hashes are returned at once.
SLICE = 4 << 20


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band values of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 4096):
        part = (hashes[None, lo : lo + 4096] ^ TURNS[:, None]) * FACTORS[:, None]
        least = np.minimum(least, part.min(axis=1))
    return (least.reshape(BANDS, ROWS) * WEIGHTS).sum(axis=1, dtype=np.uint64)


def cells(hashes: np.ndarray) -> np.ndarray:
    """Which of 1024 cells a set of hashes has members in, as 16 words. A cell of one set that another lacks has a member that the other lacks."""
    marks = np.zeros(CELLS, bool)
    marks[(hashes >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").view(np.int64)


def with_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, h, fp, and of the set of shingles: node (its digest), n (its size), bands, cells."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = text_bytes(b.column("t"))
            node, sizes, keys, marks = [], [], [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found = np.unique(simhash.shingle_hashes(body[x:y], shingle))
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                keys.append(bands(found))
                marks.append(cells(found))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * (CELLS // 64)), pa.array(np.concatenate([np.zeros(0, np.int64), *marks])))
            columns = [b.column("id"), b.column("h"), b.column("fp"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, words]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "fp", "node", "n", "bands", "cells"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "h", "fp", "t").mapInArrow(sets, f"id {kind}, h bigint, fp bigint, node bigint, n int, bands array<bigint>, cells array<bigint>")


def with_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """node, and the hashes of its set, of rows (node, t)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = text_bytes(b.column("t"))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
                found = [np.unique(simhash.shingle_hashes(body[x:y], shingle)) for x, y in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), lists], ["node", "hashes"])
                lo = hi

    return docs.select("node", "t").mapInArrow(sets, "node bigint, hashes array<bigint>")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a likeness of so many percent or more."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return pairs.join(one, "a").join(two, "b").withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def fits(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of so many members may have a likeness of so many percent."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def apart_pairs(meeting: DataFrame, sets: DataFrame, *, percent: int, dense: int) -> DataFrame:
    """Pairs (a, b) of different roots among the nodes that meet at a hub (hub, node, n, root); each such pair of so many percent is one of them. Nodes linked to the hub have its root.

    Let D be what tells a set from its hub: members that it has more, and those that it lacks. Two sets x and y of n and m members differ in as many members as their Ds do; for a link that is at most
    T = (n + m) (100 - percent) / (100 + percent), so their Ds share (|Dx| + |Dy| - T) / 2 or more. If that is none, |Dx| <= T - |Dy| makes x itself a link of the hub, and so y: they have one root. Else, in
    any order that all at the hub have in common, the first that the Ds share has as many behind it in both. The order puts members first that few Ds have, as far as ``DRAWN`` sets of a hub with more than
    ``dense`` show; it decides how many pairs come up, not whether a link does.
    """
    drawn = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(DRAWN)]))
    hubs = meeting.groupBy("hub").agg(F.count("*").alias("size"), (F.min("root") < F.max("root")).alias("mixed"), drawn.alias("drawn"))
    hubs = written(hubs.where("mixed"), "near-mixed")
    tops = meeting.groupBy("hub", "root").agg(F.count("*").alias("c")).groupBy("hub").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
    shown = hubs.where(F.col("size") > dense).select("hub", F.explode("drawn").alias("node")).join(sets, "node").groupBy("hub").agg(F.array_sort(F.flatten(F.collect_list("hashes"))).alias("all"))
    common = shown.select("hub", F.array_distinct(F.filter("all", lambda x, i: x == F.get("all", i - 1))).alias("common"))
    named = hubs.select("hub").join(tops, "hub").join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("y")), "hub").join(common, "hub", "left")
    named = written(named.withColumn("common", F.coalesce("common", F.array().cast("array<bigint>"))), "near-centres")

    told = meeting.join(sets.select("node", F.col("hashes").alias("x")), "node").join(named, "hub").withColumn("more", F.array_except("x", "y")).withColumn("less", F.array_except("y", "x"))
    ordered = F.concat(F.array_except("more", "common"), F.array_intersect("less", "common"), F.array_intersect("more", "common"), F.array_except("less", "common"))
    told = told.select("hub", "node", "n", "root", (F.col("root") == F.col("top")).alias("main"), ordered.alias("d"))
    first = F.slice("d", 1, F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1)  # T for the largest m, and one
    told = told.select("hub", "main", F.struct("node", "n", "root", F.size("d").alias("d")).alias("of"), F.posexplode(first).alias("i", "member"))
    told = written(told.select(F.xxhash64("hub", "member").alias("key"), "main", "of", "i"), "near-told")

    behind = F.least(F.col("x.of.d") - F.col("x.i"), F.col("y.of.d") - F.col("y.i")).cast("bigint")  # itself included
    enough = (100 + percent) * (F.col("x.of.d") + F.col("y.of.d") - 2 * behind) <= (100 - percent) * (F.col("x.of.n").cast("bigint") + F.col("y.of.n"))
    meet = (F.col("x.of.root") != F.col("y.of.root")) & (F.col("y.main") | (F.col("x.of.node") < F.col("y.of.node"))) & fits(F.col("x.of.n"), F.col("y.of.n"), percent)
    pairs = told.where("not main").hint("merge").alias("x").join(told.alias("y"), (F.col("x.key") == F.col("y.key")) & meet & enough)
    return pairs.select(F.least("x.of.node", "y.of.node").alias("a"), F.greatest("x.of.node", "y.of.node").alias("b")).distinct()


def links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], *, percent: int = 80, dense: int = 32) -> DataFrame:
    """(a, b), a < b: links between nodes (node, n, bands, cells) of likeness ``percent`` or more; ``sets`` gives (node, hashes) of the nodes that have candidates."""
    indexed = nodes.where("n > 0").select("node", "n", "bands", F.posexplode("bands").alias("band", "k"))
    indexed = indexed.select("node", "n", "band", "k", F.get("bands", (F.col("band") + 1) % BANDS).alias("next"))
    hubs = F.array(*[F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))) for i in range(HUBS)])
    buckets = indexed.groupBy("band", "k").agg(F.count("*").alias("size"), hubs.alias("hubs")).where("size > 1")
    shared = written(indexed.join(buckets, ["band", "k"]), "near-keys")
    rows = written(sets(shared.select("node").distinct()), "near-hashes")

    near = shared.select("node", "n", F.explode("hubs").alias("hub")).where((F.col("hub.node") != F.col("node")) & fits(F.col("hub.n"), F.col("n"), percent))
    checked = written(near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "near-hubs")
    found = written(alike(checked, rows, percent), "near-links")

    # Members of a crowded bucket that also share the next band are compared in groups of about ``dense``: linear, and it brings large groups of copies into one component.
    roots = written(simhash.components(found), "near-roots")
    known = shared.drop("hubs").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = known.where(F.col("size") > dense).groupBy("band", "k", "next").agg(F.count("*").alias("part"))
    dealt = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("part") / dense))
    groups = known.join(parts, ["band", "k", "next"]).groupBy("band", "k", "next", dealt.alias("deal")).agg(F.array_sort(F.collect_list(F.struct("node", "n", "root"))).alias("m")).where(F.size(F.array_distinct(F.col("m.root"))) > 1)
    others = F.filter("m", lambda two: (two["root"] > F.col("one.root")) & fits(F.col("one.n"), two["n"], percent))  # of other components only, and of a size that may be alike
    near = groups.select("m", F.explode("m").alias("one")).select("one", F.explode(others).alias("two")).select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
    crowded = written(near.distinct().join(checked, ["a", "b"], "left_anti"), "near-crowded")
    checked, found = checked.unionByName(crowded), written(found.unionByName(alike(crowded, rows, percent)), "near-links")

    # Each pair of a bucket that isn't in one component yet. Every table is a step of its own: what the driver keeps of plans grows with the square of their size.
    roots = written(simhash.components(found), "near-roots")
    meeting = shared.select(F.col("hubs")[0]["node"].alias("hub"), "node", "n").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = written(apart_pairs(written(meeting, "near-meeting"), rows, percent=percent, dense=dense).join(checked, ["a", "b"], "left_anti"), "near-apart")
    marks = F.struct("n", "cells")
    both = apart.join(nodes.select(F.col("node").alias("a"), marks.alias("x")), "a").join(nodes.select(F.col("node").alias("b"), marks.alias("y")), "b")
    lacks = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.get(f"{a}.cells", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{b}.cells", F.lit(i))))) for i in range(CELLS // 64)])
    # Of sets of n and m members with this likeness, the first has at most (100 n - percent m) / (100 + percent) that the other lacks; the cells bound that number from below, so no link is lost.
    may = lambda a, b: (100 + percent) * lacks(a, b) <= 100 * F.col(f"{a}.n") - percent * F.col(f"{b}.n")
    left = written(both.where(may("x", "y") & may("y", "x")).select("a", "b"), "near-pairs")
    return found.unionByName(written(alike(left, rows, percent), "near-links"))


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, text_hash, component, first) of every row, as simhash.near_duplicates has them."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    prints = simhash.with_fingerprint(named, text="t", out="fp").withColumn("h", F.xxhash64("t"))
    rows = written(with_sets(prints, shingle), "near-sets")
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h"))
    nodes = written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("cells").alias("cells"), least.alias("least")), "near-nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        at = nodes.join(wanted, "node").select("node", F.col("least.id").alias("_id"), F.col("least.h").alias("_h"))
        texts = named.withColumn("h", F.xxhash64("t")).join(at, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
        return with_hashes(texts.dropDuplicates(["_id", "_h"]), shingle)

    held = rows.select("fp", "node").distinct()
    faces = written(held.groupBy("fp").agg(F.min("node").alias("face")), "near-faces")
    same = held.join(faces, "fp").select(F.col("face").alias("a"), F.col("node").alias("b"))
    close = written(simhash.links(faces.select("fp")), "near-close")
    close = close.join(faces.select(F.col("fp").alias("a"), F.col("face").alias("x")), "a").join(faces.select(F.col("fp").alias("b"), F.col("face").alias("y")), "b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = links(nodes, sets, percent=percent).unionByName(same).unionByName(close).where("a < b").distinct()

    roots = simhash.components(edges)
    grouped = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    grouped = written(grouped.join(grouped.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first"), "near-components")
    mine = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    return rows.select("id", "h", "node").join(grouped, "node").select(F.col("id").alias(key), F.col("h").alias("text_hash"), F.col("first.id").alias("component"), mine.alias("first"))


def drop_near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component, chosen as by simhash.drop_near_duplicates."""
    return simhash.keep_first(docs, near_copies(docs, key=key, text=text, shingle=shingle, percent=percent), key=key, text=text)
