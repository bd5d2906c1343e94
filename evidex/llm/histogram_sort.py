"""Sharding by histogram sort.

Rows are keyed by a hash of their group (equal texts), so groups stay together. Exact bytes below candidate keys ("probes") are counted over
all partitions; where no probe meets a splitter's target closely enough, new probes refine its interval, until every splitter does. Then
rows are exchanged once, by key range, and numbered. Groups heavier than the tolerance would make a splitter miss its target, so they
are placed whole before (largest first, on the least loaded shard); one that fits no shard any more is keyed by its rows instead, and spread, and rows of it that are
equal in id and text too, where they are heavy in turn, by the place at which they were written. Only splitters, probes' counts and heavy groups and rows (at most shards / tolerance of either) reach the driver.

Law ``bytes``: the shards' sizes differ from the mean by at most the tolerance and the largest single row. Defined results: a null text counts no bytes,
a row's size is one more than its text's bytes; ties and repeated rows are ordered by key, id and size; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, unpacked, written

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def counts_below(rows: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) of ``rows`` (key, size) with keys below each of the ascending probes, exactly; the last pair has the totals."""
    grid = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = np.zeros(len(grid) + 1, np.int64), np.zeros(len(grid) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(grid, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            number += np.bincount(at, minlength=len(number))
        has = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(size[has]), pa.array(number[has])], ["cell", "size", "rows"])

    cells = rows.select("key", "size").mapInArrow(count, "cell bigint, size bigint, rows bigint").groupBy("cell").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, number = np.zeros(len(grid) + 1, np.int64), np.zeros(len(grid) + 1, np.int64)
    for c in cells:
        size[c["cell"]], number[c["cell"]] = c["size"], c["rows"]
    return list(zip(np.cumsum(size).tolist(), np.cumsum(number).tolist(), strict=True))


def splitters(rows: DataFrame, targets: list[float], tolerances: list[float], *, first: int = 4096, each: int = 16, measure: int = 0) -> tuple[list[int], list[tuple[int, int]]]:
    """Keys such that the bytes (measure 0) or rows (measure 1) below each are within its tolerance of its target, or the nearest there are."""
    known: dict[int, tuple[int, int]] = {LEAST: (0, 0)}
    first = max(first, 4 * len(targets))
    span = (MOST - LEAST) // first
    ask = [LEAST + span * i for i in range(1, first)]
    while ask:
        below = counts_below(rows, ask)
        known.update(zip(ask, below[:-1], strict=True))
        known[MOST + 1] = below[-1]
        keys = sorted(known)
        sums = np.array([known[k][measure] for k in keys])
        new: set[int] = set()
        for target, most in zip(targets, tolerances, strict=True):
            hi = min(int(np.searchsorted(sums, target, side="right")), len(keys) - 1)
            lo = max(hi - 1, 0)
            if min(abs(sums[lo] - target), abs(sums[hi] - target)) > most and keys[hi] - keys[lo] > 1:
                gap = keys[hi] - keys[lo]
                new.update(keys[lo] + max(1, gap * i // (each + 1)) for i in range(1, each + 1))
        ask = sorted(new - known.keys())
    best = []
    for target in targets:
        hi = min(int(np.searchsorted(sums, target, side="right")), len(keys) - 1)
        lo = max(hi - 1, 0)
        best.append(keys[lo] if abs(sums[lo] - target) <= abs(sums[hi] - target) else keys[hi])
    return best, [known[k] for k in best]


@dataclass(frozen=True)
class Plan:
    """Ranges are numbered shard by shard, ``per_shard`` each; bounds are the keys where one ends; heavy groups have their shard."""

    shards: int
    per_shard: int
    bounds: np.ndarray
    heavy: np.ndarray
    heavy_shard: np.ndarray
    spread: np.ndarray
    copies: tuple[int, ...]

    def range_of(self, key: Column, row: Column, place: Column) -> Column:
        """The range of a row by its group key, a hash of the row and its place."""

        @F.arrow_udf("int")
        def find(keys: pa.Array, hashes: pa.Array) -> pa.Array:
            k, h = keys.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
            k = np.where(np.isin(k, self.spread), h, k)
            out = np.searchsorted(self.bounds, k, side="right")
            if len(self.heavy):
                at = np.minimum(np.searchsorted(self.heavy, k), len(self.heavy) - 1)
                out = np.where(self.heavy[at] == k, self.heavy_shard[at] * self.per_shard + h % self.per_shard, out)
            return pa.array(out.astype(np.int32))

        return find(key, row_key(self.copies, row, place))


def row_key(copies: tuple[int, ...] | list[int], row: Column, place: Column) -> Column:
    """What tells the rows of a spread group apart: their hash, or for very many equal ones their place."""
    return F.when(row.isin(*copies), F.xxhash64(row, place)).otherwise(row) if copies else row


def sized(docs: DataFrame, kept: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, id, size, key, row, place): ``kept`` of each row, its id, bytes, the hash of its text, a hash of its id and text, and a number of its own, which holds once it is written."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(body)
    return docs.select(kept.alias("doc"), F.col(key).alias("id"), (F.octet_length(body).cast("bigint") + 1).alias("size"), hashed.alias("key"), F.xxhash64(F.lit(5), F.col(key), hashed).alias("row"), F.monotonically_increasing_id().alias("place"))


def plan(keys: DataFrame, shards: int, *, tolerance: float = 0.005) -> Plan:
    """keys: (key, row, place, size), read once for each round of probes."""
    spark = keys.sparkSession
    per = max(1, -(-4 * partitions(spark) // shards))  # several ranges a task, so that tasks come out even
    total = keys.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    found = keys.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > tolerance * share).collect() if total else []
    load, heavy, spread = [0] * shards, {}, []
    for r in sorted(found, key=lambda r: (-r["b"], r["key"])):
        least = min(range(shards), key=lambda s: (load[s], s))
        if load[least] + r["b"] <= share:
            heavy[r["key"]] = least
            load[least] += r["b"]
        else:
            spread.append(r["key"])
    light = keys.where(~F.col("key").isin(*heavy)) if heavy else keys
    copies: list[int] = []
    if spread:
        many = keys.where(F.col("key").isin(*spread)).groupBy("row").agg(F.sum("size").alias("b")).where(F.col("b") > tolerance * share).collect()
        copies = sorted(r["row"] for r in many)
        light = light.withColumn("key", F.when(F.col("key").isin(*spread), row_key(copies, F.col("row"), F.col("place"))).otherwise(F.col("key")))
    targets, done = [], 0.0
    for s in range(shards):
        room = share - load[s]
        targets += [done + room * i / per for i in range(1, per + 1)]
        done += room
    edge = [tolerance * share / 4 if (i + 1) % per == 0 else 0.1 * share / per for i in range(shards * per)]
    bounds = splitters(light, targets[:-1], edge[:-1])[0] if total else []
    order = sorted(heavy)
    return Plan(shards, per, np.array([min(b, MOST) for b in bounds], np.int64), np.array(order, np.int64), np.array([heavy[k] for k in order], np.int64), np.array(sorted(spread), np.int64), tuple(copies))


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """written rows (of ``sized``) with shard and slot, in one exchange by key range; their narrow columns are read for each round of probes."""
    keys = rows.select("key", "row", "place", "size")
    p = plan(keys, shards)
    at = p.range_of(F.col("key"), F.col("row"), F.col("place"))
    counts = {r["range"]: r["count"] for r in keys.select(at.alias("range")).groupBy("range").count().collect()}
    starts = []
    for s in range(shards):
        done = 0
        for r in range(s * p.per_shard, (s + 1) * p.per_shard):
            starts.append(done)
            done += counts.get(r, 0)
    base = F.get(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("range"))
    number = F.row_number().over(Window.partitionBy("range").orderBy("key", "id", "row", "size"))
    return rows.withColumn("range", at).withColumns({"shard": F.floor(F.col("range") / p.per_shard).cast("int"), "slot": (base + number - 1).cast("bigint")})


def shard(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard and slot, which replace own columns of these names. The rows are written once, so that their keys hold from the probes to the exchange."""
    rows = written(sized(docs, F.struct("*"), key=key, text=text), "shard-rows")
    return unpacked(placed(rows, shards), "doc", docs.columns, {"shard": F.col("shard"), "slot": F.col("slot")})


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = written(sized(docs, F.crc32(F.coalesce(F.col("text"), F.lit("")))), "shard-keys")
    return placed(rows, shards).select(
        F.col("id").alias("doc_id"), "size", F.col("doc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
