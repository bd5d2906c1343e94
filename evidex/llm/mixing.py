"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Sources get targets in proportion to their weights, capped at ``most`` times their size; what exceeds a cap is shared again by weight until
none is above. The mix is cut into blocks of ``block`` tokens. Blocks go to sources by the highest quotients target / (2k + 1), k blocks held; since
quotas only grow with the number of blocks, the blocks after the first j / shards of all belong to shard j, which gives integer quotas per shard.
A source's documents are laid out in seeded order (md5 of seed, id and size) and the stream is cut into blocks; shard by shard, a source's quota takes the next
blocks of this seeded stream, and around again at its end, so reruns agree and no token is taken over ``most`` times.

Only one row a source is ever gathered. A source's seats at the common divisor differ from its proportional share by no more than n / 2 times its part of all, and a
half, for n sources; only the quotients within that are ranked, a number in proportion to n over all sources. Running
sums over a source are made within hash ranges and then over the ranges' totals, so a source with most rows is spread over all tasks.
Defined results: sources are ordered by code point, null last; a null text has size 0; documents of size 0 are never taken; repeated ids are
ordered by md5 and size, equal ones in any order; an empty table has no rows; own columns of the names of new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, unpacked

WEIGHTS, VOLUME, MOST, BLOCK, SHARDS, SEED = (3, 1, 2), 1.5, 2, 256, 8, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    The reshared targets are w * level, capped; the caps fill in the order of size / weight, so the level follows from running sums.
    """
    rows = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights)))
    rows = rows.withColumn("cap", (F.col("source_size") * most).cast("double"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(volume) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, in this order, whose share stays below its cap sets the level for it and all after it.
    rows = rows.withColumn("_level", F.when(level * F.col("weight") < F.col("cap"), level))
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("target", F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))).drop("_level", "cap")


def apportion(sources: DataFrame, *, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(rank, shard, quota, upto): each source's blocks in each shard and up to it, by Sainte-Laguë over its target."""
    every = Window.partitionBy()
    rows = sources.select("rank", "target").withColumns({"total": F.sum("target").over(every), "n": F.count("*").over(every)})
    house = F.ceil(F.col("total") / block * F.col("shard") / shards)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn("house", house)
    part = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    share, width = F.floor(part * F.col("house")), F.ceil(part * F.col("n") / 2) + 2
    rows = rows.withColumn("settled", F.greatest(F.lit(0).cast("bigint"), share - width))
    near = rows.select("*", F.explode(F.sequence(F.col("settled"), share + width)).alias("k"))
    held = F.sum("settled").over(Window.partitionBy("shard"))
    settled = rows.select("shard", "rank", held.alias("held"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "rank")))
    near = near.join(settled, ["shard", "rank"])
    upto = near.groupBy("rank", "shard").agg((F.min("settled") + F.count_if(F.col("place") <= F.col("house") - F.col("held"))).alias("upto"))
    return upto.withColumn("quota", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("rank").orderBy("shard")), F.lit(0)))


def mix(rows: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """rows with source_size, target, taken, the tokens of the row that the mix takes, repeats counted, and shard_taken, those that each shard takes.

    rows, of which there is no more than one narrow row a document, are read from a checkpoint.
    """
    ranges = 4 * partitions(rows.sparkSession)
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(size).cast("string")))
    held = rows.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(size).alias("size"), F.col(key).alias("id"), drawn.alias("draw"))
    held = held.withColumn("range", F.floor(F.conv(F.substring("draw", 1, 7), 16, 10).cast("bigint") * ranges / (1 << 28))).checkpoint()
    parts = held.groupBy("source", "range").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")))
    quotas = apportion(targets, block=block, shards=shards).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("quotas"))
    targets = targets.join(quotas, "rank", "left").select(F.col("source").alias("s"), "source_size", "target", F.transform("quotas", lambda q: q["upto"]).alias("upto"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("part").over(run), F.lit(0)))
    parts = parts.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("range").alias("r"), "first", "source_size", "target", "upto")
    within = Window.partitionBy("source", "range").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = held.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = laid.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("start", F.col("first") + F.col("inside"))

    def so_far(blocks: Column) -> Column:
        """The row's tokens in so many blocks from the stream's start and around; the last block of a source is shorter, so they are held to its rounds."""
        wanted = F.least(blocks * block, F.col("source_size") * MOST, F.ceil(F.col("target")))
        rounds = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0))
        rest = wanted - rounds * F.col("source_size")
        return (rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))).cast("bigint")

    laid = laid.withColumn("upto_taken", F.transform("upto", so_far))
    each = F.transform("upto_taken", lambda n, i: n - F.when(i > 0, F.get("upto_taken", i - 1)).otherwise(F.lit(0).cast("bigint")))
    laid = laid.withColumn("shard_taken", each)
    taken = F.aggregate("shard_taken", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return unpacked(laid, "row", rows.columns, {"source_size": F.col("source_size"), "target": F.col("target"), "taken": taken, "shard_taken": F.col("shard_taken")})


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and by_shard (the words that each shard takes, comma-joined) of every document."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shard_taken", lambda n: n.cast("string")), ",").alias("by_shard"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row once for every time that it takes half of the document or more; equal rows (id, source, text) get their mean."""
    h = F.xxhash64("text")
    mixed = mix(docs.select("doc_id", "source", words(F.col("text")).alias("size"), h.alias("h")))
    copies = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
    counts = mixed.where("size > 0").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("h").alias("h2")).agg(copies.alias("copies")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), h.alias("h"))
    rows = rows.join(counts, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("h2")))
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), "row", docs.columns, {})


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (SELECT *, ([3, 1, 2])[rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w
), t AS (
  SELECT rank, source, source_size, coalesce(weight * first_value(CASE WHEN level * weight < cap THEN level END IGNORE NULLS) OVER (
    ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cap) AS target FROM l
), q AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS place, (SELECT sum(target) FROM t) AS total
  FROM t, unnest(range(0, (target / 256)::BIGINT + 40)) AS u(k)
), b AS (SELECT rank, list_transform(range(1, 9), lambda j: len(list_filter(list(place), lambda p: p <= ceil(max(total) / 256 * j / 8)))) AS blocks FROM q GROUP BY rank
), o AS (
  SELECT doc_id, size, source_size, target, list_transform(blocks, lambda n: least(n * 256, source_size * 2, ceil(target)::BIGINT)) AS wanted,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN b USING (rank)
), s2 AS (
  SELECT *, list_transform(wanted, lambda w: (CASE WHEN source_size > 0 THEN w // source_size * size + greatest(0, least(size, w - w // source_size * source_size - start)) ELSE 0 END)::BIGINT) AS upto FROM o
)
SELECT doc_id, size, source_size, target, upto[8] AS taken, array_to_string(list_transform(range(1, 9), lambda j: (upto[j::INT] - CASE WHEN j > 1 THEN upto[j::INT - 1] ELSE 0 END)::VARCHAR), ',') AS by_shard
FROM s2
"""
