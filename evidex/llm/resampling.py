"""Quality selection by importance resampling with hashed n-gram models.

Words and word pairs are hashed to ``BUCKETS`` features. Two generative models, feature frequencies with add-``SMOOTH`` smoothing, are counted in one
scan: over all texts (raw), and over the target texts. A document's log weight is the log of the ratio of the models' probabilities of its n features, times
LENGTH / (n + LENGTH): of a few features nearly the plain log ratio, of very many LENGTH times its mean a feature, and smooth between. The plain sum grows with the text, so
that length alone would decide and the noise nothing. Seeded Gumbel noise is added, and the ``share`` of the documents with the largest sums
is taken, which samples without replacement in proportion to the weights. Counting keeps one array of BUCKETS a task; the k-th largest
sum is found by counting ranks below probes (histogram_sort), not by a global sort.

``quality_documents`` takes as target the texts of at most ``LABELLED`` labelled good ids, those of least hash, so the ids are a table of proven size: they are
broadcast at every size of the input, and texts are never exchanged. Raw counts cover all documents.

Defined results: null or wordless texts have weight 0; without target texts all weights are 0; ties are broken by a hash of id and text, so
reruns agree; repeated rows are taken or left together only as the rank allows; a label row counts as good if every row of its id is good and none toxic, null
ids and null labels never; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes, written
from .decontam import words
from .histogram_sort import MOST, splitters

BUCKETS, SMOOTH, LENGTH, LABELLED, SEED = 1 << 16, 1.0, 12, 50_000, 29


def features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and pair of neighbouring words of the texts."""
    h, n = words(body, at)
    owner = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    two = (h[pair] * np.uint64(0x9E3779B97F4A7C15)) ^ h[pair + 1]
    two *= np.uint64(0xD6E8FEB86659FD93)
    both = np.concatenate([h, two])
    return ((both >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[pair]])


def pieces(at: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        yield begin, end
        begin = end


def model_counts(docs: DataFrame, *, text: str = "text", target: str = "target") -> np.ndarray:
    """(2, BUCKETS): feature counts over all texts, and over those where ``target`` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            body, at = text_bytes(b.column(0))
            wanted = b.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(at):
                f, owner = features(body, at[lo : hi + 1])
                total[0] += np.bincount(f, minlength=BUCKETS)
                total[1] += np.bincount(f[wanted[lo:hi][owner]], minlength=BUCKETS)
        has = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[0, has]), pa.array(total[1, has])], ["f", "raw", "target"])

    out = np.zeros((2, BUCKETS), np.int64)
    sums = docs.select(text, target).mapInArrow(count, "f bigint, raw bigint, target bigint").groupBy("f").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for r in sums.collect():  # BUCKETS rows at most
        out[:, r["f"]] = r["raw"], r["target"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    if not counts[1].any():
        return np.zeros(BUCKETS)
    p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(p[1] / p[0])


def with_weight(docs: DataFrame, ratios: np.ndarray, *, text: str = "text", out: str = "log_weight") -> DataFrame:
    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            body, at = text_bytes(texts)
            total, number = np.zeros(len(texts)), np.zeros(len(texts))
            for lo, hi in pieces(at):
                f, owner = features(body, at[lo : hi + 1])
                total[lo:hi] += np.bincount(owner, ratios[f], minlength=hi - lo)
                number[lo:hi] += np.bincount(owner, minlength=hi - lo)
            yield pa.array(total * (LENGTH / (number + LENGTH)))

    return docs.withColumn(out, weigh(F.col(text)))


def gumbel(*columns: Column) -> Column:
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, *, share: float = 0.5, key: str = "doc_id", text: str = "text", target: str = "target") -> DataFrame:
    """(key, log_weight, gumbel_key, selected) of every row of docs; ``target`` marks the texts of the target model."""
    ratios = log_ratios(model_counts(docs, text=text, target=target))
    scored = with_weight(docs.select(key, F.coalesce(text, F.lit("")).alias("t")), ratios, text="t")
    scored = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(key), F.xxhash64("t")))
    # An order-preserving integer, largest sums first: the sum to 2^-20 above 34 bits of hash that break ties.
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), key, F.xxhash64("t")), 30)
    rank = (F.floor(F.greatest(F.lit(-255.0), F.least(F.lit(255.0), -F.col("gumbel_key"))) * float(1 << 20)).cast("bigint") * F.lit(1 << 34)) + tie
    scored = written(scored.select(key, "log_weight", "gumbel_key", rank.alias("rank")), "resampling")
    total = scored.count()
    cut = splitters(scored.select(F.col("rank").alias("key"), F.lit(1).cast("bigint").alias("size")), [float(round(share * total))], [0.0])[0][0] if total else 0
    return scored.select(key, "log_weight", "gumbel_key", (F.col("rank") < F.lit(min(cut, MOST))).alias("selected"))


def target_ids(labels: DataFrame, *, key: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """(id): at most ``most`` ids, those of least hash, all of whose label rows are good and not toxic."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.min("quality") == 1).alias("good"), (F.max("toxic") == 0).alias("clean"))
    return marks.where("good and clean").select("id").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(most)


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every document; the target model is that of texts labelled good and not toxic."""
    ids = F.broadcast(target_ids(table(spark, sf_dir, "labels")).withColumn("target", F.lit(True)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs.join(ids, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "target"))
