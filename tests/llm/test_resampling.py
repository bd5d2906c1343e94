import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidex.llm import resampling as rs
from evidex.llm.decontam import words

from .brute import DOCS, odd_rows, prose


def test_selects_what_resembles_the_target(spark):
    rng = random.Random(2)
    good, bad = "clear useful careful exact method result".split(), "click win free cash spam junk".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), i % 2 == 1 and i < 200) for i in range(800)]
    got = rs.resample(spark.createDataFrame(rows, "doc_id bigint, text string, target boolean")).collect()
    chosen = [r.doc_id for r in got if r.selected]
    assert len(chosen) == 400 and sum(i % 2 for i in chosen) > 380


def test_exact_share_and_order(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).withColumn("target", F.col("lang") == "en")
    got = rs.resample(df, share=0.3).collect()
    assert len(got) == len(odd_rows())
    assert abs(sum(r.selected for r in got) - round(0.3 * len(got))) <= 3  # equal rows share a rank
    assert min(r.gumbel_key for r in got if r.selected) >= max(r.gumbel_key for r in got if not r.selected) - 1e-5
    again = rs.resample(df.repartition(5), share=0.3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(prose(rng, rng.randrange(40)), i % 3 == 0) for i in range(50)] + [(None, True), ("", None)]
    got = rs.model_counts(spark.createDataFrame(rows, "text string, target boolean").repartition(4))
    n = lambda t: max(0, 2 * len((t or "").replace(".", " ").replace(",", " ").split()) - 1)
    assert got[0].sum() == sum(n(t) for t, _ in rows) and got[1].sum() == sum(n(t) for t, x in rows if x)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, target boolean")
    assert rs.resample(empty).collect() == []
    got = rs.resample(spark.createDataFrame([(1, "a b", False), (2, None, None)], empty.schema)).collect()
    assert [r.log_weight for r in got] == [0.0, 0.0] and np.isfinite([r.gumbel_key for r in got]).all()


def brute_features(text):
    """Buckets of all words and pairs of neighbouring words, from the words' own hashes."""
    body = (text or "").encode()
    h, n = words(np.frombuffer(body, np.uint8), np.array([0, len(body)])) if body else (np.zeros(0, np.uint64), [0])
    mask = (1 << 64) - 1
    out = [(int(x) >> 32) % rs.BUCKETS for x in h]
    for a, b in zip(h[:-1].tolist(), h[1:].tolist(), strict=True):
        out.append((((((a * 0x9E3779B97F4A7C15) & mask) ^ b) * 0xD6E8FEB86659FD93 & mask) >> 32) % rs.BUCKETS)
    return out


def test_query_against_brute_force(spark, tmp_path):
    """Counts, weights, Gumbel keys and the cut; label ids that repeat, disagree, are null or have null labels."""
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)] + [(300, None), (301, ""), (302, "one"), (None, "no id"), (5, "second row of an id"), (7, prose(rng, 20_000))]
    labels = [(i, int(i % 3 == 0), int(i % 12 == 0)) for i in range(0, 200, 2)] + [(6, 1, 0), (18, 0, 0), (30, None, None), (42, 1, None), (None, 1, 0), (999, 1, 0), (302, 1, None), (7, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").repartition(2).write.parquet(f"{tmp_path}/labels.parquet")
    by: dict = {}
    for i, q, t in labels:
        by.setdefault(i, []).append((q, t))
    least, most = (lambda v: min((x for x in v if x is not None), default=None)), (lambda v: max((x for x in v if x is not None), default=None))
    good = {i for i, v in by.items() if i is not None and least([q for q, _ in v]) == 1 and most([t for _, t in v]) == 0}
    assert 302 not in good and 18 not in good and 6 in good and 42 in good
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(brute_features(t))
        if i in good:
            target.update(brute_features(t))
    total = (sum(raw.values()) + rs.BUCKETS, sum(target.values()) + rs.BUCKETS)
    ratio = lambda f: math.log((target[f] + 1) / total[1]) - math.log((raw[f] + 1) / total[0])
    want: dict = {}
    for i, t in rows:
        f = brute_features(t)
        want.setdefault(i, []).append(sum(map(ratio, f)) * 12 / (len(f) + 12))
    got = rs.quality_documents(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for i, values in want.items():
        assert np.allclose(sorted(values), sorted(r.log_weight for r in got if r.doc_id == i), atol=1e-9)
    noise = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", rs.gumbel(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("g")).collect()
    assert np.allclose(sorted(r.gumbel_key - r.log_weight for r in got), sorted(r.g for r in noise), atol=1e-9)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.selected for r in got) == len(rows) // 2 and all(r.selected == (r.gumbel_key >= keys[len(rows) // 2 - 1]) for r in got)


def test_target_ids_are_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    few = {r.id for r in rs.target_ids(labels, most=10).collect()}
    assert len(few) == 10 and few == {r.id for r in rs.target_ids(labels.repartition(7), most=10).collect()}
