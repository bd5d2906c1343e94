import random

import pytest

import corpus_pipeline

from .brute import components, contamination, odd_rows, prose, shingles, simhash, simhash_words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, seed=12):
    rng = random.Random(seed)
    items = [(i, " ".join(f"bench{i}w{j}" for j in range(14))) for i in range(4)]
    rows = [r[:5] for r in odd_rows(seed, 120)]
    rows += [(9000 + i, prose(rng, 10) + " " + items[i % 4][1] + " " + prose(rng, 10), "en", "a", 1) for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(r)

    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = [key(r) for r in kept.collect()]
    assert {r[0] for r in rows if r[1] and r[1].count(" ") > 5} <= {r[0] for r in left}
    assert all(any(c.isalpha() for c in r[1]) for r in left)

    single = stages["simhash_dedup"](spark, kept, str(tmp_path))
    own = [key(r) for r in single.collect()]
    groups = components([simhash(r[1]) for r in left], also=[shingles(r[1]) for r in left])
    assert len(own) == len({id(g) for g in groups.values()})
    assert {r[0] for r in own} == {min((left[j][0] for j in g if left[j][0] is not None), default=None) for g in groups.values()}

    clean = stages["decontamination"](spark, single, str(tmp_path))
    assert sorted(map(key, clean.collect()), key=str) == sorted((r for r in own if not contamination(r[1], items)[1]), key=str)
    assert clean.count() < len(own)

    mixed = stages["source_mixing"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    counts: dict = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts.values()) <= {1, 2}

    out = stages["sharding"](spark, mixed, str(tmp_path))
    got = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"] and len(got) == sum(counts.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_run_equals_the_stages_and_reruns_agree(spark, tmp_path):
    rows, _ = tables(spark, tmp_path, 13)
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) for _ in range(2))
    assert a == b and a
    assert all(simhash_words(r[1]) for r in a)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_nothing_to_do(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
