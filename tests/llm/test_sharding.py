import random

import pytest

from evidex.llm import histogram_sort as hs

from .brute import DOCS, odd_rows


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((x[0] is None, x[0] or 0, len((x[1] or "").encode()) + 1) for x in rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


def test_shards_are_near_equal_and_keep_copies_together(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i} " + "x" * rng.randrange(400), "en", "a", 1, "", "", "", "", "") for i in range(6000)]
    rows += [(10_000 + i, "a copied text " * 20, "en", "a", 1, "", "", "", "", "") for i in range(300)]
    got = hs.shard_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    sizes = check(rows, got)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    assert len({r.shard for r in got if r.doc_id >= 10_000}) == 1
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_a_group_larger_than_a_shard_is_spread(spark):
    rows = [(i, "the same text " * 9, "en", "a", 1, "", "", "", "", "") for i in range(3000)] + [(9000 + i, f"own {i}", "en", "a", 1, "", "", "", "", "") for i in range(50)]
    sizes = check(rows, hs.shard_documents(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def test_rows_equal_in_everything_are_spread(spark):
    rows = [(1, "ten bytes", "en", "a", 1, "", "", "", "", "")] * 4000 + [(i, f"own {i}", "en", "a", 1, "", "", "", "", "") for i in range(990)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    sizes = check(rows, hs.shard_documents(df).collect())
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 20
    per = [0] * 8
    for r in hs.shard(df).collect():
        per[r.shard] += len(r.text) + 1
    assert max(per) - min(per) < 0.02 * sum(per) / 8 + 20


@pytest.mark.parametrize("rows", [odd_rows(), [], [(1, None, None, None, None, None, None, None, None, None)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCS).drop("shard", "_size")
    check(rows, hs.shard_documents(df).collect())
    assert sorted(hs.shard(df).select("doc_id", "text").collect(), key=str) == sorted(df.select("doc_id", "text").collect(), key=str)


def test_probes_count_exactly(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key bigint, size bigint")
    probes = sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(50))
    got = hs.counts_below(df, probes)
    assert got == [(sum(s for k, s in rows if k < p), sum(k < p for k, _ in rows)) for p in probes] + [(sum(s for _, s in rows), 3000)]


def test_splitters_find_an_exact_rank(spark):
    rng = random.Random(4)
    keys = sorted({rng.randrange(1 << 40) for _ in range(2000)})
    df = spark.createDataFrame([(k, 1) for k in keys], "key bigint, size bigint")
    cut, below = hs.splitters(df, [777.0], [0.0])
    assert below[0][0] == 777 and keys[776] < cut[0] <= keys[777]
