import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evidex.llm import mixing

from .brute import DOCS, odd_rows, simhash_words


def targets(sizes: dict) -> dict:
    """Weights 3, 1, 2 over the sources by code point, null last; capped shares refilled until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_targets_and_taken(spark):
    rows = odd_rows()
    got = mixing.mix_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(simhash_words(r[1]))
    want, taken = targets(sizes), {}
    by_id = {r[0]: r for r in rows if r[0] is not None}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
        if g.doc_id is None:
            continue
        source = by_id[g.doc_id][3]
        assert g.size == len(simhash_words(by_id[g.doc_id][1])) and g.source_size == sizes[source]
        assert g.target == pytest.approx(want[source])
        taken[source] = taken.get(source, 0) + g.taken
    for s in ("a", "b", "c", "é"):
        assert abs(taken[s] - want[s]) <= mixing.BLOCK + 40  # a block, and the rows without an id
    again = mixing.mix_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_quotas_are_sainte_lague_for_every_shard(spark):
    rng = random.Random(1)
    votes = [round(rng.uniform(1, 90_000), 3) for _ in range(9)] + [0.0]
    df = spark.createDataFrame(list(enumerate(votes)), "rank int, target double")
    got = {(r.rank, r.shard): (r.quota, r.upto) for r in mixing.apportion(df, block=100, shards=5).collect()}
    import math

    for shard in range(1, 6):
        seats = [0] * len(votes)
        for _ in range(math.ceil(sum(votes) / 100 * shard / 5)):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert [got[i, shard][1] for i in range(len(votes))] == seats
    assert all(q >= 0 for q, _ in got.values())


def test_query_equals_sql(spark, tmp_path):
    rows = [r for i, r in enumerate(odd_rows()) if r[0] is not None]
    df = spark.createDataFrame(rows, DOCS).dropDuplicates(["doc_id"])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, mixing.mix_documents(df).collect()), key=str) == sorted(con.sql(mixing.SQL).fetchall(), key=str)


def test_applied_mix_repeats_and_drops_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    kept = mixing.apply_mix(df)
    assert kept.columns == df.columns
    counts = {r.doc_id: r["count"] for r in kept.where("doc_id % 7 = 0 and doc_id > 20").groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2} and 2 in counts.values()
    assert kept.where(mixing.words(F.col("text")) == 0).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix_documents(df).collect() == [] and mixing.apply_mix(df).count() == 0
