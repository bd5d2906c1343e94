"""Extra columns whose names the operators use themselves, and columns that can't be hashed or compared."""

import corpus_pipeline
from evidex.llm import decontam, fingerprint, histogram_sort, langid, mixing, simhash

from .brute import odd_rows

NAMES = (
    "row doc id h h2 id2 key size range first part s r inside start upto quotas draw target taken source_size shard_taken copies copy shard slot found f n hits spans items language fp node bands component "
    "text_hash fingerprint own after next k b ahead at body paras hashes edited changed _key _hash _id _n _copies _copy _row _size _range _found0 _k _own _b _ahead rank weight target2 count"
).split()
NEW = {"shard": {"shard", "slot"}, "mix": set(), "found": {"found"}}


def frame(spark):
    rows = [r[:5] for r in odd_rows(3, 40)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES) + ", m map<string,int>, d struct<a:array<int>>, `a b.c` binary"
    return spark.createDataFrame([(*r, *[f"{i}.{n}" for n in NAMES], {"k": i}, ([i],), bytes([i % 256])) for i, r in enumerate(rows)], schema).repartition(3)


def plain(rows, without=()):
    return sorted((str(sorted((k, str(v)) for k, v in r.asDict().items() if k not in without)) for r in rows))


def test_operators_keep_every_column(spark):
    df = frame(spark)
    assert plain(histogram_sort.shard(df).collect(), NEW["shard"]) == plain(df.collect(), NEW["shard"])
    assert plain(decontam.search_documents(df, spark.createDataFrame([(1, "the of und que les ein rojo")], "item_id int, text string")).collect(), NEW["found"]) == plain(df.collect(), NEW["found"])
    one = simhash.drop_near_duplicates(df).collect()
    assert set(plain(one)) <= set(plain(df.collect())) and len(one) == len(set(plain(one)))
    assert set(plain(mixing.apply_mix(df).collect())) <= set(plain(df.collect()))
    assert set(plain(langid.keep_identified(df).collect())) <= set(plain(df.collect()))
    marked = fingerprint.with_next(fingerprint.with_fingerprint(df, "text", "paras"), "doc_id", "text", ["doc_id"], "next")
    assert plain(marked.collect(), ("paras", "next")) == plain(df.collect(), ("paras", "next"))


def test_every_stage_keeps_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark)
    known = set(plain(docs.collect(), NEW["shard"]))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert got and set(plain(got, NEW["shard"])) <= known, name
        docs = spark.createDataFrame(got, docs.schema)
