import hashlib

import pytest
from pyspark.sql import functions as F

from evidex.llm import fingerprint as fp

from .brute import DOCS, odd_rows


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows(4, 5)[:1], [(1, "one\ntwo", None, None, 1, None, None, None, None, None)], [(1, None, None, None, None, None, None, None, None, None)] * 3])
def test_edits_equal_brute_force(spark, rows):
    got = fp.fingerprint_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    for r in got:
        if r.n_chars < 2:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


def test_empty_table(spark):
    assert fp.fingerprint_documents(spark.createDataFrame([], DOCS)).collect() == []


def prints(spark, texts):
    df = fp.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "f")
    return [r.f for r in df.orderBy("i").collect()]


def test_order_does_not_matter_but_multiplicity_does(spark):
    a, b, c, d = prints(spark, ["one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\ntwo.\nthree.\nthree.", "one.\ntwo.\nfour."])
    assert a == b and len({tuple(x) for x in (a, c, d)}) == 3


def test_insertion_and_deletion(spark):
    whole, part, one = prints(spark, ["a b.\nc d.\ne f.", "a b.\nc d.", "e f."])
    got = spark.createDataFrame([(whole, part, one)], "w array<bigint>, p array<bigint>, o array<bigint>").select(fp.insert(F.col("p"), F.col("o")).alias("plus"), fp.delete(F.col("w"), F.col("o")).alias("minus")).first()
    n = fp.EXACT + fp.SKETCH
    assert got.plus[:n] == whole[:n] and got.minus[:n] == part[:n]


def test_likeness_follows_shared_sentences(spark):
    base = [f"sentence number {i} says {i * i}." for i in range(60)]
    texts = [" ".join(base), " ".join(base[:45] + [f"other {i}." for i in range(15)]), " ".join(f"none {i} at all." for i in range(60))]
    a, b, c = prints(spark, texts)
    got = spark.createDataFrame([(a, b, c)], "a array<bigint>, b array<bigint>, c array<bigint>").select(fp.likeness(F.col("a"), F.col("a")).alias("same"), fp.likeness(F.col("a"), F.col("b")).alias("near"), fp.likeness(F.col("a"), F.col("c")).alias("far")).first()
    assert got.same == 1 and 0.35 < got.near < 0.85 and got.far < 0.2


@pytest.mark.parametrize(("n", "m", "shared"), [(20_000, 18_000, 0), (30_000, 25_000, 0), (20_000, 20_000, 10_000)])
def test_likeness_of_long_texts(spark, n, m, shared):
    a, b = prints(spark, ["\n".join(f"one {i}" for i in range(n)), "\n".join(f"one {i}" if i < shared else f"two {i}" for i in range(m))])
    got = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - shared / (n + m - shared)) < 0.2
