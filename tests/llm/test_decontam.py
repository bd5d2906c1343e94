import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from evidex.llm import decontam as dc
from evidex.llm.common import text_bytes

from .brute import DOCS, contamination, odd_rows, prose


def planted(seed=8):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(12)] + [(3, "same id again with quite different words in it here now"), (None, "an item without any id that has more than ten words in all"), (50, None), (51, "!!!")]
    rows = odd_rows(seed)
    for i in range(20):
        item = rng.choice(items)[1] or ""
        w = item.split()
        a = rng.randrange(max(1, len(w) - 3))
        rows.append((5000 + i, prose(rng, 15) + " " + " ".join(w[a : a + rng.choice([8, 10, 14, 40])]).upper() + "; " + prose(rng, 15), "en", "a", 1, None, None, None, None, None))
    return [(a, b if b is None or len(b) < 20_000 else b[:20_000], *rest) for a, b, *rest in rows], items


@pytest.mark.parametrize("shard", [400_000, 60])
def test_equals_brute_force(spark, shard, monkeypatch):
    rows, items = planted()
    if shard < 1000:  # many shards and long documents cut with overlap, in this process
        monkeypatch.setattr(dc, "SHARD", shard)
        chosen = dc.Items.of([i for i, _ in items], [t for _, t in items])
        got = dc.scan_texts(pa.array([r[1] for r in rows], pa.string()), chosen, 10).to_pylist()
        out = [(g["n_words"], sum(s["stop"] - s["start"] for s in g["spans"]), {items[i][0] for i in g["items"]}) for g in got]
        assert out == [contamination(r[1], items) for r in rows]
        return
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.decontaminate_documents(df, bench).collect()
    want = []
    for r in rows:
        n, hit, names = contamination(r[1], items)
        digest = hashlib.sha256(",".join(sorted("null" if i is None else str(i) for i in names)).encode()).hexdigest()
        want.append((r[0], n, hit, len(names), digest, hit > 0))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    clean = dc.remove_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[5] for w in want)


def test_several_chunks_give_the_same(spark, monkeypatch):
    rows, items = planted(9)
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, dc.decontaminate_documents(df, bench).collect()), key=str)
    monkeypatch.setattr(dc, "item_chunks", lambda b, text, key, f=dc.item_chunks: f(b, text=text, key=key, limit=100))
    assert len(list(dc.item_chunks(bench, text="text", key="item_id"))) > 3
    assert sorted(map(tuple, dc.decontaminate_documents(df, bench).collect()), key=str) == one


def test_longest_matches_and_places(spark):
    docs = spark.createDataFrame([(1, "zero one two three nine"), (2, "x one two three four y")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "one two three four five")], "item_id bigint, text string")
    got = {r.item_start: (r.words, r.doc, r.start) for r in dc.longest_matches(docs, bench).collect()}
    assert got[0] == (4, 2, 1) and got[2] == (2, 2, 3)


@pytest.mark.parametrize(("rows", "items"), [([], [(1, "a b c")]), ([(1, "a b c", *[None] * 8)], []), ([], [])])
def test_empty_tables(spark, rows, items):
    got = dc.decontaminate_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [r.contaminated for r in got] == [False] * len(rows)


def test_words_across_segments_have_one_hash(monkeypatch):
    texts = ["alpha beta", "a" * 50 + " b", "beta alpha" + " " * 70 + "alpha", "alphabeta", "éé ü1", "a" * 200 + "x alpha " + "a" * 200 + "x"]
    body, at = text_bytes(pa.array(texts))
    h1, n1 = dc.words(body, at)
    monkeypatch.setattr(dc, "SEGMENT", 64)
    h2, n2 = dc.words(body, at)
    assert n1.tolist() == n2.tolist() == [2, 2, 3, 1, 2, 3]
    names = [w for t in texts for w in t.lower().split()]
    for h in (h1, h2):
        seen = {}
        for w, x in zip(names, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
        assert len(set(h.tolist())) == len(set(names))


def test_suffix_array_is_sorted():
    s = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    order, _ = dc.suffix_array(s, 8)
    keys = [tuple(s[i : i + 8].tolist()) for i in order.tolist()]
    padded = [k + (9,) * (8 - len(k)) for k in keys]
    assert padded == sorted(padded)
