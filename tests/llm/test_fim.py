import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evidex.llm import fim

from .brute import DOCS, odd_rows


def plain(key, text, rate=100, spm=50):
    """The contract, read word by word."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h4 % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed=5):
    rng = random.Random(seed)
    shared = "".join(rng.choice("abcé ü\n日") for _ in range(9000))
    out = [None, "", "\n", "\n\n\n", "no end", "a\nb", "a\r\nb\r\n", "<P>", "a<S", "<\nS>", "x<M>y", "<" * 5000, "é" * 9000, "\n" * 9000, "<P" * 3000, "😀\n" * 3000]
    out += [shared, "before " + shared, shared + "after\n", shared[:4000] + "other\n" + shared[4000:]]
    out += ["x" * n + mark + "y" * 300 for n in range(8180, 8196) for mark in ("<S>", "<S\n>")]  # control strings over the edge of a longest chunk
    return out + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(3000))) for _ in range(40)]


def test_samples_equal_the_contract(spark):
    rows = list(enumerate(texts())) + [(None, "a\nb\nc\n"), (None, None), (3, "again\n"), (3, "again\n"), (-9, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = fim.fill_in_middle(df).select("doc_id", "text", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == plain(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = [(i, f"a{i}\nb\n") for i in range(400)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"), rate=30, suffix_first=10).select("doc_id", "text", "fim.*").collect()
    assert all(tuple(r)[2:] == plain(r.doc_id, r.text, 30, 10) for r in got) and 60 < sum(r.form != "plain" for r in got) < 180


def test_query_equals_sql_and_contract_on_odd_rows(spark, tmp_path):
    rows = odd_rows() + [(1000 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, fim.fim_documents(docs).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(fim.SQL).fetchall(), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], *plain(r[0], r[1])[:4], sha(plain(r[0], r[1])[4]), sha(r[1] or "")) for r in rows]
    assert got == sorted(want, key=str)


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 60_000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), shared])
    memo = fim.Memo()
    cuts = []
    for body in (shared, shifted):
        parts = next(fim.chunked(body, np.array([0, len(body)]), memo)).parts
        assert sum(p.size for p in parts) == len(body) and all(fim.LEAST <= p.size <= fim.MOST for p in parts[:-1])
        cuts.append(len(parts))
    assert memo.hits >= 0.8 * cuts[0]  # the passage was scanned once


def test_summaries_add_up_for_any_chunks_and_memory():
    for limit in (0, 100, 1 << 20):
        memo = fim.Memo(limit)
        for text in texts():
            short = (text or "").encode()[:600]
            for step in (1, 2, 3, 7, 4096):
                parts = [memo(short[i : i + step]) for i in range(0, len(short), step)]
                one = fim.Chunked(short, parts)
                lines = re.findall(rb"[^\n]*\n|[^\n]+", short)
                assert one.lines == len(lines) and one.marked() == any(m in short for m in (b"<P>", b"<S>", b"<M>"))
                for k in {0, 1, len(lines) // 2, len(lines)} & set(range(len(lines) + 1)):
                    cut = b"".join(lines[:k])
                    assert one.after(k) == (len(cut), sum(c & 0xC0 != 0x80 for c in cut))
        assert memo.held <= max(limit, 4096)


def test_no_rows_and_clashing_columns(spark):
    schema = "doc_id string, text string, fim string, n string, output string, m map<string,int>"
    assert fim.fill_in_middle(spark.createDataFrame([], schema)).count() == 0
    got = fim.fill_in_middle(spark.createDataFrame([("a", "x\ny\n", "own", "n", "o", {"k": 1})], schema), out="sample").collect()[0]
    assert (got.fim, got.n, got.output, got.m) == ("own", "n", "o", {"k": 1}) and got["sample"].n == 2
