import numpy as np
import pyarrow.fs as pafs
import pytest

from evidex.llm import token_scan as ts
from evidex.llm.common import shared_path

from .brute import DOCS, odd_rows


def documents(ids):
    out, run = [], 0
    for x in ids:
        if x == ts.END:
            out.append(run)
            run = 0
        else:
            run += 1
    return out + ([run] if run else [])


@pytest.mark.parametrize("block", [1, 3, 7, 64, 5000])
def test_scan_equals_brute_force_at_any_block_size(spark, block, monkeypatch):
    monkeypatch.setattr(ts, "SPAN", 4)
    rng = np.random.default_rng(block)
    folder = shared_path(spark, "scan")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    files = {"tokens-0.bin": [], "tokens-1.bin": [ts.END], "tokens-2.bin": [5] * 40, "tokens-3.bin": [ts.END] * 9}
    files |= {f"tokens-{i}.bin": np.where(rng.random(200) < 0.15, ts.END, 7).tolist() for i in range(4, 8)}
    for name, ids in files.items():
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(np.array(ids, ts.DTYPE).tobytes())
    got = {}
    for r in ts.document_tokens(ts.scan_blocks(spark, folder, block_tokens=block)).collect():
        got.setdefault(r.file, {})[r.ordinal] = r.n_tokens
    for name, ids in files.items():
        want = documents(ids)
        assert got.get(name, {}) == dict(enumerate(want)), name


def test_counts_equal_the_tokenizer(spark):
    rows = odd_rows()
    got = ts.count_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    enc = ts.encoder(ts.VOCABULARY)
    want = sorted((x[0] is None, x[0] or 0, len(enc.encode_ordinary(x[1] or ""))) for x in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want


def test_empty_table(spark):
    assert ts.count_documents(spark.createDataFrame([], DOCS)).collect() == []
