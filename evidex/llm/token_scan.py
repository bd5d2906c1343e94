"""Token counts by separator scan of flat token files.

Token files are plain arrays of fixed-width ids, documents one after another, each ended by an end-of-document id, without any index.
Files are cut into blocks that tasks read by position; each block is searched for separators with one vectorised comparison, giving its
separators' number, the tokens before its first and after its last one, and the documents wholly inside it. A prefix scan over the blocks'
summaries (within spans of ``SPAN`` blocks, then over spans) yields each block's first document number and the tokens carried into it, which
stitches documents that cross blocks. Only summaries are shuffled; nothing depends on a document's length.

``write_tokens`` makes such files from texts with a byte-level BPE vocabulary (its path is a parameter), one file a task, written under a
temporary name and renamed, so a repeated task leaves one whole file. Defined results: null and empty texts have 0 tokens; a file without a final
separator ends its last document at its end; an empty file or table has no documents; repeated rows count separately.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_path, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, DTYPE = 50256, "<u2"
SPAN = 1024


def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, *, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes docs' texts as token files into folder and returns (key, file, ordinal) of each row, as a written table."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, ordinal = f"tokens-{task.partitionId():06d}.bin", 0
        part = f"{root}/_{name}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for b in batches:
                for t in b.column(1):
                    ids = enc.encode_ordinary(t.as_py() or "")
                    out.write(np.array([*ids, END], DTYPE).tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n))], [key, "file", "ordinal"])
                ordinal += n
        fs.move(part, f"{root}/{name}")

    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    return written(docs.select(key, text).mapInArrow(encode, f"{key} {kind}, file string, ordinal bigint"), "token-manifest")


def scan_blocks(spark: SparkSession, folder: str, *, block_tokens: int = 1 << 20, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """(file, block, tokens, seps, head, tail, inside array<bigint>) of every block of the token files in folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*").load(folder).select("path", "length")
    width = np.dtype(dtype).itemsize
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / (block_tokens * width)))).alias("block"))
    blocks = blocks.repartition(4 * partitions(spark), "path", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file:///") else path)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(block_tokens * width, block * block_tokens * width), dtype)
                seps = np.flatnonzero(ids == end)
                inside = np.diff(seps) - 1
                head, tail = (int(seps[0]), len(ids) - 1 - int(seps[-1])) if len(seps) else (len(ids), len(ids))
                rows.append((path.rpartition("/")[2], block, len(ids), len(seps), head, tail, inside.tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "tokens", "seps", "head", "tail", "inside"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("block", "tokens", "seps", "head", "tail")], ("inside", pa.list_(pa.int64()))])
    return blocks.mapInArrow(scan, "file string, block bigint, tokens bigint, seps bigint, head bigint, tail bigint, inside array<bigint>")


def document_tokens(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, by a prefix scan over the blocks' summaries."""
    rows = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    inner = Window.partitionBy("file", "span").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    # Within a span: separators before the block, and the tokens open at its start (all before it where none has a separator).
    rows = rows.withColumns({"_seps": F.coalesce(F.sum("seps").over(before), F.lit(0)), "_upto": F.coalesce(F.sum("tokens").over(before), F.lit(0))})
    rows = rows.withColumn("_cut", F.when(F.col("seps") > 0, F.col("_upto") + F.col("tokens") - F.col("tail")))
    rows = rows.withColumn("_open", F.col("_upto") - F.coalesce(F.max("_cut").over(before), F.lit(0)))
    spans = rows.groupBy("file", "span").agg(F.sum("seps").alias("s"), F.sum("tokens").alias("t"), F.max("_cut").alias("cut"))
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"s0": F.coalesce(F.sum("s").over(outer), F.lit(0)), "t0": F.coalesce(F.sum("t").over(outer), F.lit(0))})
    spans = spans.withColumn("t1", F.col("t0") - F.coalesce(F.max(F.col("t0") + F.col("cut")).over(outer), F.lit(0)))
    last = F.max("span").over(Window.partitionBy("file"))
    spans = spans.withColumn("end", last == F.col("span")).select(F.col("file").alias("f"), F.col("span").alias("p"), "s0", "t1", "end")
    rows = rows.join(spans, (rows.file == spans.f) & (rows.span == spans.p))
    carried = F.col("_open") + F.when(F.col("_seps") == 0, F.col("t1")).otherwise(F.lit(0))
    rows = rows.withColumn("_final", F.col("end") & (F.max("block").over(Window.partitionBy("file", "span")) == F.col("block")))
    first = F.when(F.col("seps") > 0, F.array(F.col("head") + carried)).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("tokens") + carried)
    unended = F.when(F.col("_final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    sizes = F.concat(first, "inside", unended)
    return rows.select("file", (F.col("s0") + F.col("_seps")).alias("at"), F.posexplode(sizes)).select("file", (F.col("at") + F.col("pos")).alias("ordinal"), F.col("col").alias("n_tokens"))


def count_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, file, ordinal, n_tokens of every document, counted from its token file."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    places = write_tokens(docs.select("doc_id", "text"), folder, vocabulary=vocabulary)
    counts = document_tokens(scan_blocks(spark, folder))
    # Both sides grow with the documents, and the manifest's files are far smaller than its rows: never broadcast.
    return places.hint("merge").join(counts, ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"))
